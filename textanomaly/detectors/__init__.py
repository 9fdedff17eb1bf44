"""Detector settings and the array arithmetic run inside Spark tasks."""

from textanomaly.detectors.spec import DetectorSpec

__all__ = ["DetectorSpec"]
