"""Anomaly detection in text collections as PySpark jobs."""

from textanomaly.session import get_session

__all__ = ["get_session"]
