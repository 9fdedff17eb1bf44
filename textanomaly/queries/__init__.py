"""Registered queries and, where SQL can express them, their equivalents."""

from textanomaly.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
