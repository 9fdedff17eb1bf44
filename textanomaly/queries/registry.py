"""All queries by name."""

from __future__ import annotations

from textanomaly.queries import corpus, detect, evaluate, fixed, splits, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (corpus, vectors, splits, evaluate, detect, fixed):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
