"""Frames from rows, with a column that clashes with the operators' own names."""

import pytest


@pytest.fixture
def documents(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source); a column ``n`` and one named ``key`` go along."""
        full = [(*r, None)[:3] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(
            [(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in full],
            "doc_id long, text string, lang string, source string, n_chars long, key string, n int",
        )

    return make
