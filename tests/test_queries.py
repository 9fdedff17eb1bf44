"""Every registered query against its SQL on the small tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", queries())
def test_query(spark, name):
    text, _, good = compare(queries()[name](spark, FOLDER), oracle_sql().get(name), FOLDER)
    assert good, text


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    result = entry(spark)
    assert result.columns == ["model", "auc", "ap"] and result.count() == 6
