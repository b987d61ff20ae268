"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("TABLECHECK_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    rows, error = compare(spark, con, SF_DIR, entry.queries()[name], ORACLES.get(name))
    assert error is None, error
    if name not in ORACLES:
        assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["col_order", "source_col", "generated_col", "matching_cells", "value_match_pct"]
