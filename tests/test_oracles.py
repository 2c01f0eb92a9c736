"""Every registered query runs; every one with checking SQL gives the same rows."""

import os

import pytest
from check_oracles import DATA, compare, connect

from paperweave.catalog import ORACLES, QUERIES

SF_DIR = os.path.join(DATA, os.environ.get("PAPERWEAVE_SF", "sf0.001"))


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name in ORACLES:
        assert compare(df.columns, rows, con, ORACLES[name]) == []
    else:
        assert rows
