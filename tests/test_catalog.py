"""Every named query against its SQL in DuckDB."""

from __future__ import annotations

import os

import pytest
from check import connect, differences

from gridloom.catalog import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
