"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want, diff = compare(spark, con, QUERIES[name], SQL.get(name), FOLDER)
    assert not diff
    assert want is None or got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
