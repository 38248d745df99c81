"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        result = compare(df, con, sql)
        assert result.startswith("ok") and "TYPES" not in result, result


def test_entry(spark):
    assert {"verdict", "excess", "scope"} <= set(entry.entry(spark).columns)
