"""Every registered query against its SQL oracle, and the driver's entry."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from oracle import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_oracle(spark, connection, name):
    found = entry_points.queries()[name](spark, SMALL)
    assert differences(found, connection, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["state", "inflow", "outflow", "net_migration"]
