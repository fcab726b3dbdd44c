"""Registered queries next to their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from side_by_side import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"bulk_run", "stream_uploads", "lead_table_exact", "prepared_records", "enrich_location", "full_address"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
