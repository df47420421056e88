"""Registered queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import database, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


LIBRARY = list(entry._QUERIES)


def test_every_query_has_sql():
    assert set(LIBRARY) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", LIBRARY)
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None
