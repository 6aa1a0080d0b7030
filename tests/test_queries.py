"""Every registered query against its SQL statement on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry
from docketry.plans import check

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return check.connect(DATA)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    matches, message = check.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), DATA)
    assert matches, message


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
