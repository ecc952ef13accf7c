"""Every registered query gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from promolens.testbed.oracle import ORACLE
from promolens.testbed.queries import QUERIES
from tests.compare import first_difference, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with oracle_connection(SF_DIR) as opened:
        yield opened


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches(spark, connection, name):
    assert first_difference(spark, connection, SF_DIR, name) is None


def test_entry(spark):
    assert entry(spark).count() > 0
