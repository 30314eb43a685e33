"""Every registered query against its SQL twin in an independent engine."""

import pytest

from checks.compare import compare, database
from checks.oracle import ORACLE
from checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    verdict, rows, _ = compare(spark, connection, SMALL, name)
    assert verdict in ("ok", "rows only")
    assert rows > 0
