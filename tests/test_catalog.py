"""Every query of the catalog against DuckDB on the smallest tables."""

import os

import pytest

from dockmill.plans import catalog
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLE_SQL[name]) == ""


#: Queries that SQL can't express; tests of their operators compare them with plain versions.
NO_SQL = {"alike_names", "bm25_stemmed", "search_ranked"}


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == NO_SQL
