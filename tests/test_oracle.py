"""Every query with SQL gives the rows of its SQL; the others give rows with a stable schema."""

import os

import pytest
from compare import difference, run_sql
from parley.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), run_sql(ORACLE_SQL[name], SF)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    first = QUERIES[name](spark, SF)
    assert first.count() > 0 and len(set(first.columns)) == len(first.columns)
