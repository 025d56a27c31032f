"""Every catalogue query against its SQL twin on the 0.01 tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check
import oracles
from tallyward import catalog

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_only_the_classifier_has_no_twin():
    assert set(catalog.queries()) - set(oracles.oracle_sql()) == {"race_classifier"}
    assert set(oracles.oracle_sql()) <= set(catalog.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].asDict().keys() >= {"yearpd", "count", "trend"}


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    said = check.compare(
        spark, con, DATA, name, catalog.queries()[name], oracles.oracle_sql()[name]
    )
    assert said.startswith("ok"), said
