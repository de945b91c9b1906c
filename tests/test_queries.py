"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from factline.plans import catalog, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda names, data: sorted(repr([plain(dict(zip(names, r))[c]) for c in cols]) for r in data)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"greedy_match", "sequential_match"}


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_scans_read_only_what_is_asked_for(spark):
    plan = registry.QUERIES["hook_semi_join"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_mocks_are_summed_before_tests_join_them(spark):
    plan = registry.QUERIES["scoped_mocks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") > plan.count("Join Inner") == 2
