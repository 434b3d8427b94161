"""Every registered query of the dialect against its SQL in DuckDB, at the smallest scale."""

import datetime
import os

import pytest

from batchloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def sorted_rows(rows):
    return sorted([tuple(plain(v) for v in r) for r in rows], key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.select(*[f"`{c}`" for c in columns]).collect()) == sorted_rows(cursor.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["ds_where_keep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal)" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string" in plan


def test_retained_variables_share_one_shuffle(spark):
    from batchloom.operators import datastep as d

    e = spark.read.parquet(f"{SF}/events.parquet")
    w = d.spec(["user_id"], ["ts", "event_id"])
    df = e.select("event_id", d.running_sum("value", w).alias("a"), d.counter(w).alias("b"), d.lag("value", w).alias("c"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
