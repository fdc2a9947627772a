"""Every keyed query against its SQL, and the entry points."""

from __future__ import annotations

import __spark_entry__ as entry_points
import pytest
from oracle import assert_same, connect

from keyloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_top_of_each_key_is_limited_before_the_shuffle(spark, data):
    plan = QUERIES["zrevrange"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_reach_the_scan(spark, data):
    plan = QUERIES["geo_search_radius"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id" in plan and "props" not in plan


@pytest.mark.parametrize("name", ["rpush", "lpush"])
def test_pushes_reach_every_list(spark, data, name):
    orders = {r[0] for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()}
    listed = {r[0] for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey").collect()}
    assert {r["key"] for r in QUERIES[name](spark, data).select("key").collect()} == orders | listed
