"""Every registered query of the engine against its DuckDB equivalent on the smallest tables."""

import datetime
import decimal
import os

import pytest

from wardlight.engine.catalog import ACTIONS, TABLES, table
from wardlight.functions import scalars
from wardlight.operators import audit, templates
from wardlight.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == names
    assert got == sorted((tuple(plain(r[order.index(c)]) for c in names) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_scans_read_only_what_is_needed(spark):
    plan = table(spark, FOLDER, "lineitem").filter("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_templates_broadcast_their_small_tables(spark):
    plan = templates.patients_by_unit(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan


def test_the_whole_log_is_chained(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        got = [r.line for r in QUERIES["H1"](spark, FOLDER).orderBy("pos").collect()]
    finally:
        spark.conf.set(name, before)
    events = table(spark, FOLDER, "events").selectExpr("event_id as id", "cast(ts as string) as timestamp", "event_type", "floor(value * 10) as rowsAffected").orderBy("id").collect()
    assert got == audit.chain([{"id": r.id, "timestamp": r.timestamp, "action": ACTIONS[r.event_type], "rowsAffected": r.rowsAffected} for r in events])
    assert len(got) == table(spark, FOLDER, "events").count() > 200


def label(x):
    if x is None:
        return None
    exact = lambda y, places: decimal.Decimal(y).quantize(decimal.Decimal(places), decimal.ROUND_HALF_UP)
    if x >= 1e6:
        return f"{exact(x / 1e6, '0.1')}M"
    if x >= 1e3:
        return f"{exact(x / 1e3, '0.1')}K"
    whole = f"{exact(repr(x), '0.001'):,}".rstrip("0").rstrip(".")
    return whole


def test_every_order_has_its_label(spark):
    orders = table(spark, FOLDER, "orders").select("o_orderkey", "o_totalprice").collect()
    got = {r.o_orderkey: r.label for r in QUERIES["A2"](spark, FOLDER).collect()}
    assert got == {r.o_orderkey: label(r.o_totalprice) for r in orders}


def test_labels_of_ties_and_small_values(spark):
    values = [1250.0, 1350.0, 1450.0, 1750.0, 1050.0, 999.5, 999.4567, 0.0, 0.125, 12.0, -1234.5, 999_950.0, 1e9, 123_456_789_012.5, None]
    values += [1000.0 + 50 * k for k in range(2000)] + [1e6 + 50_000.0 * k for k in range(2000)] + [k * 0.37 for k in range(2700)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double")
    got = [r.label for r in frame.select("k", scalars.abbreviate_number(frame.x).alias("label")).orderBy("k").collect()]
    assert [g for g in zip(values, got) if label(g[0]) != g[1]] == []
    assert got[:6] == ["1.3K", "1.4K", "1.4K", "1.8K", "1.1K", "999.5"]
