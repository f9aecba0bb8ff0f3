"""The physical plans are the intended ones."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, eventlog, joins, metrics
from tidemark.operators.text import tokenize, word_count
from tidemark.plans import inputs, reports

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    return shown.getvalue()


def tree(df) -> str:
    return plan(df).split("\n\n\n")[0]


def test_one_shuffle_per_word_count(spark):
    df = word_count(tokenize(
        inputs.table(spark, SMALL, "documents").select(F.col("text").alias("value"))
    ))
    shown = tree(df)
    assert shown.count("Exchange") == 1
    assert shown.count("HashAggregate") == 2  # partial before, final after the shuffle


def test_filters_and_columns_reach_the_scan(spark):
    shown = plan(reports.pushed_scan(spark, SMALL))
    assert "GreaterThanOrEqual(l_quantity,49.0)" in shown and "EqualTo(l_returnflag,R)" in shown
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>", shown)


def test_partitions_are_pruned(spark):
    shown = plan(reports.partition_scan(spark, SMALL))
    assert "PartitionFilters: [isnotnull(o_orderpriority" in shown


def test_counters_use_one_shuffle(spark):
    shown = tree(metrics.counter_rate(inputs.samples(spark, SMALL), 3600))
    assert shown.count("Exchange") == 1
    assert shown.count("Window") == 2


def test_top_n_is_cut_before_the_shuffle(spark):
    files = inputs.table(spark, SMALL, "orders").selectExpr("o_custkey AS app", "o_orderkey AS seq")
    shown = tree(eventlog.retain_last(files, 5))
    assert shown.count("WindowGroupLimit") == 2
    assert tree(reports.top_orders_per_customer(spark, SMALL)).count("WindowGroupLimit") == 2


def test_absence_reduces_the_observed_side_first(spark):
    expected = inputs.table(spark, SMALL, "nation").selectExpr("n_nationkey AS k")
    observed = inputs.table(spark, SMALL, "customer").selectExpr("c_nationkey AS k")
    shown = tree(alerts.absent(expected, observed, ["k"]))
    assert "HashAggregate" in shown and "Anti" in plan(alerts.absent(expected, observed, ["k"]))


def test_lookup_checks_the_size(spark):
    nation, orders = (inputs.table(spark, SMALL, t) for t in ("nation", "orders"))
    assert joins.fits_broadcast(nation) and not joins.fits_broadcast(orders, 1000)
    assert "BroadcastHashJoin" in tree(orders.join(joins.lookup(nation), F.col("o_custkey") == F.col("n_nationkey")))
    assert joins.lookup(orders, 1000) is orders


def test_shuffles_start_as_wide_as_the_input(spark):
    from tidemark import session

    spark.conf.unset(session.INITIAL)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.size_shuffles(spark, 1000) == base and spark.conf.get(session.INITIAL, None) is None
    assert session.size_shuffles(spark, 100 * 2**40) == 100 * 2**40 // session.SHUFFLE_BYTES
    assert session.size_shuffles(spark, 1) == 100 * 2**40 // session.SHUFFLE_BYTES
    unknown = session.table_bytes(spark.sparkContext.parallelize([(1,)]).toDF("a long"))
    assert session.size_shuffles(spark, unknown) == 100 * 2**40 // session.SHUFFLE_BYTES
    # a query that was built before runs after the next one has been prepared
    session.apply_settings(spark)
    assert spark.conf.get(session.INITIAL) == str(100 * 2**40 // session.SHUFFLE_BYTES)
    spark.conf.unset(session.INITIAL)


def test_only_small_scans_are_spread(spark, monkeypatch):
    from tidemark.sources import basic

    orders = inputs.table(spark, SMALL, "orders")
    assert basic.spread(orders, "o_orderkey") is not orders
    monkeypatch.setattr(basic, "SPREAD_BYTES", 1000)
    assert basic.spread(orders, "o_orderkey") is orders


def test_scratch_is_dropped(spark):
    import os

    from tidemark import session

    reports.saved_table(spark, SMALL).collect()
    assert os.path.isdir(session.scratch_root(spark))
    session.drop_scratch(spark)
    assert not os.path.exists(session.scratch_root(spark))
    assert not spark.catalog.databaseExists("tidemark_reports")


def test_range_join_has_no_nested_loop(spark):
    shown = tree(reports.price_band(spark, SMALL))
    assert "NestedLoop" not in shown and "Cartesian" not in shown


@pytest.mark.parametrize("bin_width", [0.7, 3.0, 100.0])
def test_range_join_equals_the_theta_join(spark, bin_width):
    points = spark.range(60).select((F.col("id") * 7 % 61 / 2.0).alias("p"))
    ranges = spark.range(12).select(
        F.col("id").alias("r"), (F.col("id") * 2.5).alias("lo"), (F.col("id") * 2.5 + F.col("id") % 4).alias("hi")
    )
    got = joins.range_join(points, ranges, F.col("p"), F.col("lo"), F.col("hi"), bin_width)
    want = {
        (p, r)
        for p in (i * 7 % 61 / 2.0 for i in range(60))
        for r in range(12)
        if r * 2.5 <= p < r * 2.5 + r % 4
    }
    rows = [(x.p, x.r) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
