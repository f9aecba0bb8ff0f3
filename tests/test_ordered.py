"""Scans of hot keys equal the plain windows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import PIECE, ordered, ordered_in_pieces

def by_time():
    return Window.partitionBy("k").orderBy("t")


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows, half of them in one short burst; some keys are null."""
    ids = spark.range(0, 6000, 1, 5)
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1)
    burst = (F.col("id") % 6 == 0) & (F.col("id") < 3000)
    at = F.when(burst, 1_000_000 + F.col("id")).otherwise(F.col("id") * 7919 % 6007 * 1000)
    return ids.select(
        F.when(key != 5, key).alias("k"),
        at.alias("t"),
        (F.col("id") % 17).cast("double").alias("v"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("sparse"),
    ).withColumn("flag", (F.col("v") > 8).cast("int"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [10_000, 500, 60, 7])
def test_scans_equal_windows(spark, skewed, limit):
    scan = ordered(skewed, ["k"], "t", rows=limit)
    assert scan.split == (limit < 2000)
    got = (
        scan.previous(pv="v", pt="t")
        .running_sum("flag", "total")
        .running_min("sparse", "low")
        .fill_forward("sparse", "known")
        .done()
    )
    upto = by_time().rangeBetween(Window.unboundedPreceding, Window.currentRow)
    want = (
        skewed.withColumn("pv", F.lag("v").over(by_time()))
        .withColumn("pt", F.lag("t").over(by_time()))
        .withColumn("total", F.sum("flag").over(upto))
        .withColumn("low", F.min("sparse").over(upto))
        .withColumn(
            "known",
            F.last("sparse", ignorenulls=True).over(
                by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("limit", [500, 50])
def test_pieces_stay_small(skewed, limit):
    scan = ordered(skewed, ["k"], "t", rows=limit)
    assert (scan.rest.df.groupBy("k").count().agg(F.max("count")).first()[0] or 0) <= limit
    biggest = scan.df.groupBy("k", PIECE).count().agg(F.max("count")).first()[0]
    assert biggest <= 2 * limit


def test_rearranged_rows_use_the_same_cuts(skewed):
    scan = ordered(skewed, ["k"], "t", rows=100)
    later = scan.rearranged(lambda df: df.withColumn("t2", F.col("t") + 5000), "t2")
    got = later.running_sum("flag", "total").done()
    upto = Window.partitionBy("k").orderBy("t2").rangeBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("t2", F.col("t") + 5000).withColumn("total", F.sum("flag").over(upto))
    assert rows(got.select(want.columns)) == rows(want)


def test_given_pieces(skewed):
    placed = skewed.filter(F.col("k").isNotNull()).withColumn("p", F.floor(F.col("t") / 300_000))
    got = ordered_in_pieces(placed, ["k"], "p", "t").previous(pv="v").running_sum("v", "s").done()
    upto = by_time().rangeBetween(Window.unboundedPreceding, 0)
    want = placed.withColumn("pv", F.lag("v").over(by_time())).withColumn("s", F.sum("v").over(upto))
    assert rows(got.select(want.columns)) == rows(want)


def test_empty_input(skewed):
    assert ordered(skewed.limit(0), ["k"], "t").previous(p="v").done().count() == 0
