"""Share of points in the unit circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.basic import range_source


def circle_flag(x: Column, y: Column) -> Column:
    """1 when the point lies in the unit circle, else 0."""
    return F.when(x * x + y * y <= 1, F.lit(1)).otherwise(F.lit(0))


def inside_circle(df: DataFrame, seed: int) -> DataFrame:
    """Add ``inside`` for a random point of the square [-1, 1] x [-1, 1] per row."""
    points = df.withColumns({"x": F.rand(seed) * 2 - 1, "y": F.rand(seed + 1) * 2 - 1})
    return points.withColumn("inside", circle_flag(F.col("x"), F.col("y")))


def pi_from(flags: DataFrame) -> DataFrame:
    """``4 * inside / all`` in one global aggregate."""
    return flags.agg(
        F.sum("inside").cast("bigint").alias("inside"),
        F.count(F.lit(1)).alias("points"),
    ).withColumn("pi", F.try_divide(F.lit(4.0) * F.col("inside"), F.col("points")))


def pi_estimate(spark: SparkSession, slices: int = 2, seed: int = 0) -> DataFrame:
    """100000 random points per slice, one partition per slice."""
    return pi_from(inside_circle(range_source(spark, 100_000 * slices, slices), seed))
