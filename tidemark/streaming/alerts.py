"""Threshold alerts on a stream of metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import percent
from tidemark.operators.alerts import DEFAULT_PCT, threshold_alert


def stream_alerts(
    samples: DataFrame,
    usage: Column,
    limit: Column,
    step: str = "1 minute",
    delay: str = "1 minute",
    pct: float = DEFAULT_PCT,
    by: tuple[str, ...] = (),
    severity: str = "warning",
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Windows in which the largest usage exceeds ``pct`` percent of the largest limit.

    ``usage`` and ``limit`` say which samples are which; both maxima come from one aggregate, so the
    state is two numbers per open window and group. Samples later than ``delay`` are dropped. Works on
    a batch table in the same way.
    """
    return threshold_alert(
        samples.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .groupBy(*by, F.window(ts, step).alias("w"))
        .agg(
            F.max(F.when(usage, F.col(value))).alias("used"),
            F.max(F.when(limit, F.col(value))).alias("limit"),
        )
        .withColumn("pct", percent(F.col("used"), F.col("limit")))
        .select(*by, F.unix_micros("w.start").alias("step_us"), "used", "limit", "pct"),
        pct,
        severity,
    )
