"""Degraded and absent components on streams, and sessions by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, DELAY = "1 minute", "1 minute"


def _per_window(df: DataFrame, keys: list[str], step: str, delay: str, ts: str, **columns: Column) -> DataFrame:
    """One row for each key and window of a side, so that the join holds no more than that."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    grouped = timed.groupBy(*keys, F.window(ts, step).alias("w"))
    return grouped.agg(*[c.alias(name) for name, c in columns.items()])


def stream_degraded(
    ready: DataFrame, wanted: DataFrame, keys: list[str], step=STEP, delay=DELAY, ts="ts", value="value"
) -> DataFrame:
    """Windows in which the newest number of ready replicas is below the newest number wanted: ``keys``, ``step_us``,
    ``ready``, ``wanted``.

    An inner join of two streams on key and window. A window is judged once the watermarks of both sides have passed it;
    later samples are dropped. On batch tables it is the same join without state.
    """
    newest = F.max_by(value, ts)
    left = _per_window(ready, keys, step, delay, ts, ready=newest)
    right = _per_window(wanted, keys, step, delay, ts, wanted=newest)
    low = left.join(right, [*keys, "w"]).filter(F.col("ready") < F.col("wanted"))
    return low.select(*keys, F.unix_micros("w.start").alias("step_us"), "ready", "wanted")


def stream_absent(
    expected: DataFrame, observed: DataFrame, keys: list[str], step=STEP, delay=DELAY, ts="ts"
) -> DataFrame:
    """Windows in which something is expected of a key and nothing is observed: ``keys``, ``step_us``.

    A left outer join of two streams on key and window. An absent window comes out once the watermarks of both sides have
    passed it, so it is never reported too early.
    """
    one = F.count(F.lit(1))
    left = _per_window(expected, keys, step, delay, ts, expected=one)
    right = _per_window(observed, keys, step, delay, ts, observed=one)
    return (
        left.join(right, [*keys, "w"], "left_outer")
        .filter(F.col("observed").isNull())
        .select(*keys, F.unix_micros("w.start").alias("step_us"))
    )


def sessions(events: DataFrame, by: list[str], gap: str, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Sessions by inactivity: a row starts a new one if it comes longer than ``gap`` after the one before it. ``by``,
    ``start_us`` and ``last_us`` (first and last row), ``n``.

    With ``delay`` the table is a stream: a session comes out once the watermark has passed its last row by the gap. Rows of
    a session are added up where they are before they are shuffled (a session setting), so a busy key is sent as
    a few sessions.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark(ts, delay)
    us = F.unix_micros(ts)
    grouped = timed.groupBy(*by, F.session_window(ts, gap).alias("w"))
    found = grouped.agg(F.min(us).alias("start_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"))
    return found.select(*by, "start_us", "last_us", "n")


def run_available(found: DataFrame, out: str, checkpoint: str) -> None:
    """Write what a stream's sources hold now; a later call goes on from the checkpoint."""
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
