"""Start-up latency and run time of applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MICROS, micros


def with_durations(runs: DataFrame) -> DataFrame:
    """Add ``latency_s`` (submitted to started) and ``run_s`` (started to ended), null if unknown."""

    def seconds(start: str, end: str):
        return (micros(F.col(end)) - micros(F.col(start))) / MICROS

    return runs.withColumns(
        {"latency_s": seconds("submitted", "started"), "run_s": seconds("started", "ended")}
    )


def mean_duration(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Mean of a duration per outcome over the rows that have one."""
    return df.groupBy(*by).agg(
        F.avg(seconds).alias("mean_s"), F.count(seconds).alias("n")
    )


def latency_histogram(df: DataFrame, edges: list[float], seconds: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per bucket (``le`` = upper edge, infinity last) and cumulative, empty buckets included for every group;
    rows without a value count for no bucket. One counter per bucket, combined before the shuffle."""
    uppers = [*sorted(map(float, edges)), float("inf")]
    below = [F.count_if(F.col(seconds) <= upper).alias(f"__{i}") for i, upper in enumerate(uppers)]
    upto = df.groupBy(*by).agg(*below)
    buckets = []
    for i, upper in enumerate(uppers):
        n = F.col(f"__{i}") - (F.col(f"__{i - 1}") if i else F.lit(0))
        buckets.append(
            F.struct(F.lit(upper).alias("le"), n.alias("n"), F.col(f"__{i}").alias("cumulative"))
        )
    return upto.select(*by, F.inline(F.array(*buckets)))
