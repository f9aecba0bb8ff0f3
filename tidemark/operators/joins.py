"""Joins shared by the operators: size-checked broadcast, null-safe keys, absence, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import table_bytes

#: A side of counted rows is broadcast up to this size.
BROADCAST_BYTES = 64 * 2**20
#: A side is hinted for a broadcast up to this size of its files, which are compressed: ten times as much in memory is still
#: no more than the bound above.
SCAN_BYTES = 6 * 2**20


def fits_broadcast(df: DataFrame, max_bytes: int = SCAN_BYTES) -> bool:
    """Whether the table has at most ``max_bytes`` by the optimizer's estimate, which is the files' size for a scan and
    goes down with filters, columns and aggregates. It knows nothing of the rows a generator makes, so a plan with one does
    not fit. No job runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return "Generate " not in plan.toString() and table_bytes(df) <= max_bytes


def lookup(df: DataFrame, max_bytes: int = SCAN_BYTES) -> DataFrame:
    """Hint a broadcast where the size allows it; else leave the join to adaptive execution, which measures the
    side once it is there."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, small: bool = False
) -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left key columns only."""
    renamed = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    if small:
        right = F.broadcast(right)
    on = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def absent(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows whose keys were never observed; all of them when nothing was observed.

    The observed keys are made distinct first, so a hot key shrinks on the map side.
    """
    return expected.join(observed.select(*keys).distinct(), keys, "left_anti")


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    point: Column,
    low: Column,
    high: Column,
    bin_width: float,
) -> DataFrame:
    """Rows with ``low <= point < high``: each range is spread over the bins it covers, the join is
    an equality on the bin and the range test runs on what matches. Empty ranges match nothing.
    """
    first = F.floor(low / F.lit(bin_width)).cast("bigint")
    last = F.floor(high / F.lit(bin_width)).cast("bigint")
    spread = explode_steps(ranges.filter(low < high), first, last, 1, "__bin")
    placed = points.withColumn("__bin", F.floor(point / F.lit(bin_width)).cast("bigint"))
    return placed.join(spread, "__bin").filter((point >= low) & (point < high)).drop("__bin")


#: Steps of one array value.
STRETCH = 10_000


def explode_steps(df: DataFrame, first: Column, last: Column, step: int, name: str) -> DataFrame:
    """A row for each of ``first, first + step, ... last``, made in stretches, so that no value holds them all."""
    count = F.floor((last - first) / F.lit(step)).cast("bigint")
    stretches = F.sequence(F.lit(0).cast("bigint"), F.floor(count / STRETCH).cast("bigint"))
    begun = df.filter(first <= last).withColumns({"__first": first, "__count": count})
    parts = begun.withColumn("__part", F.explode(stretches))
    low = F.col("__part") * STRETCH
    high = F.least(F.col("__count"), low + (STRETCH - 1))
    inside = parts.withColumn("__at", F.explode(F.sequence(low, high)))
    at = F.col("__first") + F.col("__at") * F.lit(step)
    return inside.withColumn(name, at).drop("__first", "__count", "__part", "__at")
