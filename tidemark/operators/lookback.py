"""Values as they were known at an instant, and how many intervals are open at each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MICROS, step_start
from tidemark.operators.joins import explode_steps
from tidemark.operators.ordered import ROWS_PER_PIECE, ordered


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    order: str,
    take: list[str],
    within: int | None = None,
    since: str = "since",
    rows: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Each left row with the ``take`` columns of the newest right row of its key, and with that row's ``order`` as ``since``.

    The right row is at or before the left one in the bigint ``order``, at most ``within`` earlier; a left row without
    one has nulls. Of right rows of the same key and order the one with the largest columns counts. Null keys match each other. Both sides go through one ordered scan as
    one table (forward fill), so a hot key is cut into pieces and no pair of rows is made but the one that is kept.
    """
    others = [c for c in left.columns if c not in (*keys, order)]
    found = F.struct(F.col(order).alias(since), *take)
    asks = left.select(*keys, order, F.lit(1).alias("__asks"), F.struct(F.lit(1).alias("__one"), *others).alias("__row"))
    tells = right.filter(F.col(order).isNotNull()).select(*keys, order, F.lit(0).alias("__asks"), found.alias("__found"))
    both = asks.unionByName(tells, allowMissingColumns=True)
    scan = ordered(both, keys, order, ["__asks", "__found"], rows).fill_forward("__found", "__newest")
    newest = F.col("__newest")
    if within is not None:
        newest = F.when(F.col(order) - newest[since] <= within, newest)
    else:
        newest = F.when(F.col(order).isNotNull(), newest)
    known = scan.done().filter("__asks = 1").withColumn("__newest", newest)
    return known.select(
        *keys, order, *[F.col("__row")[c].alias(c) for c in others], *[F.col("__newest")[c].alias(c) for c in (since, *take)]
    )


def open_intervals(
    df: DataFrame, start: Column, end: Column, by: list[str], weight: Column | None = None, rows: int = ROWS_PER_PIECE
) -> DataFrame:
    """How many intervals ``[start, end)`` are open from each instant at which that changes: ``by``, ``us``, ``open``.

    A sweep over both ends: an interval adds its weight (1) at its start and takes it away at its end; one without an end
    stays open, one without a start or not longer than nothing never is. Changes of the same instant are added up before
    the ordered scan, and instants at which they cancel out are left out. Without ``by`` all intervals are one group.
    """
    if not by:
        return open_intervals(df.withColumn("__all", F.lit(0)), start, end, ["__all"], weight, rows).drop("__all")
    amount = F.lit(1).cast("bigint") if weight is None else weight
    spans = df.select(*by, start.cast("bigint").alias("s"), end.cast("bigint").alias("e"), amount.alias("w"))
    spans = spans.filter(F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s"))))
    ends = F.array(F.struct(F.col("s").alias("us"), F.col("w").alias("change")), F.struct(F.col("e").alias("us"), (-F.col("w")).alias("change")))
    changes = spans.select(*by, F.inline(ends)).filter(F.col("us").isNotNull())
    net = changes.groupBy(*by, "us").agg(F.sum("change").alias("change")).filter("change <> 0")
    swept = ordered(net, by, "us", rows=rows).running_sum("change", "open").done()
    return swept.select(*by, "us", "open")


def peak_per_step(swept: DataFrame, step_s: int, by: list[str], rows: int = ROWS_PER_PIECE) -> DataFrame:
    """The largest number open within each step, ``by``, ``step_us``, ``peak``; steps with none are left out.

    What is open before a change holds over all steps from the change before it; what is open after the last change of a
    group counts for the step of that change alone.
    """
    if not by:
        return peak_per_step(swept.withColumn("__all", F.lit(0)), step_s, ["__all"], rows).drop("__all")
    step = step_s * MICROS
    scan = ordered(swept, by, "us", rows=rows).previous(before_us="us", before="open").done()
    held = scan.filter(F.col("before") > 0)
    first, last = step_start(F.col("before_us"), step_s), step_start(F.col("us") - 1, step_s)
    over = explode_steps(held, first, last, step, "step_us").select(*by, "step_us", F.col("before").alias("n"))
    at = scan.select(*by, step_start(F.col("us"), step_s).alias("step_us"), F.col("open").alias("n"))
    peaks = over.unionByName(at).groupBy(*by, "step_us").agg(F.max("n").alias("peak"))
    return peaks.filter("peak > 0")
