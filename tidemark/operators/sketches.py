"""Mergeable sketches: distinct counts and quantiles kept per group, merged over any of them.

A table is read once into one row per fine group (a day, say), which is stored. Coarser groups and longer periods come from
merging those rows; the table is not read again, and a late day is one more row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch (2 to this power), and the relative standard error that follows.
LOG_REGISTERS = 14
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Size of a quantile sketch, and the error of a rank as a share of all rows, at 99 % confidence.
QUANTILE_SIZE = 400
RANK_ERROR = 0.0075


def sketched(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """Per group: ``n`` rows, and sketches of the distinct values of one column and of the spread of another. Tasks sketch their own
    rows first, so a hot group is sent as one sketch a task. Nulls are not counted."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("quantile_sketch"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, in the same form."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", QUANTILE_SIZE).alias("quantile_sketch"),
    )


def estimated(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group: ``n``, the estimated number of distinct values, and a column for each quantile."""
    quantiles = [F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)).alias(name) for name, q in shares.items()]
    return sketches.select(*by, "n", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *quantiles)
