"""Application and pod status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MICROS, micros
from tidemark.operators.joins import null_safe_join
from tidemark.operators.ordered import ROWS_PER_PIECE, ordered
from tidemark.session import use_checkpoint_dir

# How a pod that waits in the queue of the batch scheduler reports itself.
QUEUED_TYPE = "PodScheduled"
QUEUED_STATUS = "False"
QUEUED_REASON = "Unschedulable"
QUEUED_MESSAGE = "pod group is not ready"


def current_state(df: DataFrame, by: list[str], ts="ts", state="state") -> DataFrame:
    """Latest state of each application."""
    return df.groupBy(*by).agg(F.max_by(state, ts).alias("state"), F.max(ts).alias("since"))


def state_counts(df: DataFrame, by: list[str], ts="ts", state="state") -> DataFrame:
    """Applications per latest state."""
    return current_state(df, by, ts, state).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def saw_in_order(df: DataFrame, by: list[str], states: list[str], ts="ts", state="state") -> DataFrame:
    """Whether each application showed the states one after the other (others may lie between).

    ``reached`` counts the states seen in order. Each state is looked for after the first time its
    predecessor was reached, which finds the order whenever there is one. Each step reads the rows of one state, joins
    them to one row per application and takes the least, so rows of a busy application are split and added up
    where they are; only the row per application is written between steps.
    """
    timed = df.schema[ts].dataType.typeName().startswith("timestamp")
    at = micros(F.col(ts)) if timed else F.col(ts).cast("bigint")
    rows = df.select(*by, F.col(state).alias("s"), at.alias("at"))
    seen = rows.groupBy(*by).agg(F.lit(0).alias("reached"), F.lit(None).cast("bigint").alias("last"))
    use_checkpoint_dir(df.sparkSession)
    for step, wanted in enumerate(states):
        seen = seen.checkpoint()
        open_ = seen.filter(F.col("reached") == step).select(*by, "last")
        later = F.col("last").isNull() | (F.col("at") > F.col("last"))
        hits = null_safe_join(rows.filter(F.col("s") == wanted), open_, by, "inner").filter(later)
        first = hits.groupBy(*by).agg(F.min("at").alias("hit"))
        found = null_safe_join(seen, first, by, "left")
        more = F.col("reached") + F.col("hit").isNotNull().cast("int")
        seen = found.select(*by, more.alias("reached"), F.coalesce("hit", "last").alias("last"))
    return seen.select(*by, "reached", (F.col("reached") == len(states)).alias("in_order"))


def any_match(pods: DataFrame, name_part: str, phase: str = "Running", by: tuple[str, ...] = ()) -> DataFrame:
    """Whether any pod with the name part is in the phase (any pod counts, not just the first)."""
    hit = F.col("pod").contains(name_part) & (F.col("phase") == phase)
    return pods.groupBy(*by).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("matched"))


def is_queued(conditions: Column) -> Column:
    """Whether any condition says the pod waits for its group; false for missing conditions."""

    def waits(c: Column) -> Column:
        return (
            (c["type"] == QUEUED_TYPE)
            & (c["status"] == QUEUED_STATUS)
            & (c["reason"] == QUEUED_REASON)
            & F.coalesce(c["message"].contains(QUEUED_MESSAGE), F.lit(False))
        )

    return F.coalesce(F.exists(conditions, waits), F.lit(False))


def queued(pods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether any pod of the group waits in the queue, and how many do."""
    flagged = pods.withColumn("waits", is_queued(F.col("conditions")))
    return flagged.groupBy(*by).agg(
        F.coalesce(F.bool_or("waits"), F.lit(False)).alias("queued"),
        F.count_if("waits").alias("waiting"),
    )


def retry_report(
    attempts: DataFrame, policy: DataFrame, by: str = "app", ts="ts", rows=ROWS_PER_PIECE
) -> DataFrame:
    """Failed attempts per application and kind against the allowed retries and their spacing.

    ``attempts`` holds one row per failure with ``kind`` (``run`` or ``submit``); ``policy`` one row
    per application and kind with ``max_retries`` (0: never) and ``gap_s``. A first attempt is no retry. Where no policy
    is known, ``over_budget`` and ``too_fast`` are null; ``too_fast`` is false where no gap is asked for.
    """
    us = attempts.select(by, "kind", micros(F.col(ts)).alias("us"))
    spaced = ordered(us, [by, "kind"], "us", rows=rows).previous(before="us").done()
    tried = spaced.groupBy(by, "kind").agg(
        F.count(F.lit(1)).alias("failures"),
        (F.min(F.col("us") - F.col("before")) / MICROS).alias("min_gap_s"),
    )
    return tried.join(policy, [by, "kind"], "left").select(
        by,
        "kind",
        "failures",
        "min_gap_s",
        (F.col("failures") > F.col("max_retries") + 1).alias("over_budget"),
        F.when(
            F.col("max_retries").isNotNull(), F.coalesce(F.col("min_gap_s") < F.col("gap_s"), F.lit(False))
        ).alias("too_fast"),
    )
