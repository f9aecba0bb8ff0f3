"""Alerts: thresholds, degraded and absent components, states, episodes, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MICROS, micros, step_start
from tidemark.operators import joins
from tidemark.operators.ordered import ROWS_PER_PIECE, ordered

# The default threshold in percent, the alert states and the pod phases.
DEFAULT_PCT = 90
INACTIVE, FIRING = "inactive", "firing"
PHASES = ("Failed", "Pending", "Running", "Succeeded", "Unknown")


def threshold_alert(
    df: DataFrame, pct: float = DEFAULT_PCT, severity: str = "warning", column: str = "pct", **labels: str
) -> DataFrame:
    """The rows above the threshold, labelled."""
    added = {"severity": severity, **labels}
    return df.filter(F.col(column) > pct).withColumns({k: F.lit(v) for k, v in added.items()})


def degraded(ready: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Components with fewer ready replicas than wanted (columns ``ready`` and ``wanted``)."""
    return ready.join(wanted, keys).filter(F.col("ready") < F.col("wanted"))


def absent(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected components of which nothing is observed."""
    return joins.absent(expected, observed, keys)


def evaluation_grid(df: DataFrame, step_s: int, by: list[str], ts="ts") -> DataFrame:
    """Every step between the table's first and last instant, for each alert."""
    step = step_start(micros(F.col(ts)), step_s)
    low, high = df.agg(F.min(step), F.max(step)).first()
    alerts = df.select(*by).distinct()
    if low is None:
        return alerts.withColumn("step_us", F.lit(None).cast("bigint")).limit(0)
    return joins.explode_steps(alerts, F.lit(low), F.lit(high), step_s * MICROS, "step_us")


def alert_states(hits: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """State at each step: firing where the expression yields a row. There is no hold time."""
    keys = [*by, "step_us"]
    fired = hits.select(*keys).distinct().withColumn("hit", F.lit(True))
    state = F.when(F.col("hit"), F.lit(FIRING)).otherwise(F.lit(INACTIVE))
    return grid.join(fired, keys, "left").select(*keys, state.alias("state"))


def alert_episodes(
    hits: DataFrame, by: list[str], step_s: int, order="step_us", rows=ROWS_PER_PIECE
) -> DataFrame:
    """Runs of firing steps: first and last step, number of steps, seconds between the two.

    Works on the steps at which the alert fires alone: a run ends where the next hit is more than a step away.
    """
    fired = hits.select(*by, order).distinct()
    scan = ordered(fired, by, order, rows=rows).previous(before=order)
    begins = F.when(F.col(order) - F.col("before") <= step_s * MICROS, 0).otherwise(1)
    runs = scan.map(lambda rows: rows.withColumn("begins", begins)).running_sum("begins", "run").done()
    return (
        runs.groupBy(*by, "run")
        .agg(
            F.min(order).alias("start_us"),
            F.max(order).alias("end_us"),
            F.count(F.lit(1)).alias("steps"),
        )
        .withColumn("seconds", (F.col("end_us") - F.col("start_us")) / MICROS)
        .drop("run")
    )


def alert_transitions(
    hits: DataFrame, by: list[str], step_s: int, last_us: int | None, order="step_us", rows=ROWS_PER_PIECE
) -> DataFrame:
    """Steps at which the state changes, up to the last step of evaluation; an alert starts out inactive."""
    after = F.col("end_us") + step_s * MICROS

    def change(at: Column, old: str, new: str) -> Column:
        return F.struct(at.alias(order), F.lit(old).alias("from_state"), F.lit(new).alias("to_state"))

    changes = F.array(change(F.col("start_us"), INACTIVE, FIRING), change(after, FIRING, INACTIVE))
    runs = alert_episodes(hits, by, step_s, order, rows)
    return runs.select(*by, F.inline(changes)).filter(F.col(order) <= F.lit(last_us).cast("bigint"))


def reached_within(
    states: DataFrame, by: list[str], target: str, limit_s: int, ts="ts", state="state"
) -> DataFrame:
    """Whether each key showed the target state at most ``limit_s`` seconds after its first row."""
    us = micros(F.col(ts))
    waited = (F.col("reached_us") - F.col("start_us")) / MICROS
    return (
        states.groupBy(*by)
        .agg(
            F.min(us).alias("start_us"),
            F.min(F.when(F.col(state) == target, us)).alias("reached_us"),
        )
        .withColumn("seconds", waited)
        .withColumn("in_time", F.coalesce(F.col("seconds") <= limit_s, F.lit(False)))
    )


def health(
    pods: DataFrame, by: list[str], running: Column, dependency_ok: Column | None = None
) -> DataFrame:
    """UP when any replica runs, else DOWN; DEGRADED when it is up but a dependency is not healthy.

    ``dependency_ok`` is null where the dependency is not installed.
    """
    ok = F.lit(None).cast("boolean") if dependency_ok is None else dependency_ok
    return (
        pods.groupBy(*by)
        .agg(F.bool_or(running).alias("up"), F.bool_and(ok).alias("dep"))
        .withColumn(
            "status",
            F.when(~F.coalesce(F.col("up"), F.lit(False)), F.lit("DOWN"))
            .when(~F.col("dep"), F.lit("DEGRADED"))
            .otherwise(F.lit("UP")),
        )
        .drop("up", "dep")
    )


def pod_counts(
    pods: DataFrame, by: list[str], phase="phase", phases=PHASES, active="Running"
) -> DataFrame:
    """Pods, active replicas and pods per phase."""
    per_phase = [F.count_if(F.col(phase) == p).alias(p.lower()) for p in phases]
    return pods.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pods"),
        F.count_if(F.col(phase) == active).alias("active"),
        *per_phase,
    )
