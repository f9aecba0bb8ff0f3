"""Metric series: matchers, counters with resets, gauges, grids and roll-ups.

Samples have a timestamp, a value and the columns that name their series (``by``). A series has one
sample per instant. Instants come out as epoch microseconds (``us``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MICROS, finite, micros, percent, step_start, whole_match
from tidemark.operators.joins import explode_steps
from tidemark.operators.lookback import as_of
from tidemark.operators.ordered import ROWS_PER_PIECE, Ordered, ordered

SERIES = ("metric", "series")


def label_test(
    equal: dict[str, str] | None = None,
    unequal: dict[str, str] | None = None,
    pattern: dict[str, str] | None = None,
    labels: str = "labels",
) -> Column:
    """Whether all matchers hold. A missing label counts as the empty string; a pattern must match
    the whole value."""

    def label(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(labels), F.lit(name)), F.lit(""))

    tests = [label(k) == v for k, v in (equal or {}).items()]
    tests += [label(k) != v for k, v in (unequal or {}).items()]
    tests += [whole_match(label(k), v) for k, v in (pattern or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def match_labels(df: DataFrame, **matchers) -> DataFrame:
    """Samples whose labels match; matchers as in ``label_test``."""
    return df.filter(label_test(**matchers))


def _deltas(df: DataFrame, by, ts: str, value: str, rows: int) -> Ordered:
    """Per sample: the counter's growth since the sample before it.

    A value below the previous one means the counter restarted from 0, so the growth is the value
    itself. The first sample of a series has no growth (null). Values that are null, NaN or infinite are
    missing samples.
    """
    samples = df.select(*by, micros(F.col(ts)).alias("us"), F.col(value).alias("value"))
    samples = samples.filter(finite(F.col("value").cast("double")))
    scan = ordered(samples, list(by), "us", ["value"], rows).previous(before="value")
    grown = F.when(F.col("value") < F.col("before"), F.col("value")).otherwise(
        F.col("value") - F.col("before")
    )
    added = {"delta": grown, "reset": F.col("value") < F.col("before")}
    return scan.map(lambda rows: rows.withColumns(added))


def counter_deltas(df, by=SERIES, ts="ts", value="value", rows=ROWS_PER_PIECE) -> DataFrame:
    return _deltas(df, by, ts, value, rows).done()


#: Growths are added up as whole numbers of three units, powers of two a hundred places apart, so that what leaves a window
#: is exactly what entered; a growth of GROWTH_BOUND or more makes its windows infinite.
UNITS = (2.0**-152, 2.0**-52, 2.0**48)
GROWTH_BOUND = 2.0**148


def _shares(value: Column) -> list[Column]:
    """A number as multiples of the three units. A double has 53 binary places, so growths down to 2**-100 are kept in full,
    and no share has more than 31 digits."""
    shares, rest = [], value.cast("double")
    for unit in reversed(UNITS):
        share = F.rint(rest / F.lit(unit))
        shares.append(share.cast("decimal(38,0)"))
        rest = rest - share * F.lit(unit)
    return shares[::-1]


def counter_rate(
    df: DataFrame, window_s: int = 60, by=SERIES, ts="ts", value="value", rows=ROWS_PER_PIECE
) -> DataFrame:
    """Growth over the trailing window ``(t - w, t]`` and per second, at each sample.

    Each growth enters the running sum at its own time and leaves it one window later, so one ordered
    pass serves a window of any length (a sliding frame would add up every window again). Sums are exact, so growths of any
    size in a series do not disturb each other; none is rounded or left out.
    """
    scan = _deltas(df, by, ts, value, rows)
    names = [f"unit_{k}" for k in range(len(UNITS))]
    grown = F.col("delta").cast("double")
    shares = [F.when(grown < GROWTH_BOUND, s) for s in _shares(grown)]
    moved = [*zip(names, shares, strict=True), ("beyond", (grown >= GROWTH_BOUND).cast("int"))]

    def move(at: Column, sign: int, sample: bool) -> Column:
        return F.struct(at.alias("at"), *[(x * sign).alias(n) for n, x in moved], F.lit(sample).alias("sample"))

    moves = F.array(move(F.col("us"), 1, True), move(F.col("us") + window_s * MICROS, -1, False))
    timeline = scan.rearranged(lambda rows: rows.drop("reset").select("*", F.inline(moves)), "at")
    summed = timeline.running_sums(**{f"sum_{n}": n for n, _ in moved}).done()
    parts = [F.coalesce(F.col(f"sum_{n}").cast("double"), F.lit(0.0)) * unit for n, unit in zip(names, UNITS, strict=True)]
    total = F.when(F.col("sum_beyond") > 0, float("inf")).otherwise(parts[0] + parts[1] + parts[2])
    increase = F.when(F.col("delta").isNotNull(), total)
    return summed.filter("sample").select(
        *by,
        "us",
        "value",
        increase.alias("increase"),
        (increase / F.lit(float(window_s))).alias("rate"),
    )


def counter_increase(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    by=SERIES,
    ts="ts",
    value="value",
    rows=ROWS_PER_PIECE,
) -> DataFrame:
    """Growth of each counter within ``(start, end]`` in spite of restarts; bounds are timestamps.

    Samples after ``end`` are dropped at the scan; those before ``start`` are needed to tell the growth
    of the first sample inside.
    """
    if end is not None:
        df = df.filter(F.col(ts) <= end)
    deltas = counter_deltas(df, by, ts, value, rows)
    if start is not None:
        deltas = deltas.filter(F.col("us") > micros(start))
    return deltas.groupBy(*by).agg(
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase"),
        F.count_if("reset").alias("resets"),
    )


def counter_resets(df, by=SERIES, ts="ts", value="value", rows=ROWS_PER_PIECE) -> DataFrame:
    """The samples at which a counter fell, with the value before."""
    deltas = counter_deltas(df, by, ts, value, rows)
    return deltas.filter("reset").select(*by, "us", "before", "value")


def restarts(df, by=SERIES, ts="ts", value="value", rows=ROWS_PER_PIECE) -> DataFrame:
    """Restarts per container over all its samples: the first reading plus all growth since."""
    deltas = counter_deltas(df, by, ts, value, rows)
    first = F.when(F.col("before").isNull(), F.col("value")).otherwise(F.col("delta"))
    return deltas.groupBy(*by).agg(F.sum(first).alias("restarts"))


def max_over_series(
    df: DataFrame, step_s: int, by=("metric",), ts="ts", value="value"
) -> DataFrame:
    """Largest value over all series at each step."""
    step = step_start(micros(F.col(ts)), step_s).alias("step_us")
    return df.groupBy(*by, step).agg(F.max(value).alias("max_value"))


def pct_of_limit(
    usage: DataFrame,
    limits: DataFrame,
    step_s: int,
    by=(),
    ts="ts",
    value="value",
    lookback_s: int = 0,
    rows=ROWS_PER_PIECE,
) -> DataFrame:
    """Largest usage as percent of the largest limit. Both sides are aggregated to one row per step before they meet.

    The limit of a step is that of the newest step with one which began at most ``lookback_s`` seconds earlier, so the two
    sides may be scraped at different intervals; without a lookback both have to be in the same step. Steps without a
    limit are left out.
    """
    keys = [*by, "step_us"]
    used = max_over_series(usage, step_s, by, ts, value).withColumnRenamed("max_value", "used")
    limit = max_over_series(limits, step_s, by, ts, value).withColumnRenamed("max_value", "limit")
    if lookback_s < step_s:
        both = used.join(limit, keys)
    else:
        limit = limit.filter(F.col("limit").isNotNull())
        found = as_of(used, limit, list(by), "step_us", ["limit"], lookback_s * MICROS, rows=rows)
        both = found.filter(F.col("since").isNotNull()).select(*keys, "used", "limit")
    return both.withColumn("pct", percent(F.col("used"), F.col("limit")))


def latest(df: DataFrame, by=SERIES, ts="ts", value="value") -> DataFrame:
    """The newest value of each series."""
    return df.groupBy(*by).agg(
        F.max_by(value, ts).alias("value"), micros(F.max(ts)).alias("us")
    )


def current_total(df: DataFrame, over=("metric",), by=SERIES, ts="ts", value="value") -> DataFrame:
    """Sum of the newest values of all series, for example what runs now."""
    newest = latest(df, by, ts, value)
    return newest.groupBy(*over).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("series")
    )


def usage_series(df: DataFrame, step: str, by=SERIES, ts="ts", value="value") -> DataFrame:
    """Average and peak per series and time window."""
    return (
        df.groupBy(*by, F.window(F.col(ts).cast("timestamp"), step).alias("w"))
        .agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))
        .withColumn("step_us", F.unix_micros("w.start"))
        .drop("w")
    )


def net_rates(
    df: DataFrame,
    directions: dict[str, str],
    step_s: int,
    window_s: int,
    by=("series",),
    metric="metric",
    ts="ts",
    value="value",
    rows=ROWS_PER_PIECE,
) -> DataFrame:
    """Peak rate per series and step, one column per counter; ``directions`` maps metric to column."""
    wanted = df.filter(F.col(metric).isin(*directions))
    rates = counter_rate(wanted, window_s, (metric, *by), ts, value, rows)
    step = step_start(F.col("us"), step_s).alias("step_us")
    columns = [
        F.max(F.when(F.col(metric) == name, F.col("rate"))).alias(column)
        for name, column in directions.items()
    ]
    return rates.groupBy(*by, step).agg(*columns)


# Metric names behind the application dashboard's sections, as whole-string patterns.
SECTIONS = {
    "tasks": r"metrics_executor_.*[tT]asks.*",
    "memory": r"metrics_executor_(?:.*[mM]emory.*|rddBlocks)",
    "gc": r"metrics_executor_.*(?:GC|gc).*",
    "cores_disk": r"metrics_executor_(?:.*[cC]ores|diskUsed.*)",
    "block_manager": r".*_driver_BlockManager_.*",
    "dag_scheduler": r".*_driver_DAGScheduler_.*",
    "cpu": r".*_driver_.*(?:CPU|cpu).*",
    "streaming": r".*_driver_.*[sS]treaming.*",
    "listener_bus": r".*_driver_LiveListenerBus_.*",
}


def app_rollup(
    df: DataFrame,
    section: str | None = None,
    app_id: str | None = None,
    app="app",
    part="executor",
    metric="metric",
    ts="ts",
    value="value",
) -> DataFrame:
    """Last, peak and summed value per application, executor and metric of a section."""
    if app_id is not None:
        df = df.filter(F.col(app) == app_id)
    if section is not None:
        df = df.filter(whole_match(F.col(metric), SECTIONS.get(section, section)))
    return df.groupBy(app, part, metric).agg(
        F.max_by(value, ts).alias("last_value"),
        F.max(value).alias("peak"),
        F.sum(value).alias("total"),
        F.count(F.lit(1)).alias("samples"),
    )


def dashboard(
    df: DataFrame, sections: dict[str, str] = SECTIONS, app="app", part="executor", metric="metric", ts="ts", value="value"
) -> DataFrame:
    """``app_rollup`` of each section, with its name in ``section``; a metric may be in several. The table is read and
    grouped once, and only what is left of it goes to the sections."""
    name = F.col(metric)
    held = F.array_compact(F.array(*[F.when(whole_match(name, p), F.lit(s)) for s, p in sections.items()]))
    wanted = df.filter(reduce(or_, [whole_match(name, p) for p in sections.values()]))
    grouped = app_rollup(wanted, app=app, part=part, metric=metric, ts=ts, value=value)
    return grouped.withColumn("section", F.explode(held))


def variable_values(df: DataFrame, column: str) -> DataFrame:
    """The values a dashboard variable can take."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def scope(
    df: DataFrame,
    chosen: dict[str, list],
    start: Column | None = None,
    end: Column | None = None,
    ts="ts",
) -> DataFrame:
    """Rows of the chosen variable values within ``[start, end)``; an empty choice means all."""
    for column, values in chosen.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) < end)
    return df


def resample(df: DataFrame, step_s: int, by=SERIES, ts="ts", value="value") -> DataFrame:
    """Last sample of each series per step."""
    step = step_start(micros(F.col(ts)), step_s).alias("step_us")
    return df.groupBy(*by, step).agg(
        F.max_by(value, ts).alias("value"), F.count(F.lit(1)).alias("samples")
    )


def scrape_gaps(df, step_s: int, by=SERIES, ts="ts", rows=ROWS_PER_PIECE) -> DataFrame:
    """Runs of steps without any sample between two steps that have one."""
    step = step_s * MICROS
    seen = df.select(*by, step_start(micros(F.col(ts)), step_s).alias("step_us")).distinct()
    scan = ordered(seen, list(by), "step_us", rows=rows).previous(before_us="step_us").done()
    return scan.filter(F.col("step_us") - F.col("before_us") > step).select(
        *by,
        F.col("before_us").alias("last_seen_us"),
        F.col("step_us").alias("seen_again_us"),
        F.expr(f"(step_us - before_us) div {step} - 1").alias("missing"),
    )


def missing_steps(gaps: DataFrame, step_s: int, by=SERIES) -> DataFrame:
    """One row per missing step of the gaps."""
    step = step_s * MICROS
    first, last = F.col("last_seen_us") + step, F.col("seen_again_us") - step
    return explode_steps(gaps, first, last, step, "step_us").select(*by, "step_us")
