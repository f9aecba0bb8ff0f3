from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import series_key
from tidemark.operators import alerts, latency, metrics
from tidemark.plans.queries import QUERIES

BASE = 1_700_000_000


def samples(spark, values, step=30, metric="m", series="a"):
    return spark.createDataFrame(
        [(metric, series, BASE + n * step, v) for n, v in enumerate(values)],
        "metric string, series string, s bigint, value double",
    ).select("metric", "series", F.timestamp_seconds("s").alias("ts"), "value")


def by_time(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("us").collect()]


def test_counter_with_reset(spark):
    df = samples(spark, [0.0, 5.0, 9.0, 2.0, 4.0])
    deltas = metrics.counter_deltas(df)
    assert [d for (d,) in by_time(deltas, "delta")] == [None, 5.0, 4.0, 2.0, 2.0]
    rates = metrics.counter_rate(df, 60)
    assert by_time(rates, "increase") == [(None,), (5.0,), (9.0,), (6.0,), (4.0,)]
    assert by_time(rates, "rate")[2] == (9.0 / 60,)
    resets = metrics.counter_resets(df).collect()
    assert [(r.before, r.value, r.us) for r in resets] == [(9.0, 2.0, (BASE + 90) * 1_000_000)]
    total = metrics.counter_increase(df).first()
    assert (total.increase, total.resets) == (13.0, 1)
    part = metrics.counter_increase(
        df, F.timestamp_seconds(F.lit(BASE + 30)), F.timestamp_seconds(F.lit(BASE + 90))
    ).first()
    assert (part.increase, part.resets) == (6.0, 1)
    assert metrics.restarts(samples(spark, [1.0, 3.0, 0.0, 2.0])).first().restarts == 5.0


@pytest.mark.parametrize("limit", [3, 40])
def test_hot_series_keeps_its_rates(spark, limit):
    ids = spark.range(1200)
    df = ids.select(
        F.lit("m").alias("metric"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("series"),
        F.timestamp_seconds(BASE + F.col("id") * 13).alias("ts"),
        (F.col("id") * 37 % 101).cast("double").alias("value"),
    )
    plain = sorted(map(tuple, metrics.counter_rate(df, 600).collect()))
    split = sorted(map(tuple, metrics.counter_rate(df, 600, rows=limit).collect()))
    assert repr(plain) == repr(split)
    assert min(r[-1] for r in plain if r[-1] is not None) >= 0
    gaps = [
        sorted(map(tuple, metrics.scrape_gaps(df, 13, rows=n).collect())) for n in (10_000, limit)
    ]
    assert gaps[0] == gaps[1] and gaps[0]


@pytest.mark.parametrize("share", [0.01, 0.5, 1.0, 5.0])
def test_pieces_of_any_window(spark, monkeypatch, share):
    """One series of many samples: no piece of the rate's timeline holds more than twice the limit."""
    from tidemark.operators import ordered as scans

    made = []
    place = scans._in_pieces

    def watched(*args):
        made.append(place(*args))
        return made[-1]

    monkeypatch.setattr(scans, "_in_pieces", watched)
    n, limit = 10_000, 500
    df = spark.range(n).select(
        F.lit("m").alias("metric"),
        F.lit("hot").alias("series"),
        F.timestamp_seconds(BASE + F.col("id") * 5).alias("ts"),
        (F.col("id") % 97).cast("double").alias("value"),
    )
    window = int(n * 5 * share)
    split = sorted(map(tuple, metrics.counter_rate(df, window, rows=limit).collect()))
    largest = [m.df.groupBy(scans.PIECE).count().agg(F.max("count")).first()[0] for m in made]
    assert len(largest) == 2 and max(largest) <= 2 * limit
    assert split == sorted(map(tuple, metrics.counter_rate(df, window).collect()))


def test_rates_recover_from_odd_samples(spark):
    """NaN, infinite and null samples are missing ones; what enters the sum leaves it exactly."""
    odd = [0.0, 1.0, 2.0, float("nan"), 4.0, float("inf"), 6.0, None, 8.0, 9.0]
    got = by_time(metrics.counter_rate(samples(spark, odd), 60), "increase")
    assert got == [(None,), (1.0,), (2.0,), (2.0,), (2.0,), (2.0,), (3.0,)]
    large = [0.0, 1e15, 1e15 + 0.25, 1e15 + 0.5, 1e15 + 0.75]
    assert by_time(metrics.counter_rate(samples(spark, large), 30), "increase")[2:] == [(0.25,)] * 3


def test_a_year_of_steps(spark):
    """Steps of 5 s over a year come in stretches, not in one value."""
    df = spark.createDataFrame([("m", "a", 0, 5 * 6_307_200 * 1_000_000)], "metric string, series string, last_seen_us bigint, seen_again_us bigint")
    steps = metrics.missing_steps(df, 5)
    assert steps.agg(F.count("*"), F.min("step_us"), F.max("step_us")).first() == (6_307_199, 5_000_000, 5 * 6_307_199 * 1_000_000)


def test_matchers(spark):
    df = spark.createDataFrame(
        [
            (1, {"pod": "op-controller-abc", "container": "main", "image": "i"}),
            (2, {"pod": "op-controller-abc", "container": "POD", "image": "i"}),
            (3, {"pod": "op-controller-abc", "container": "main", "image": ""}),
            (4, {"pod": "x-op-controller-abc", "container": "main", "image": "i"}),
            (5, {"pod": "op-webhook", "container": "main", "image": "i"}),
            (6, {"container": "main", "image": "i"}),
        ],
        "id int, labels map<string,string>",
    )

    def ids(**tests):
        return sorted(r.id for r in metrics.match_labels(df, **tests).collect())

    unequal = {"image": "", "container": "POD"}
    assert ids(unequal=unequal, pattern={"pod": "op.*controller.*"}) == [1]
    assert ids(pattern={"pod": "op.*controller"}) == []
    assert ids(equal={"pod": ""}) == [6]
    assert ids() == [1, 2, 3, 4, 5, 6]


def test_series_key_ignores_order(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},)], "l map<string,string>")
    assert df.select(series_key(F.col("l")).alias("k")).distinct().count() == 1


def test_percent_of_limit_and_alert(spark):
    usage = samples(spark, [50.0, 95.0, 99.0, 10.0], 60)
    limit = samples(spark, [100.0, 100.0, 0.0, None], 60)
    pct = metrics.pct_of_limit(usage, limit, 60)
    got = [r.pct for r in pct.orderBy("step_us").collect()]
    assert got == [50.0, 95.0, None, None]
    fired = alerts.threshold_alert(pct, service="s").collect()
    assert [(r.pct, r.severity, r.service) for r in fired] == [(95.0, "warning", "s")]
    assert alerts.threshold_alert(pct, pct=40).count() == 2


def test_states_and_episodes(spark):
    df = samples(spark, [1.0, 9.0, 9.0, 1.0, 9.0, 1.0, 1.0], 60)
    hits = metrics.max_over_series(df, 60).filter("max_value > 5")
    grid = alerts.evaluation_grid(df, 60, ["metric"])
    states = alerts.alert_states(hits, grid, ["metric"])
    got = [r.state[0] for r in states.orderBy("step_us").collect()]
    assert "".join(got) == "iffifii"
    last = (BASE + 6 * 60) // 60 * 60 * 1_000_000
    for limit in (100, 2):
        changes = alerts.alert_transitions(hits, ["metric"], 60, last, rows=limit).orderBy("step_us")
        assert [r.to_state for r in changes.collect()] == ["firing", "inactive"] * 2
        runs = alerts.alert_episodes(hits, ["metric"], 60, rows=limit).orderBy("start_us").collect()
        assert [(r.steps, r.seconds) for r in runs] == [(2, 60.0), (1, 0.0)]
    cut = alerts.alert_transitions(hits, ["metric"], 60, last - 2 * 60_000_000)
    assert [r.to_state for r in cut.orderBy("step_us").collect()] == ["firing", "inactive", "firing"]
    none = alerts.evaluation_grid(df.limit(0), 60, ["metric"])
    assert none.count() == 0


def test_degraded_absent_health(spark):
    ready = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "rs string, ready double")
    wanted = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0)], "rs string, wanted double")
    assert [r.rs for r in alerts.degraded(ready, wanted, ["rs"]).collect()] == ["a"]
    expected = spark.createDataFrame([("x",), ("y",)], "c string")
    seen = spark.createDataFrame([("x",), ("x",)], "c string")
    assert [r.c for r in alerts.absent(expected, seen, ["c"]).collect()] == ["y"]
    assert alerts.absent(expected, seen.limit(0), ["c"]).count() == 2
    pods = spark.createDataFrame(
        [("a", "Running", None), ("a", "Failed", None), ("b", "Failed", True), ("c", "Running", False)],
        "app string, phase string, dep boolean",
    )
    got = alerts.health(pods, ["app"], F.col("phase") == "Running", F.col("dep"))
    assert {r.app: r.status for r in got.collect()} == {"a": "UP", "b": "DOWN", "c": "DEGRADED"}
    counts = alerts.pod_counts(pods, ["app"]).filter("app = 'a'").first()
    assert (counts.pods, counts.active, counts.failed, counts.pending) == (2, 1, 1, 0)


def test_reached_within(spark):
    rows = [("a", 0, "inactive"), ("a", 200, "firing"), ("b", 0, "inactive"), ("b", 400, "firing"), ("c", 0, "x")]
    df = spark.createDataFrame(rows, "k string, s bigint, state string").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = alerts.reached_within(df, ["k"], "firing", 300).collect()
    assert {r.k: (r.seconds, r.in_time) for r in got} == {
        "a": (200.0, True),
        "b": (400.0, False),
        "c": (None, False),
    }


def test_gauges_and_grid(spark):
    a, b = samples(spark, [1.0, 2.0, 3.0], 30), samples(spark, [10.0, 7.0], 30, series="b")
    both = a.unionByName(b)
    total = metrics.current_total(both).first()
    assert (total.total, total.series) == (10.0, 2)
    steps = metrics.resample(a, 60).orderBy("step_us").collect()
    assert [(r.value, r.samples) for r in steps] == [(2.0, 2), (3.0, 1)] or sum(r.samples for r in steps) == 3
    sparse = samples(spark, [1.0, 2.0], 300)
    gaps = metrics.scrape_gaps(sparse, 60)
    assert [r.missing for r in gaps.collect()] == [4]
    assert metrics.missing_steps(gaps, 60).count() == 4
    assert metrics.scrape_gaps(a, 30).count() == 0
    window = metrics.usage_series(samples(spark, [1.0, 3.0], 1), "1 day").first()
    assert (window.avg_value, window.max_value) == (2.0, 3.0)


def test_rollup_and_scope(spark):
    rows = [
        ("app1", "1", "metrics_executor_totalTasks_total", 1, 3.0),
        ("app1", "1", "metrics_executor_totalTasks_total", 2, 8.0),
        ("app1", "1", "metrics_executor_memoryUsed_bytes", 1, 70.0),
        ("app2", "1", "metrics_executor_totalTasks_total", 1, 5.0),
    ]
    df = spark.createDataFrame(rows, "app string, executor string, metric string, ts bigint, value double")
    got = metrics.app_rollup(df, "tasks", "app1").collect()
    assert [(r.last_value, r.peak, r.total, r.samples) for r in got] == [(8.0, 8.0, 11.0, 2)]
    assert metrics.app_rollup(df, "memory").count() == 1
    assert {r.app for r in metrics.variable_values(df, "app").collect()} == {"app1", "app2"}
    assert metrics.scope(df, {"app": ["app1"], "executor": []}, F.lit(1), F.lit(2)).count() == 2


def test_dashboard_groups_once(spark):
    names = [
        "metrics_executor_totalTasks_total", "metrics_executor_memoryTasks", "metrics_executor_diskUsed_bytes",
        "a_driver_BlockManager_cpu", "a_driver_cpu", "other", None,
    ]
    rows = [(f"app{k % 2}", k % 3, name, k, float(k)) for k in range(30) for name in names]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "app string, executor bigint, metric string, ts bigint, value double")
    expected = {(s, *r) for s in metrics.SECTIONS for r in metrics.app_rollup(df, s).collect()}
    found = metrics.dashboard(df)
    got = [(r.section, *r[:-1]) for r in found.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert {s for s, *r in got if "metrics_executor_memoryTasks" in r} == {"tasks", "memory"}
    query = QUERIES["dashboard_rollup"](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_network_rates(spark):
    got = metrics.net_rates(
        samples(spark, [0.0, 60.0, 180.0], metric="rx").unionByName(
            samples(spark, [0.0, 30.0, 30.0], metric="tx")
        ),
        {"rx": "receive", "tx": "transmit"},
        step_s=86_400,
        window_s=30,
    ).first()
    assert (got.receive, got.transmit) == (4.0, 1.0)


def test_durations(spark):
    rows = [("a", 0, 5, 25, "ok"), ("b", 0, 15, 20, "ok"), ("c", 0, 2, None, "failed"), ("d", 0, None, None, "failed")]
    df = spark.createDataFrame(rows, "app string, s bigint, t bigint, e bigint, outcome string").select(
        "app",
        "outcome",
        *[F.timestamp_seconds(c).alias(n) for c, n in (("s", "submitted"), ("t", "started"), ("e", "ended"))],
    )
    runs = latency.with_durations(df)
    got = {r.outcome: (r.mean_s, r.n) for r in latency.mean_duration(runs, ["outcome"], "run_s").collect()}
    assert got == {"ok": (12.5, 2), "failed": (None, 0)}
    buckets = latency.latency_histogram(runs, [10, 5], "latency_s").orderBy("le").collect()
    assert [(r.le, r.n, r.cumulative) for r in buckets] == [(5.0, 2, 2), (10.0, 0, 2), (float("inf"), 1, 3)]
