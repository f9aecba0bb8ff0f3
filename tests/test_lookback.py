"""Lookback joins, open intervals, exact rates: against plain versions, with and without hot keys cut."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, rules
from tidemark.operators.lookback import as_of, open_intervals, peak_per_step

MICROS = 1_000_000
CUTS = pytest.mark.parametrize("rows", [5_000_000, 7])


def hot_rows(n, seed):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "b", None]), draw.randrange(400), draw.randrange(1000)) for _ in range(n)]


@CUTS
@pytest.mark.parametrize("within", [None, 0, 15])
def test_as_of(spark, rows, within):
    left, right = hot_rows(120, 1), hot_rows(60, 2)
    left += [("c", 5, 1), ("a", None, 2)]
    right += [("a", 10, 3), ("a", 10, 9), ("b", None, 4)]
    ldf = spark.createDataFrame(left, "k string, us long, v long")
    rdf = spark.createDataFrame(right, "k string, us long, w long")
    found = as_of(ldf, rdf, ["k"], "us", ["w"], within, rows=rows)
    assert found.columns == ["k", "us", "v", "since", "w"]
    expected = []
    for k, us, v in left:
        known = [(t, w) for j, t, w in right if j == k and t is not None and us is not None and t <= us]
        best = max(known, default=(None, None))
        if best[0] is None or (within is not None and us - best[0] > within):
            best = (None, None)
        expected.append((k, us, v, *best))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


def test_as_of_without_rows(spark):
    some = spark.createDataFrame([("a", 1, 2)], "k string, us long, v long")
    none = some.limit(0).withColumnRenamed("v", "w")
    assert [tuple(r) for r in as_of(some, none, ["k"], "us", ["w"]).collect()] == [("a", 1, 2, None, None)]
    assert as_of(some.limit(0), none, ["k"], "us", ["w"]).count() == 0


def test_limits_scraped_less_often(spark):
    """Usage every 5 s, its limit every 30 s: within the lookback every step has a limit, after it none."""
    at = [(F.timestamp_seconds(F.lit(s)), "u", 95.0) for s in range(0, 600, 5)]
    usage = spark.createDataFrame([(s, 95.0) for s in range(0, 600, 5)], "s long, value double")
    limits = spark.createDataFrame([(s, 100.0) for s in range(0, 300, 30)], "s long, value double")
    usage, limits = (df.select(F.timestamp_seconds("s").alias("ts"), "value") for df in (usage, limits))
    assert len(at) == 120
    steps = [r.step_us // MICROS for r in metrics.pct_of_limit(usage, limits, 5, lookback_s=60).collect()]
    assert sorted(steps) == list(range(0, 335, 5))
    assert metrics.pct_of_limit(usage, limits, 5).count() == 10
    looked = metrics.pct_of_limit(usage, limits, 5, lookback_s=rules.LOOKBACK_S)
    assert {r.pct for r in looked.collect()} == {95.0} and looked.count() == 115


@CUTS
def test_open_intervals_and_peaks(spark, rows):
    draw = random.Random(3)
    spans = []
    for _ in range(150):
        start = draw.randrange(0, 500)
        spans.append((draw.choice(["a", "a", "b", None]), start * MICROS, draw.choice([None, start + draw.randrange(-3, 90)])))
    spans = [(k, s, e if e is None else e * MICROS) for k, s, e in spans] + [("b", None, 5)]
    df = spark.createDataFrame(spans, "k string, s long, e long")
    valid = [(k, s, e) for k, s, e in spans if s is not None and (e is None or e > s)]

    def open_at(k, us):
        return sum(1 for j, s, e in valid if j == k and s <= us and (e is None or us < e))

    swept = open_intervals(df, F.col("s"), F.col("e"), ["k"], rows=rows)
    got = {(r.k, r.us): r.open for r in swept.collect()}
    changes = {(k, us) for k, s, e in valid for us in (s, e) if us is not None}
    assert got == {(k, us): open_at(k, us) for k, us in changes if open_at(k, us) != open_at(k, us - 1)}

    peaks = {(r.k, r.step_us): r.peak for r in peak_per_step(swept, 20, ["k"], rows=rows).collect()}
    expected = {}
    for k in {k for k, *_ in valid}:
        last = max(us for j, us in got if j == k)
        for step in range(0, last + 1, 20 * MICROS):
            inside = range(step, min(step + 20 * MICROS, last + 1), MICROS)
            top = max(open_at(k, us) for us in inside)
            if top:
                expected[k, step] = top
    assert peaks == expected


def test_open_intervals_of_all(spark):
    df = spark.createDataFrame([(0, 10, 2), (5, None, 3), (10, 12, 1)], "s long, e long, cores long")
    swept = open_intervals(df, F.col("s"), F.col("e"), [], weight=F.col("cores"))
    assert sorted(tuple(r) for r in swept.collect()) == [(0, 2), (5, 5), (10, 4), (12, 3)]
    assert sorted(tuple(r) for r in peak_per_step(swept, 1, []).collect()) == [(0, 5)]


@CUTS
def test_rates_of_any_size(spark, rows):
    """Growths of 1e20 and 1e-10 in one series are each given in full once the others have left the window."""
    growths = [1e-10, 3e-10, 1e20, 2.5e-10, 1e-10, 0.1, 7e15, 1e-7, 1e-10, 0.0, 1e30, 1e-9]
    # a counter that restarts at each sample, so that each value is a growth of its own
    values = [5.0]
    for g in growths:
        values += [g, 0.0]
    data = [("m", "s", i * 10, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "metric string, series string, t long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = {r.us // MICROS: (r.increase, r.rate) for r in metrics.counter_rate(df, 20, rows=rows).collect()}
    before = None
    deltas = []
    for *_, t, v in data:
        deltas.append((t, None if before is None else (v if v < before else v - before)))
        before = v
    for t, d in deltas:
        if d is None:
            assert got[t] == (None, None)
            continue
        exact = sum((Fraction(x) for u, x in deltas if x is not None and t - 20 < u <= t), Fraction(0))
        assert got[t][0] == pytest.approx(float(exact), rel=1e-15, abs=0)
        assert got[t][1] == got[t][0] / 20
    assert min(x for x, _ in got.values() if x) < 2e-10


def test_rates_beyond_the_bound(spark):
    data = [("m", "s", 10 * i, v) for i, v in enumerate([0.0, 1.0, 1e200, 1e200 + 0, 1e200])]
    df = spark.createDataFrame(data, "metric string, series string, t long, value double")
    found = metrics.counter_rate(df.withColumn("ts", F.timestamp_seconds("t")), 20).orderBy("us").collect()
    assert [r.increase for r in found] == [None, 1.0, float("inf"), float("inf"), 0.0]


def test_components_are_found_once_for_each_label_set(spark):
    labels = [{"namespace": "ns", "pod": f"op-1.web-{i}", "image": "i", "container": "c"} for i in range(3)]
    rows = [("m", labels[i % 3], float(i)) for i in range(300)] + [("m", {"pod": "other"}, 1.0), ("n", labels[0], 1.0)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double")
    components = {"Web": rules.Component("web", "op-web", "op", "ns"), "Op": rules.Component("", "op", "op", "ns")}
    found = rules._used(df, "m", components)
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()} == {("Web", 300), ("Op", 300)}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
