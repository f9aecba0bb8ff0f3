"""Streams joined with streams, sessions, and the stream's results against those of the batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import states

BASE = 1_700_000_040


def frame(spark, rows):
    df = spark.createDataFrame(rows, "s bigint, k string, metric string, value double")
    return df.select(F.timestamp_seconds(F.col("s") + BASE).alias("ts"), "k", "metric", "value")


def of(df, metric):
    return df.filter(F.col("metric") == metric)


def run(spark, tmp_path, waves, build):
    """The stream after all waves, stopped and resumed between them."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = frame(spark, waves[0]).schema
    for wave in waves:
        frame(spark, wave).coalesce(1).write.mode("append").parquet(source)
        states.run_available(build(spark.readStream.schema(schema).parquet(source)), out, str(tmp_path / "cp"))
    return spark.read.parquet(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def closed(df, end_s):
    return df.filter(F.col("step_us") + 60_000_000 <= (end_s + BASE) * 1_000_000)


WAVES = [
    [(0, "a", "ready", 2.0), (1, "a", "want", 2.0), (30, "a", "ready", 1.0), (5, "b", "want", 3.0), (70, "b", "ready", 1.0)],
    [(75, "a", "ready", 2.0), (76, "a", "want", 2.0), (80, "b", "want", 2.0), (200, "a", "want", 1.0)],
    [(390, "b", "ready", 0.0), (391, "b", "want", 1.0), (392, "a", "want", 1.0)],
    [(600, "a", "ready", 1.0), (601, "a", "want", 1.0)],
    [(700, "a", "ready", 1.0), (701, "a", "want", 1.0)],
]


def test_degraded(spark, tmp_path):
    def build(df):
        return states.stream_degraded(of(df, "ready"), of(df, "want"), ["k"])

    batch = build(frame(spark, [r for wave in WAVES for r in wave]))
    assert [(k, (us - BASE * 10**6) // 10**6, r, w) for k, us, r, w in rows(batch)] == [
        ("a", 0, 1.0, 2.0), ("b", 60, 1.0, 2.0), ("b", 360, 0.0, 1.0)
    ]
    found = run(spark, tmp_path, WAVES, build)
    assert rows(found) == rows(closed(batch, 700 - 60))


def test_absent(spark, tmp_path):
    def build(df):
        return states.stream_absent(df, of(df, "ready"), ["k"])

    batch = build(frame(spark, [r for wave in WAVES for r in wave]))
    found = run(spark, tmp_path, WAVES, build)
    assert ("b", BASE * 10**6) in rows(batch) and rows(found) == rows(closed(batch, 700 - 60))


def test_late_rows_do_not_change_a_closed_window(spark, tmp_path):
    late = [*WAVES, [(31, "a", "ready", 9.0), (32, "b", "ready", 9.0), (900, "a", "ready", 1.0), (901, "a", "want", 1.0)]]

    def build(df):
        return states.stream_absent(df, of(df, "ready"), ["k"])

    found = rows(run(spark, tmp_path, late, build))
    assert ("b", BASE * 10**6) in found


@pytest.mark.parametrize("local", ["true", "false"])
def test_sessions(spark, tmp_path, local):
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", local)
    draw = random.Random(4)
    # a third of all rows belong to one key
    data = [(draw.randrange(4000), draw.choice(["hot", "hot", "a", "b", "c", None]), "m", 1.0) for _ in range(400)]
    df = frame(spark, data).repartition(5)
    expected = []
    for key in {k for _, k, *_ in data}:
        times = sorted(s for s, k, *_ in data if k == key)
        runs = [[times[0]]]
        for s in times[1:]:
            if s - runs[-1][-1] <= 20:
                runs[-1].append(s)
            else:
                runs.append([s])
        expected += [(key, (r[0] + BASE) * 10**6, (r[-1] + BASE) * 10**6, len(r)) for r in runs]
    batch = states.sessions(df, ["k"], "20 seconds")
    assert rows(batch) == sorted(expected, key=repr)
    if local == "true":
        ordered = sorted(data, key=lambda r: r[0])
        waves = [ordered[:200], ordered[200:], [(9000, "end", "m", 1.0)]]
        found = run(spark, tmp_path, waves, lambda s: states.sessions(s, ["k"], "20 seconds", delay="1 minute"))
        assert rows(found) == sorted(expected, key=repr)
