"""Counted and partial loads, runtime pruning, sketches, and many signatures in one scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logs, sketches
from tidemark.plans import reports
from tidemark.session import apply_settings, scratch_path, scratch_root
from tidemark.sources import tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    apply_settings(spark)
    db = "tidemark_tables"
    tables.ensure_db(spark, db, scratch_path(spark, "tables-db"))
    location = scratch_path(spark, "table")
    return db, "t_" + location.rsplit("-", 1)[-1], location


def test_counted_load(spark, table):
    db, name, location = table
    tables.ensure_table(spark, db, name, "id BIGINT", location)
    assert tables.load_checked(spark.range(1000), db, name, 1000) == 1000
    assert tables.load_checked(spark.range(10), db, name) == 10
    with pytest.raises(tables.TooFewRows, match="wrote 3"):
        tables.load_checked(spark.range(3), db, name, 4)
    with pytest.raises(tables.TooFewRows):
        tables.load_checked(spark.range(0), db, name)
    assert tables.table_scan(spark, db, name).count() == 0


def test_partial_load(spark, table):
    db, name, location = table
    tables.ensure_partitioned(spark, db, name, "id BIGINT, day INT", location, ("day",))
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    first = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("day"))
    tables.reload_partitions(first, db, name)
    for _ in range(2):
        tables.reload_partitions(spark.range(500, 503).select("id", F.lit(2).alias("day")), db, name)
    tables.reload_partitions(first.limit(0), db, name)
    found = tables.table_scan(spark, db, name)
    expected = {(i, i % 4) for i in range(100) if i % 4 != 2} | {(i, 2) for i in range(500, 503)}
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_folders_are_pruned_at_run_time(spark):
    df = reports.pruned_by_region(apply_settings(spark), SMALL)
    assert "dynamicpruning" in df._jdf.queryExecution().toString().lower()


def test_sketches_merge(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(20), draw.choice(["hot", "hot", "x"]), draw.randrange(3000), draw.gauss(0, 50)) for _ in range(20_000)]
    rows += [(1, "x", None, None)]
    df = spark.createDataFrame(rows, "day int, grp string, id long, v double")
    daily = sketches.sketched(df, ["grp", "day"], "id", "v")
    assert daily.count() == len({(g, d) for d, g, *_ in rows})
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    found = {r["grp"]: r for r in sketches.estimated(sketches.merged(daily, ["grp"]), ["grp"], shares).collect()}
    for grp in ("hot", "x"):
        own = [r for r in rows if r[1] == grp]
        ids = len({r[2] for r in own if r[2] is not None})
        values = sorted(r[3] for r in own if r[3] is not None)
        assert found[grp]["n"] == len(own)
        assert abs(found[grp]["distinct"] - ids) <= 4 * sketches.DISTINCT_ERROR * ids + 1
        for name, q in shares.items():
            rank = sum(v <= found[grp][name] for v in values) / len(values)
            assert abs(rank - q) <= 2 * sketches.RANK_ERROR + 1 / len(values)
    total = sketches.estimated(sketches.merged(sketches.merged(daily, ["grp"]), []), [], shares).collect()
    assert total[0]["n"] == len(rows)


CATALOGUE = [
    (1, "java.nio.file.AccessDeniedException: ./work"),
    (2, "Serving admission request"),
    (3, "OOM"),
    (4, "x: y: z"),
    (5, "100%"),
    (5, "lost executor 7"),
    (6, "ss"),
]


def issues(spark, lines, catalogue):
    df = spark.createDataFrame(lines, "app string, value string")
    return logs.known_issues(df, spark.createDataFrame(catalogue, "issue long, signature string"))


def test_known_issues(spark):
    lines = [
        ("a", "at java.nio.file.AccessDeniedException: ./work/x OOMKilled"),
        ("a", "Serving admission requests, Serving admission request"),
        ("b", "BOOM 100% lost executor 70, lost executor 7"),
        ("b", "x: y: z x: y: z"),
        ("b", None),
        ("b", ""),
        (None, "OOM"),
        ("c", "Serving  admission request"),
    ]
    good = CATALOGUE[:-1]
    found = {tuple(r) for r in issues(spark, lines, [*good, good[0]]).collect()}
    expected = {}
    for app, value in lines:
        for issue, signature in good:
            if value and signature in value:
                expected[app, issue, signature] = expected.get((app, issue, signature), 0) + 1
    assert found == {(*k, n) for k, n in expected.items()}
    with pytest.raises(Exception, match="at least 3 letters"):
        issues(spark, lines, CATALOGUE).collect()


def test_a_thousand_signatures_take_one_scan(spark, tmp_path):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdef", k=3)) for _ in range(120)]
    lines = [(draw.choice(["hot", "hot", "a"]), " ".join(draw.choices(words, k=12))) for _ in range(600)]
    catalogue = [(i, " ".join(draw.choices(words, k=draw.choice([1, 2, 3])))) for i in range(1000)]
    path = str(tmp_path / "lines")
    spark.createDataFrame(lines, "app string, value string").write.parquet(path)
    df = spark.read.parquet(path)
    found = logs.known_issues(df, spark.createDataFrame(catalogue, "issue long, signature string"))
    expected = {}
    for app, value in lines:
        for issue, signature in catalogue:
            if signature in value:
                expected[app, issue, signature] = expected.get((app, issue, signature), 0) + 1
    assert {tuple(r) for r in found.collect()} == {(*k, n) for k, n in expected.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Cartesian" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize(("bound", "piece"), [(logs.BROADCAST_BYTES, 4096), (logs.BROADCAST_BYTES, 8), (3000, 8), (0, 8)])
def test_known_issues_of_any_cut(spark, monkeypatch, bound, piece):
    monkeypatch.setattr(logs, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(logs, "PIECE", piece)
    draw = random.Random(3)
    letters = "aab  _é€\U0001f600#0\t\n"
    lines = [(draw.choice(["a", "b", None]), "".join(draw.choices(letters, k=draw.randint(0, 60)))) for _ in range(200)]
    lines += [lines[0], lines[0], ("a", None), ("b", " ".join(["over and over again"] * 9))]
    texts = [value for _, value in lines if value and len(value) >= 15]
    catalogue = [(1, "over and over"), (2, "over and over"), (None, "and over again over")]
    for i in range(150):
        value, size = draw.choice(texts), draw.randint(3, 15)
        at = draw.randint(0, len(value) - size)
        catalogue.append((i % 40, value[at : at + size]))
    expected = {}
    for app, value in lines:
        for issue, signature in set(catalogue):
            if value and signature in value:
                expected[app, issue, signature] = expected.get((app, issue, signature), 0) + 1
    found = [tuple(r) for r in issues(spark, lines, catalogue).collect()]
    assert len(found) == len(expected) and set(found) == {(*k, n) for k, n in expected.items()}


def test_known_issues_shuffle_no_lines(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        found = issues(spark, [("a", "Serving admission request")], CATALOGUE[:-1])
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [key" in plan and "SortMergeJoin [key" not in plan
    monkeypatch.setattr(logs, "BROADCAST_BYTES", 0)
    found = issues(spark, [("a", "Serving admission request")], CATALOGUE[:-1])
    assert [tuple(r) for r in found.collect()] == [("a", 2, "Serving admission request", 1)]


def test_known_issues_of_no_catalogue(spark):
    assert issues(spark, [("a", "Serving admission request")], []).collect() == []


def test_known_issues_beyond_a_broadcast_store_no_lines(spark, monkeypatch):
    monkeypatch.setattr(logs, "BROADCAST_BYTES", 0)
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 9))) for _ in range(3000)]
    lines = [("a", " ".join(draw.choices(words, k=800))) for _ in range(400)]
    catalogue = [(i, " ".join(value.split(" ")[3:7])) for i, (_, value) in enumerate(lines)]
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    used = lambda: files.getContentSummary(folder).getLength() if files.exists(folder) else 0
    before = used()
    found = issues(spark, lines, catalogue)
    assert found.count() == len({signature for _, signature in catalogue})
    assert used() - before < 0.05 * sum(len(value) for _, value in lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(piece" not in plan and "hashpartitioning(hash" not in plan


@pytest.mark.parametrize("piece", [4096, 100])
def test_known_issues_of_any_length_beyond_a_broadcast(spark, monkeypatch, piece):
    monkeypatch.setattr(logs, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(logs, "PIECE", piece)
    draw = random.Random(9)
    lines = [(draw.choice(["a", None]), "".join(draw.choices("ab é€\U0001f600", k=draw.choice([0, 2, 7, 600, 1700])))) for _ in range(40)]
    lines += [(app, value[:900] + value[:900]) for app, value in lines[:10]] + [("b", None)]
    texts = [value for _, value in lines if value and len(value) >= 600]
    catalogue = [(i, texts[i % len(texts)][at : at + size]) for i in range(120) for at, size in [(draw.randint(0, 1400), draw.choice([3, 4, 8, 24, 31, 32, 33, 600]))]]
    catalogue = [(i, signature) for i, signature in catalogue if len(signature) >= 3] + [(500, texts[0][-20:]), (501, texts[0][-20:] + "b" * 5)]
    expected = {}
    for app, value in lines:
        for issue, signature in set(catalogue):
            if value and signature in value:
                expected[app, issue, signature] = expected.get((app, issue, signature), 0) + 1
    found = [tuple(r) for r in issues(spark, lines, catalogue).collect()]
    assert len(found) == len(expected) and set(found) == {(*k, n) for k, n in expected.items()}
