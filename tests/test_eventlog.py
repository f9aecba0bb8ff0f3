from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import eventlog as ev


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    """One finished log, one cut before its end, one of a rolling log's folders."""
    root = tmp_path_factory.mktemp("events")
    app = Path(__file__).with_name("eventlog_app.py")
    subprocess.run([sys.executable, str(app), str(root)], check=True, capture_output=True, timeout=180)
    single = next(p for p in root.iterdir() if p.is_file())
    cut = root / "app-cut.inprogress"
    shutil.copy(single, cut)
    cut.write_text("\n".join(x for x in cut.read_text().splitlines() if ev.APP_END not in x) + "\n")
    return root


@pytest.fixture(scope="module")
def events(spark, log_dir):
    return ev.eventlog_scan(spark, str(log_dir)).cache()


def test_scan_names_applications(events, log_dir):
    apps = {r.app for r in events.select("app").distinct().collect()}
    assert len(apps) == 3 and "app-cut" in apps
    rolled = next(p for p in log_dir.iterdir() if p.is_dir()).name.removeprefix("eventlog_v2_")
    assert rolled in apps
    assert events.filter(F.col("app") == rolled).select("seq").distinct().first().seq == 1


def test_app_list(events):
    got = {r.app: r for r in ev.app_list(events).collect()}
    assert got["app-cut"].state == "RUNNING" and got["app-cut"].duration_ms is None
    done = [r for r in got.values() if r.app != "app-cut"]
    assert all(r.state == "COMPLETED" and r.name == "log source" and r.duration_ms > 0 for r in done)


def test_summaries_agree_with_each_other(events):
    jobs = ev.job_summary(events).collect()
    assert all(j.result in ("JobSucceeded", "JobFailed") and j.duration_ms >= 0 for j in jobs)
    stages = ev.stage_summary(events)
    per_app = {r.app: r.n for r in stages.groupBy("app").agg(F.sum("tasks").alias("n")).collect()}
    tasks = ev.task_summary(events)
    counted = {r.app: r.n for r in tasks.groupBy("app").agg(F.sum("tasks").alias("n")).collect()}
    assert per_app == counted and set(per_app.values()) == {max(per_app.values())}
    executors = ev.executor_summary(events).collect()
    assert {r.executor for r in executors} == {"driver"}
    assert {r.app: r.tasks for r in executors} == counted
    row = tasks.first()
    assert row.p50_p95_ms[0] <= row.p50_p95_ms[1] <= row.max_ms


def test_sql_summary(events):
    got = ev.sql_summary(events)
    states = {r.state for r in got.collect()}
    assert states == {"COMPLETED", "FAILED"}
    assert got.filter("state = 'FAILED'").first().error


def test_executors_that_ended(spark):
    import json

    events = [
        {"Event": ev.EXECUTOR_ADDED, "Timestamp": 5, "Executor ID": "1", "Executor Info": {"Host": "h", "Total Cores": 2}},
        {"Event": ev.EXECUTOR_ADDED, "Timestamp": 6, "Executor ID": "2", "Executor Info": {"Host": "h", "Total Cores": 2}},
        {"Event": ev.EXECUTOR_REMOVED, "Timestamp": 9, "Executor ID": "1", "Removed Reason": "lost"},
    ]
    lines = spark.createDataFrame([("a", json.dumps(e)) for e in events], "app string, value string")
    got = {r.executor: (r.host, r.added_ms, r.removed_ms, r.reason, r.tasks) for r in ev.executor_summary(lines).collect()}
    assert got == {"1": ("h", 5, 9, "lost", 0), "2": ("h", 6, None, None, 0)}


def test_retention(spark):
    rows = [("a", n) for n in range(1, 8)] + [("b", 1)]
    files = spark.createDataFrame(rows, "app string, seq bigint")
    kept = sorted((r.app, r.seq) for r in ev.retain_last(files, 5).collect())
    assert kept == [("a", n) for n in range(3, 8)] + [("b", 1)]
