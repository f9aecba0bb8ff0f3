from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, logs

HEAD = "24/01/0{} 10:00:0{} {} {}: {}"


def as_lines(spark, files):
    rows = [(f, n, v) for f, values in files.items() for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "file string, line_no bigint, value string")


DRIVER = [
    "orphan line",
    HEAD.format(1, 1, "INFO", "DAGScheduler", "Job 12 finished: took 3.5 s"),
    HEAD.format(1, 2, "ERROR", "TaskSetManager", "lost"),
    "Caused by: java.nio.file.AccessDeniedException: ./a.jar",
    "    at a.b.C(C.java:1)",
    HEAD.format(2, 3, "WARN", "X$", ""),
]


def test_records_take_their_traces(spark):
    lines = as_lines(spark, {"d1": DRIVER, "d2": ["24/01/01 10:00:00 INFO A: b"]})
    got = logs.parse_logs(lines).orderBy("file", "record_no").collect()
    assert [(r.file, r.record_no, r.level, r.logger, r.message, r.trace_lines) for r in got] == [
        ("d1", 1, "INFO", "DAGScheduler", "Job 12 finished: took 3.5 s", 0),
        ("d1", 2, "ERROR", "TaskSetManager", "lost", 2),
        ("d1", 5, "WARN", "X$", "", 0),
        ("d2", 0, "INFO", "A", "b", 0),
    ]
    assert [r.cause for r in got] == [None, DRIVER[3], None, None]
    trace = logs.trace_lines(lines).orderBy("line_no").collect()
    assert [(r.record_no, r.line_no, r.text) for r in trace] == [(2, 3, DRIVER[3]), (2, 4, DRIVER[4])]
    assert str(got[1].ts) == "2024-01-01 10:00:02"
    attached = logs.attach_lines(lines).filter("file = 'd1'").orderBy("line_no").collect()
    assert [r.record_no for r in attached] == [None, 1, 2, 2, 2, 5]


def test_long_files_are_read_in_splits(spark, tmp_path):
    """A trace that runs across many splits of its file still belongs to the record above it."""
    body = []
    for n in range(40):
        body.append(HEAD.format(1, n % 10, "INFO", "A", f"record {n}"))
        body += [f"  at step {n} {i} " + "x" * 30 for i in range(n)]
    (tmp_path / "long.log").write_text("\n".join(body) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = logs.log_scan(spark, str(tmp_path))
        assert lines.select("piece").distinct().count() > 5
        got = logs.parse_logs(lines).collect()
        traces = logs.trace_lines(lines).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((int(r.message.split()[1]), r.trace_lines) for r in got) == [(n, n) for n in range(40)]
    number = {r.record_no: int(r.message.split()[1]) for r in got}
    steps = [(number[r.record_no], *map(int, r.text.split()[2:4])) for r in traces]
    assert steps == [(n, n, i) for n in range(40) for i in range(n)]


def test_levels_and_signatures(spark):
    lines = as_lines(spark, {"d1": DRIVER, "d2": ["24/01/01 10:00:00 INFO A: Serving admission request"]})
    got = logs.log_levels(lines, "1 day").collect()
    assert sorted((r.level, r.n) for r in got) == [("ERROR", 1), ("INFO", 1), ("INFO", 1), ("WARN", 1)]
    hits = logs.signature_hits(lines, logs.ACCESS_DENIED, app="file").collect()
    assert [(r.file, r.hits) for r in hits] == [("d1", 1)]
    apps = spark.createDataFrame([("d1",), ("d2",), ("no log",)], "file string")
    missing = logs.signature_missing(lines, apps, logs.ADMISSION_LINE, app="file").collect()
    assert sorted(r.file for r in missing) == ["d1", "no log"]


def test_printed_batches(spark):
    rule = "-" * 43
    printed = [
        "(before,1)",
        "22/03/04 09:10:11 INFO Batches: twelve rows in",
        rule,
        "Time: 1646385011000 ms",
        rule,
        "(pear,5)",
        "(fig,8)",
        "(,2)",
        "",
        "22/03/04 09:10:12 INFO Batches: all rows are out",
        "(not a batch row,7)",
        rule,
        "Time: 1646385014000 ms",
        rule,
        "(a,b,4)",
    ]
    got = logs.parse_batches(as_lines(spark, {"f": printed})).collect()
    assert sorted((r.time_ms, r.word, r.n) for r in got) == [
        (1646385011000, "", 2),
        (1646385011000, "fig", 8),
        (1646385011000, "pear", 5),
        (1646385014000, "a,b", 4),
    ]


LOGIN = (
    "192.0.2.7:51000 - s{n} - {user} [2023/02/03 11:12:13] [AuthSuccess] Authenticated via OAuth2: "
    "Session{{email:{user} user:u1 PreferredUsername:{user} token:true id_token:true "
    "created:2023-02-03 11:12:13.250000111 +0000 UTC m=+7.125 "
    "expires:2023-02-03 {expires} +0000 UTC m=+67.5 refresh_token:true "
    "groups:[role:a role:b]}}."
)


@pytest.fixture(scope="module")
def audit_lines(spark):
    values = [
        LOGIN.format(n=1, user="ann@example.com", expires="11:22:13.250000111"),
        LOGIN.format(n=2, user="ann@example.com", expires="11:12:33.250000111"),
        "23/02/01 08:09:10 INFO HistoryServer: Bound HistoryServer to 0.0.0.0, and started at http://h:18080",
        "23/02/01 08:09:10 INFO Utils: Successfully started service 'HistoryServerUI' on port 18080.",
        "23/02/01 08:09:10 INFO Utils: something else",
    ]
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_audit_events(audit_lines):
    got = audit.audit_events(audit_lines)
    by_event = {r.event: r["count"] for r in got.groupBy("event").count().collect()}
    assert by_event == {"Login": 2, "create session": 2, "start/stop server-application": 2}
    login = got.filter("event = 'Login' AND session = 's1'").first()
    assert (login.ip, login.user, login.priority) == ("192.0.2.7", "ann@example.com", "High")
    assert login.groups == ["role:a", "role:b"]
    assert str(login.created) == "2023-02-03 11:12:13.250000"
    start = got.filter(F.col("priority") == "Low").first()
    assert str(start.ts) == "2023-02-01 08:09:10" and start.user is None


def test_audit_sessions(audit_lines):
    got = audit.audit_sessions(audit.audit_events(audit_lines)).collect()
    assert [(r.user, r.sessions, r.mean_s, r.longest_s) for r in got] == [
        ("ann@example.com", 2, 310.0, 600.0)
    ]
