from __future__ import annotations

import pytest

from tidemark import jobs
from tidemark.operators.logs import parse_batches
from tidemark.session import size_shuffles, sql_session
from tidemark.sources import tables
from tidemark.streaming.wordcount import print_word_count_batches


def test_pi_and_json(spark, tmp_path, monkeypatch, capsys):
    assert abs(jobs.estimate_pi(spark, "3") - 3.14) < 0.05
    assert "Pi is roughly 3." in capsys.readouterr().out
    (tmp_path / "t.json").write_text('{"name": "someone", "value": "v"}\n')
    monkeypatch.setenv("S3_JSON_FILE", str(tmp_path / "t.json"))
    jobs.show_json(spark)
    assert "someone" in capsys.readouterr().out


def test_words(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a b a\n")
    conf = spark.sparkContext._conf  # settings of a running context, set for the test only
    conf.set(jobs.INPUT, str(tmp_path / "in.txt")).set(jobs.OUTPUT, str(tmp_path / "out"))
    jobs.count_words(spark)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["(a,2)", "(b,1)"]


def test_table_check_can_run_again(spark, tmp_path):
    for _ in range(2):
        jobs.check_table(spark, "job_db", "people", str(tmp_path / "people"))
    assert tables.table_scan(spark, "job_db", "people").count() == 2
    spark.sql("DROP DATABASE job_db CASCADE")


def test_printed_batches_can_be_parsed(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(" ".join(f"w{n}" for n in range(12)) + " w0\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    print_word_count_batches(stream, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    shown = capsys.readouterr().out.splitlines()
    assert "..." in shown
    rows = [("out", n, line) for n, line in enumerate(shown)]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, value string")
    got = parse_batches(lines).collect()
    assert len(got) == 10 and all(r.word.startswith("w") and r.time_ms > 0 for r in got)


def test_sql_session_is_apart(spark):
    fresh = sql_session(spark, spark__sql__shuffle__partitions="50")
    assert fresh.conf.get("spark.sql.shuffle.partitions") == "50"
    assert fresh.conf.get("spark.sql.parquet.filterPushdown") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_shuffles_follow_the_input(spark):
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.shuffle.partitions", "200")
    assert size_shuffles(fresh, 10**9) == 200
    assert size_shuffles(fresh, 10**12) == 3726
    assert size_shuffles(fresh, 10**14) == 372_530
    assert fresh.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "372530"


def test_unknown_job():
    with pytest.raises(KeyError):
        jobs.main(["nothing"])
