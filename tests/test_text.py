from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.sampling import inside_circle, pi_estimate
from tidemark.operators.text import save_pairs, tokenize, word_count
from tidemark.sources.basic import json_scan, preview, range_source, record_value, text_scan
from tidemark.sources.kafka import kafka_options
from tidemark.sources import tables

# Line and the words a split on single spaces gives (trailing empty words are dropped).
EDGE_LINES = {
    "a b  ": ["a", "b"],
    "": [""],
    "   ": [],
    " a  b": ["", "a", "", "b"],
    "x\t": ["x\t"],
    "one, two, two": ["one,", "two,", "two"],
}


def test_tokens_of_edge_lines(spark):
    df = spark.createDataFrame([(line,) for line in EDGE_LINES], "value string")
    got = {r[0]: r[1] for r in df.select("value", tokens(F.col("value"))).collect()}
    assert got == EDGE_LINES


def test_counts_keep_commas(spark):
    df = spark.createDataFrame([("one, two, two, three, three, three",)], "value string")
    got = {r.word: r.n for r in word_count(tokenize(df)).collect()}
    assert got == {"one,": 1, "two,": 2, "three,": 2, "three": 1}


def test_pairs_are_written_once(spark, tmp_path):
    counts = spark.createDataFrame([("a", 2), ("", 1)], "word string, n bigint")
    path = str(tmp_path / "out")
    save_pairs(counts, path)
    assert sorted(r.value for r in text_scan(spark, path).collect()) == ["(,1)", "(a,2)"]
    assert (tmp_path / "out" / "_SUCCESS").exists()
    with pytest.raises(AnalysisException):
        save_pairs(counts, path)


def test_json_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "value": "1"}\n{"name": "y"}\n')
    for schema in (None, "name string, value string"):
        got = json_scan(spark, str(tmp_path), schema).select("name", "value").collect()
        assert sorted(map(tuple, got)) == [("x", "1"), ("y", None)]


def test_range_and_record_value(spark):
    ids = range_source(spark, 10, 3)
    assert ids.rdd.getNumPartitions() == 3
    assert [r.id for r in ids.collect()] == list(range(10))
    records = ids.select(F.lit(b"k").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    assert [r.value for r in record_value(records).collect()] == [str(i) for i in range(10)]


def test_pi(spark):
    row = pi_estimate(spark, slices=4, seed=3).first()
    assert row.points == 400_000
    assert abs(row.pi - 3.14159) < 0.02
    flags = inside_circle(spark.range(1000), 1)
    assert flags.filter((F.col("x") < -1) | (F.col("x") > 1)).count() == 0


def test_preview(spark, capsys):
    df = spark.range(30)
    assert preview(df, 5) is df
    assert "only showing top 5 rows" in capsys.readouterr().out


def test_kafka_options():
    assert kafka_options() == {
        "kafka.bootstrap.servers": "kafka.kafka-service:9092",
        "subscribe": "spark-streaming-test",
        "kafka.group.id": "spark-streaming-word-count",
    }
    secured = kafka_options("b:1", "t1, t2", "g", "SASL_PLAINTEXT", "SCRAM-SHA-512", "login;")
    assert secured["subscribe"] == "t1,t2"
    assert secured["kafka.security.protocol"] == "SASL_PLAINTEXT"
    assert secured["kafka.sasl.jaas.config"] == "login;"


def test_table_life(spark, tmp_path):
    tables.ensure_db(spark, "t_db", str(tmp_path / "db"))
    tables.ensure_db(spark, "t_db")
    where = str(tmp_path / "tab")
    tables.ensure_table(spark, "t_db", "people", "id INT, name STRING", where)
    tables.ensure_table(spark, "t_db", "people", "id INT, name STRING", where)
    rows = spark.createDataFrame([(1, "James"), (2, "Ann")], "id int, name string")
    scan = tables.table_scan(spark, "t_db", "people")
    with pytest.raises(tables.TooFewRows):
        tables.require_rows(scan)
    tables.append_rows(rows, "t_db", "people")
    tables.append_rows(rows, "t_db", "people")
    spark.catalog.refreshTable("t_db.people")
    assert tables.row_count(tables.table_scan(spark, "t_db", "people")).first().n == 4
    tables.reset_table(spark, "t_db", "people")
    assert tables.table_scan(spark, "t_db", "people").count() == 0
    for _ in range(2):
        tables.load_table(rows, "t_db", "people")
    assert tables.require_rows(tables.table_scan(spark, "t_db", "people"), 2).count() == 2
    spark.sql("DROP DATABASE t_db CASCADE")


def test_merged_scan(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(2, 3).withColumn("x", F.lit(7)).write.parquet(str(tmp_path / "b"))
    got = tables.merged_scan(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(0, None), (1, None), (2, 7)]
