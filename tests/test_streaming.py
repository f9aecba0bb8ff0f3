from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.text import tokenize, word_count
from tidemark.streaming.alerts import stream_alerts
from tidemark.streaming.wordcount import (
    checkpoint_location,
    every,
    read_batches,
    stream_word_count_batches,
    sum_over_batches,
)

NOW = {"availableNow": True}


def run_words(spark, tmp_path, per_trigger=1):
    stream = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(str(tmp_path / "in"))
    query = stream_word_count_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
    query.awaitTermination()
    return read_batches(spark, str(tmp_path / "out"))


def counts(df):
    return {r.word: r.n for r in df.collect()}


def test_counts_start_anew_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a b a\n")
    (tmp_path / "in" / "2.txt").write_text("a\n\n")
    first = run_words(spark, tmp_path)
    assert first.select("batch_id").distinct().count() == 2
    assert sorted(r.n for r in first.filter("word = 'a'").collect()) == [1, 2]
    assert counts(sum_over_batches(first)) == {"a": 3, "b": 1, "": 1}
    # Nothing new: no batch runs, no line is counted twice.
    assert counts(sum_over_batches(run_words(spark, tmp_path))) == {"a": 3, "b": 1, "": 1}
    # Lines that arrive while the stream is down are counted after the restart.
    (tmp_path / "in" / "3.txt").write_text("b c\n")
    resumed = run_words(spark, tmp_path)
    assert counts(sum_over_batches(resumed)) == {"a": 3, "b": 2, "c": 1, "": 1}
    batch = word_count(tokenize(spark.read.text(str(tmp_path / "in"))))
    assert counts(sum_over_batches(resumed)) == counts(batch)


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    """A crash after the sink wrote but before the commit makes the same batch run again."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a b a\n")
    run_words(spark, tmp_path)
    for name in ("0", ".0.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    assert counts(sum_over_batches(run_words(spark, tmp_path))) == {"a": 2, "b": 1}


def test_settings(spark):
    assert every() == {"processingTime": "2 seconds"}
    assert checkpoint_location(spark, "words").endswith("/words")


BASE = 1_700_000_040


def test_alerts_of_stream_and_batch(spark, tmp_path):
    def sample(second, metric, value):
        return (BASE + second, metric, value)

    waves = [
        [sample(0, "use", 95.0), sample(5, "cap", 100.0), sample(70, "use", 10.0), sample(75, "cap", 100.0)],
        [sample(130, "use", 99.0), sample(131, "cap", 100.0), sample(400, "use", 1.0)],
        # Older than the watermark by now (400 - 60 s): dropped, the first window stays as it was.
        [sample(2, "use", 100.0), sample(600, "cap", 1.0)],
        [sample(700, "cap", 1.0)],
    ]

    def frame(rows):
        df = spark.createDataFrame(rows, "s bigint, metric string, value double")
        return df.select(F.timestamp_seconds("s").alias("ts"), "metric", "value")

    def fired(df):
        return stream_alerts(df, F.col("metric") == "use", F.col("metric") == "cap")

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = frame(waves[0]).schema
    for wave in waves:
        frame(wave).coalesce(1).write.mode("append").parquet(source)
        query = (
            fired(spark.readStream.schema(schema).parquet(source))
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append")
            .trigger(**NOW)
            .start()
        )
        query.awaitTermination()
    got = sorted((r.step_us // 1_000_000 - BASE, r.pct) for r in spark.read.parquet(out).collect())
    assert got == [(0, 95.0), (120, 99.0)]
    timely = [row for wave in waves for row in wave if row[0] != BASE + 2]
    batch = sorted((r.step_us // 1_000_000 - BASE, r.pct) for r in fired(frame(timely)).collect())
    assert batch == got
