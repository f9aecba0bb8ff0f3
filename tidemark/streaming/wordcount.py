"""Word counts per micro-batch, with restart."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import pair
from tidemark.operators.text import tokenize, word_count
from tidemark.session import shared_root

# Length of a micro-batch, and the setting that names the checkpoint folder.
BATCH_SECONDS = 2
CHECKPOINT_SETTING = "spark.checkpoint.directory"

# How a printed batch looks, and how many of its rows are shown.
RULE = "-" * 43
SHOWN = 10


def every(seconds: int = BATCH_SECONDS) -> dict[str, str]:
    """Trigger of fixed processing time, as arguments of ``trigger``."""
    return {"processingTime": f"{seconds} seconds"}


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Where a stream keeps its progress: below the named folder, else below the shared one."""
    named = spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    return f"{(named or shared_root(spark)).rstrip('/')}/{name}"


def stream_word_count_batches(
    lines: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Count the words of each micro-batch on its own and write them below ``out/batch_id=<n>``.

    Counts start anew with every batch. A batch that runs again after a crash overwrites its own folder,
    so with the checkpoint every input line is counted once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = word_count(tokenize(batch))
        counts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every()))
        .start()
    )


def print_word_count_batches(
    lines: DataFrame, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Count the words of each micro-batch and print its time and the first rows, as a look at the
    stream; the whole counts are ``stream_word_count_batches``."""

    def show(batch: DataFrame, batch_id: int) -> None:
        counts = word_count(tokenize(batch))
        rows = counts.select(pair(F.col("word"), F.col("n")).alias("p")).take(SHOWN + 1)
        print(RULE, f"Time: {time.time_ns() // 1_000_000} ms", RULE, sep="\n")
        print(*[r.p for r in rows[:SHOWN]], *["..."] * (len(rows) > SHOWN), "", sep="\n", flush=True)

    return (
        lines.writeStream.foreachBatch(show)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or every()))
        .start()
    )


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """The written counts with their ``batch_id``."""
    return spark.read.schema("word string, n bigint, batch_id bigint").parquet(out)


def sum_over_batches(batches: DataFrame) -> DataFrame:
    return batches.groupBy("word").agg(F.sum("n").alias("n"))
