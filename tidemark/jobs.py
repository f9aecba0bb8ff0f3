"""The sample programs as jobs: ``python -m tidemark.jobs <job> [args]`` or spark-submit of this file.

Paths and connections come from Spark settings or the environment, as the programs take them.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sampling import pi_estimate
from tidemark.operators.text import save_pairs, tokenize, word_count
from tidemark.sources import basic, kafka, tables
from tidemark.streaming.wordcount import checkpoint_location, print_word_count_batches

# Names of the settings and variables.
INPUT, OUTPUT = "spark.s3.input.file", "spark.s3.output.path"
JSON_FILE = "S3_JSON_FILE"
SLEEP_MS = "spark.thread.sleep"
KAFKA_SETTINGS = {
    "brokers": "spark.kafka.brokers",
    "group": "spark.kafka.groupId",
    "topics": "spark.kafka.topics",
    "protocol": "spark.kafka.securityProtocol",
    "mechanism": "spark.kafka.saslMechanism",
    "jaas": "spark.kafka.saslJaasConfig",
}


def count_words(spark: SparkSession) -> None:
    """Count the words of a text file and write ``(word,n)`` lines."""
    conf = spark.sparkContext.getConf()
    save_pairs(word_count(tokenize(basic.text_scan(spark, conf.get(INPUT)))), conf.get(OUTPUT))


def estimate_pi(spark: SparkSession, slices: str = "2") -> float:
    """Estimate pi from 100000 points per slice, after an optional pause."""
    time.sleep(int(spark.sparkContext.getConf().get(SLEEP_MS, "1")) / 1000)
    pi = pi_estimate(spark, int(slices)).first().pi
    print(f"Pi is roughly {pi}")
    return pi


def show_json(spark: SparkSession) -> None:
    """Show a JSON file."""
    basic.preview(basic.json_scan(spark, os.environ[JSON_FILE]))


def check_table(spark: SparkSession, db: str, table: str, location: str) -> None:
    """Create a table, empty it, write two rows, read them back; fails when none are read."""
    tables.ensure_db(spark, db)
    tables.ensure_table(spark, db, table, "id INT, name STRING", location)
    tables.reset_table(spark, db, table)
    rows = spark.createDataFrame([(1, "James"), (2, "Ann")], "id int, name string")
    tables.append_rows(rows, db, table)
    basic.preview(tables.require_rows(tables.table_scan(spark, db, table)))


def stream_words(spark: SparkSession) -> None:
    """Count the words of each micro-batch of a topic, resuming from the checkpoint."""
    conf = spark.sparkContext.getConf()
    given = {name: conf.get(key) for name, key in KAFKA_SETTINGS.items() if conf.get(key)}
    lines = basic.record_value(kafka.kafka_scan(spark, **given)).filter(F.col("value").isNotNull())
    print_word_count_batches(lines, checkpoint_location(spark, "topic-words")).awaitTermination()


JOBS = {
    "count-words": count_words,
    "estimate-pi": estimate_pi,
    "show-json": show_json,
    "check-table": check_table,
    "stream-words": stream_words,
}


def main(args: list[str]) -> None:
    job = JOBS[args[0]]
    spark = SparkSession.builder.appName(args[0]).getOrCreate()
    try:
        job(spark, *args[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
