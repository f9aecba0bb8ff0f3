"""Scans: text, JSON, integer range, record value, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import table_bytes


def text_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)


def json_scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines. Without a schema Spark infers one, which reads the data twice."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def range_source(spark: SparkSession, n: int, slices: int) -> DataFrame:
    """``id`` 0 .. n-1 in ``slices`` partitions, made on the executors."""
    return spark.range(0, n, 1, slices)


def record_value(records: DataFrame) -> DataFrame:
    """The value of keyed stream records as text."""
    return records.select(F.col("value").cast("string").alias("value"))


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """Print the first rows and hand the table back."""
    df.show(n)
    return df


#: A larger scan is read as it lies.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small scan's rows out by a unique key when it has fewer splits than the session has cores.

    For costly work per row on a file of one row group. Only a scan of at most SPREAD_BYTES is shuffled, whatever
    the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if table_bytes(df) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
