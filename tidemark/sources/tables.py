"""Catalog tables: create, load, reset, scan, count, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class TooFewRows(RuntimeError):
    """The quality gate found fewer rows than required."""


def ensure_db(spark: SparkSession, db: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`{at}")


def ensure_table(spark: SparkSession, db: str, table: str, schema: str, location: str) -> None:
    """External parquet table at a location; the schema is DDL, for example ``id INT, name STRING``."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{db}`.`{table}` ({schema}) USING PARQUET LOCATION '{location}'"
    )


def append_rows(df: DataFrame, db: str, table: str) -> None:
    """Append by column position. A second run appends again; see ``load_table``."""
    df.write.insertInto(f"`{db}`.`{table}`")


def load_table(df: DataFrame, db: str, table: str) -> None:
    """Replace the table's rows, so that a rerun leaves the same rows."""
    df.write.insertInto(f"`{db}`.`{table}`", overwrite=True)


def reset_table(spark: SparkSession, db: str, table: str) -> None:
    """Remove all rows and files below the table's location, however many there are.

    TRUNCATE refuses external tables, so an empty overwrite does it.
    """
    name = f"`{db}`.`{table}`"
    spark.createDataFrame([], spark.table(name).schema).write.insertInto(name, overwrite=True)


def table_scan(spark: SparkSession, db: str, table: str) -> DataFrame:
    return spark.table(f"`{db}`.`{table}`")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def require_rows(df: DataFrame, minimum: int = 1) -> DataFrame:
    """Hand the table back, or fail when it has fewer rows than required. Reads no more than that."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise TooFewRows(f"expected at least {minimum} rows, found {found}")
    return df


def load_checked(df: DataFrame, db: str, table: str, minimum: int = 1) -> int:
    """Replace the table's rows and return how many were written; fail where they are fewer than required.

    The writing job counts its rows itself (an observed metric), so neither the source nor the table is read for it.
    The rows stay written when the gate fails.
    """
    seen = Observation()
    load_table(df.observe(seen, F.count(F.lit(1)).alias("n")), db, table)
    found = seen.get["n"]
    if found < minimum:
        raise TooFewRows(f"expected at least {minimum} rows, wrote {found}")
    return found


def ensure_partitioned(
    spark: SparkSession, db: str, table: str, schema: str, location: str, partition_by: tuple[str, ...]
) -> None:
    """External parquet table partitioned on its last columns."""
    columns = ", ".join(partition_by)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{db}`.`{table}` ({schema}) USING PARQUET "
        f"PARTITIONED BY ({columns}) LOCATION '{location}'"
    )


def reload_partitions(df: DataFrame, db: str, table: str) -> None:
    """Replace the partitions that the rows belong to; all others stay as they are."""
    conf, mode = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(mode)
    conf.set(mode, "dynamic")  # an insert into a table does not read the writer's options
    try:
        df.write.insertInto(f"`{db}`.`{table}`", overwrite=True)
    finally:
        conf.set(mode, before)


def merged_scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files whose schemas grew over time, read with the union of their columns."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def save_table(df: DataFrame, db: str, table: str, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Default-format (parquet) table at a path, partitioned on the given columns."""
    writer = df.write.mode("overwrite").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(f"`{db}`.`{table}`")
