"""Event logs of Spark applications: scan, application list, summaries, retention.

Input is one JSON event per row: ``app string, value string``. Each report reads only the event types it
needs and parses only the fields it uses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Event names of the log format.
APP_START = "SparkListenerApplicationStart"
APP_END = "SparkListenerApplicationEnd"
JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_END = "SparkListenerTaskEnd"
EXECUTOR_ADDED = "SparkListenerExecutorAdded"
EXECUTOR_REMOVED = "SparkListenerExecutorRemoved"
SQL_START = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart"
SQL_END = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd"

# Fields of the log format.
APP_FIELDS = """`App Name` string, `App ID` string, `Timestamp` bigint, `User` string"""
JOB_FIELDS = """`Job ID` bigint, `Submission Time` bigint, `Completion Time` bigint,
  `Stage IDs` array<bigint>, `Job Result` struct<`Result`:string>"""
STAGE_FIELDS = """`Stage Info` struct<`Stage ID`:bigint, `Stage Attempt ID`:bigint, `Stage Name`:string,
  `Number of Tasks`:bigint, `Submission Time`:bigint, `Completion Time`:bigint, `Failure Reason`:string>"""
TASK_FIELDS = """`Stage ID` bigint, `Stage Attempt ID` bigint,
  `Task Info` struct<`Launch Time`:bigint, `Finish Time`:bigint, `Executor ID`:string, `Host`:string,
    `Failed`:boolean>,
  `Task Metrics` struct<`Executor Run Time`:bigint, `JVM GC Time`:bigint,
    `Input Metrics`:struct<`Bytes Read`:bigint, `Records Read`:bigint>>"""
EXECUTOR_FIELDS = """`Timestamp` bigint, `Executor ID` string,
  `Executor Info` struct<`Host`:string, `Total Cores`:bigint>, `Removed Reason` string"""
SQL_FIELDS = """`executionId` bigint, `description` string, `time` bigint, `errorMessage` string"""


def eventlog_scan(spark: SparkSession, path: str) -> DataFrame:
    """All event logs below a directory. The application is the log file's name, or for a rolling
    log (``events_<n>_...`` files) its folder's name; ``seq`` numbers the files of a rolling log."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.element_at(parts, -1)
    rolled = name.rlike(r"^events_\d+_")
    app = F.when(rolled, F.element_at(parts, -2)).otherwise(name)
    return raw.filter(F.col("value") != "").select(
        F.url_decode(F.regexp_replace(app, r"^eventlog_v2_|\.inprogress$", "")).alias("app"),
        F.coalesce(
            F.when(rolled, F.regexp_extract(name, r"^events_(\d+)_", 1).cast("bigint")), F.lit(0)
        ).alias("seq"),
        "value",
    )


def events_of(lines: DataFrame, kinds: list[str], fields: str) -> DataFrame:
    """Events of the given types: the application and the given fields as columns.

    ``inline`` makes the parsed event a row source of its own, so each line is parsed once; as a plain
    projection the optimizer would parse the line again for every field a report uses.
    """
    # The substring test is cheap and drops most lines before any JSON is parsed.
    named = reduce(lambda a, b: a | b, [F.col("value").contains(kind) for kind in kinds])
    parsed = F.from_json("value", f"`Event` string, {fields}")
    return (
        lines.filter(named)
        .select("app", F.inline(F.array(parsed)))
        .filter(F.col("Event").isin(*kinds))
    )


def _field(*path: str) -> Column:
    return F.col(".".join(f"`{name}`" for name in path))


def _when(kind: str, *path: str) -> Column:
    return F.when(F.col("Event") == kind, _field(*path))


def app_list(lines: DataFrame) -> DataFrame:
    """Applications with start, end and duration in ms; no end event means still running.

    One aggregate over both event types instead of a join of the two.
    """
    return (
        events_of(lines, [APP_START, APP_END], APP_FIELDS)
        .groupBy("app")
        .agg(
            F.max(_when(APP_START, "App Name")).alias("name"),
            F.max(_when(APP_START, "User")).alias("user"),
            F.min(_when(APP_START, "Timestamp")).alias("start_ms"),
            F.max(_when(APP_END, "Timestamp")).alias("end_ms"),
        )
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .withColumn(
            "state", F.when(F.col("end_ms").isNull(), F.lit("RUNNING")).otherwise(F.lit("COMPLETED"))
        )
    )


def job_summary(lines: DataFrame) -> DataFrame:
    return (
        events_of(lines, [JOB_START, JOB_END], JOB_FIELDS)
        .groupBy("app", _field("Job ID").alias("job"))
        .agg(
            F.min(_when(JOB_START, "Submission Time")).alias("submitted_ms"),
            F.max(_when(JOB_END, "Completion Time")).alias("completed_ms"),
            F.max(F.size(_when(JOB_START, "Stage IDs"))).alias("stages"),
            F.max(_when(JOB_END, "Job Result", "Result")).alias("result"),
        )
        .withColumn("duration_ms", F.col("completed_ms") - F.col("submitted_ms"))
    )


def stage_summary(lines: DataFrame) -> DataFrame:
    def info(name: str) -> Column:
        return _field("Stage Info", name)

    return (
        events_of(lines, [STAGE_COMPLETED], STAGE_FIELDS)
        .groupBy("app", info("Stage ID").alias("stage"), info("Stage Name").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.sum(info("Number of Tasks")).alias("tasks"),
            F.sum(info("Completion Time") - info("Submission Time")).alias("busy_ms"),
            F.count(info("Failure Reason")).alias("failed_attempts"),
        )
    )


def task_summary(lines: DataFrame) -> DataFrame:
    """Tasks per stage attempt: counts, times, approximate median and 95th percentile."""
    run = _field("Task Metrics", "Executor Run Time")
    took = _field("Task Info", "Finish Time") - _field("Task Info", "Launch Time")
    return (
        events_of(lines, [TASK_END], TASK_FIELDS)
        .groupBy(
            "app", _field("Stage ID").alias("stage"), _field("Stage Attempt ID").alias("attempt")
        )
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.count_if(_field("Task Info", "Failed")).alias("failed"),
            F.sum(run).alias("run_ms"),
            F.avg(took).alias("avg_ms"),
            F.max(took).alias("max_ms"),
            F.percentile_approx(took, [0.5, 0.95]).alias("p50_p95_ms"),
            F.sum(_field("Task Metrics", "Input Metrics", "Bytes Read")).alias("input_bytes"),
        )
    )


def executor_summary(lines: DataFrame) -> DataFrame:
    """Executors with start, end and its reason (null while they run), host, cores and work done, in one pass over the
    three event types."""
    task_end = F.col("Event") == TASK_END
    executor = F.when(task_end, _field("Task Info", "Executor ID")).otherwise(_field("Executor ID"))
    host = F.when(task_end, _field("Task Info", "Host")).otherwise(_field("Executor Info", "Host"))

    def total(*path: str) -> Column:
        return F.coalesce(F.sum(_field(*path)), F.lit(0))

    return (
        events_of(lines, [EXECUTOR_ADDED, EXECUTOR_REMOVED, TASK_END], f"{EXECUTOR_FIELDS}, {TASK_FIELDS}")
        .groupBy("app", executor.alias("executor"))
        .agg(
            F.max(host).alias("host"),
            F.min(_when(EXECUTOR_ADDED, "Timestamp")).alias("added_ms"),
            F.max(_when(EXECUTOR_REMOVED, "Timestamp")).alias("removed_ms"),
            F.max(_when(EXECUTOR_REMOVED, "Removed Reason")).alias("reason"),
            F.max(_field("Executor Info", "Total Cores")).alias("cores"),
            F.count_if(task_end).alias("tasks"),
            F.count_if(task_end & _field("Task Info", "Failed")).alias("failed"),
            total("Task Metrics", "Executor Run Time").alias("run_ms"),
            total("Task Metrics", "JVM GC Time").alias("gc_ms"),
            total("Task Metrics", "Input Metrics", "Bytes Read").alias("input_bytes"),
        )
    )


def sql_summary(lines: DataFrame) -> DataFrame:
    error = _when(SQL_END, "errorMessage")
    return (
        events_of(lines, [SQL_START, SQL_END], SQL_FIELDS)
        .groupBy("app", _field("executionId").alias("execution"))
        .agg(
            F.max(_when(SQL_START, "description")).alias("description"),
            F.min(_when(SQL_START, "time")).alias("started_ms"),
            F.max(_when(SQL_END, "time")).alias("ended_ms"),
            F.max(F.when(error != "", error)).alias("error"),
        )
        .withColumn("duration_ms", F.col("ended_ms") - F.col("started_ms"))
        .withColumn(
            "state",
            F.when(F.col("ended_ms").isNull(), F.lit("RUNNING"))
            .when(F.col("error").isNotNull(), F.lit("FAILED"))
            .otherwise(F.lit("COMPLETED")),
        )
    )


def retain_last(files: DataFrame, n: int = 5, app="app", seq="seq") -> DataFrame:
    """The newest ``n`` files of each application. Spark keeps only ``n`` rows per application and
    task before the shuffle, so an application with many files does not gather in one task."""
    newest = Window.partitionBy(app).orderBy(F.desc(seq))
    return files.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)
