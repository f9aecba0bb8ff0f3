"""Where shared files go, and the settings the jobs expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Databases of tables that queries register on the way.
SCRATCH_DATABASES = ("tidemark_tables", "tidemark_reports")
_LOCAL_ROOTS: dict[str, str] = {}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

# The SQL settings the SQL server ships with. Schema merging reads every file's footer,
# so it stays a choice per scan (``merged_scan``); shuffle partitions are left to adaptive execution.
SQL_SETTINGS = {
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.hive.metastorePartitionPruning": "true",
    "spark.sql.sources.default": "parquet",
    "spark.sql.legacy.createHiveTableByDefault": "false",
}


def sql_session(spark: SparkSession, **overrides: str) -> SparkSession:
    """A session of its own (views and settings apart) for ad-hoc SQL with the shipped settings;
    an override replaces dots by two underscores: ``spark__sql__shuffle__partitions="50"``."""
    fresh = apply_settings(spark.newSession())
    given = {key.replace("__", "."): value for key, value in overrides.items()}
    for key, value in (SQL_SETTINGS | given).items():
        fresh.conf.set(key, value)
    return fresh


def apply_settings(spark: SparkSession) -> SparkSession:
    """Runtime settings the results depend on (time zone) or the plans count on (adaptive)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Input of one shuffle partition to start with: a task sorts it in memory with room to spare.
SHUFFLE_BYTES = 256 * 2**20
#: The optimizer gives a size beyond this for rows it knows nothing of.
KNOWN_BYTES = 1 << 60
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def table_bytes(df: DataFrame) -> int:
    """Size of a scan's files as the optimizer knows it; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Start shuffles with a partition per SHUFFLE_BYTES of input, at least as many as the session has set.

    Adaptive execution merges small partitions but never makes more than it starts with, so the session's
    200 would leave 500 GB to each task of a 100 TB shuffle. Scans call this with their size. The number only rises
    in a session, as queries that are built now may run after others are built; an unknown size leaves it. Returns it.
    """
    if input_bytes > KNOWN_BYTES:
        input_bytes = 0
    current = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL, None) or 0))
    number = max(current, -(-input_bytes // SHUFFLE_BYTES))
    if number > current:
        spark.conf.set(INITIAL, str(number))
    return number


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster; a fresh one only in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_ROOTS[app]


def use_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's files below the shared one."""
    return f"{shared_root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files a job writes on the way."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application's queries have written on the way, and the tables they registered. Results that
    have not been computed yet need those files, so this is for the caller who has taken them.
    Checkpoints go by themselves with ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    for db in SCRATCH_DATABASES:
        spark.sql(f"DROP DATABASE IF EXISTS `{db}` CASCADE")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
