"""What the operators on texts share: row-wise Arrow maps, byte-balanced batches, scratch tables, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.session import apply_settings, scratch_path, size_shuffles, table_bytes, use_checkpoint_dir

#: Rows of one Arrow batch: texts vary from a word to many MB, so batches hold few rows.
BATCH_ROWS = 1000
#: Bytes of text that one batch of work aims at.
BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession, *tables: DataFrame) -> SparkSession:
    """Session settings of the text operators, shuffles sized for the given tables, and a shared folder for what the
    operators write on the way."""
    apply_settings(spark)
    for df in tables:
        size_shuffles(spark, table_bytes(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    use_checkpoint_dir(spark)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.
    Shuffles after it are sized for it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    size_shuffles(df.sparkSession, table_bytes(read))
    read.stored_at = path
    for made in _MADE:
        made.append(read)
    return read


#: Lists that note the tables stored while they are open.
_MADE: list[list[DataFrame]] = []


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``build()``, stored; what it has stored on the way is deleted then. The driver lets go of the plans that
    have run, so that Spark removes their shuffle files too."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        rows = build()
    finally:
        _MADE.remove(made)
    spark = rows.sparkSession
    kept = stored(rows, name)
    dropped(*made)
    spark._jvm.System.gc()
    return kept


def is_drawn(rate: Column, *columns: str) -> Column:
    """Whether a row is in a sample of that rate, by a hash of its columns: the same rows wherever they are stored."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < rate * (1 << 30)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; ones that are gone already are passed over."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_bytes(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``limit`` bytes; a longer text is a list of its own."""
    held: list[str] = []
    size = 0
    for text in texts:
        more = len(text) if text.isascii() else len(text.encode())
        if held and size + more > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += more
    if held:
        yield held


@contextmanager
def keeping() -> Iterator[None]:
    """No search for reference cycles while a task fills its tables of small values, which hold none."""
    searched = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if searched:
            gc.enable()


def per_text(
    docs: DataFrame,
    key: str,
    text: str,
    fields: list[StructField],
    start: Callable[[], Callable[[list[str | None]], list[list]]],
) -> DataFrame:
    """One row per row: its key and the columns that ``start()(texts)`` gives for a list of texts.

    ``start`` runs once per task and returns the function, which keeps what it loads. Only the two columns are
    read, so other columns of ``docs`` can have any name; nothing is shuffled.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType, True), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        apply = start()
        for batch in batches:
            with keeping():
                columns = apply(batch.column(1).to_pylist())
            arrays = [batch.column(0).cast(arrow.field(0).type)]
            arrays += [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected links ``(a, b)`` between longs: rows ``(node, root)``, root the least node.

    Large-star and small-star rounds: each node links its larger neighbours, then its smaller ones, to the least
    node it sees, until no link changes. Every round aggregates on the map side before it shuffles, writes its
    links to the shared folder and compares a count and a checksum, so nothing but two numbers reaches the driver.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-links",
    )
    seen = None
    while True:
        least, before = _stars(links, larger=True), links
        links = stored(_stars(least, larger=False), f"{name}-links")
        dropped(before)
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One half round over links ``(a, b)`` with a > b: each node's larger neighbours (or its smaller ones and itself) are
    linked to the least of all it sees."""
    if larger:
        swapped = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = links.select(F.inline(F.array(F.struct("a", "b"), swapped)))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()
