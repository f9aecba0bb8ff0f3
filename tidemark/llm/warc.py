"""Web archives: written as request, response or revisit, and metadata records, read back and put together again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, MapType, StringType, StructField, StructType

END = "\r\n"
#: Payloads of at least this many bytes are stored once.
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Control characters and spaces cannot stand in a header."""
    clean = F.regexp_replace(value, r"[\x00-\x20\x7f]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def _record(kind: Column, record_id: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """A record without its last two line ends, which the writer puts between records."""
    lines = [
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", record_id),
        _header("WARC-Date", F.lit(DATE)),
        *headers,
        F.lit(f"Content-Type: {content_type}{END}"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    ]
    return F.concat(*lines)


def captures(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """Rows ``(key, url, payload, size, digest, kind, first_key, first_url)``: among equal payloads of at least ``least`` bytes
    those with the largest key are responses, the others revisit them.

    Only digests that occur more than once are joined, one row each, counted on the map side; a payload that many
    pages share is one skewed key of an equality join, which adaptive execution splits.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.col("size") >= least).groupBy("digest")
    first = large.agg(
        F.count(F.lit(1)).alias("n"), F.max("key").alias("first_key"), F.max_by("url", "key").alias("first_url")
    )
    joined = rows.join(first.where("n > 1").drop("n"), "digest", "left")
    again = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return joined.select(
        "key",
        "url",
        "payload",
        "size",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first_key")).alias("first_key"),
        F.when(again, F.col("first_url")).alias("first_url"),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = LEAST_BYTES,
) -> None:
    """Write three records for each row to compressed archives in ``path``, an archive for each task.

    A request and a metadata record name the response or revisit they belong to in WARC-Concurrent-To. The response
    holds the payload in UTF-8 with an HTTP head, a revisit only the head and the target it refers to; the metadata
    record holds the row's key. A null payload is empty, a null URL or key has no header line or field. Among rows
    that tie on the largest key all are responses. Repeated rows are captures of their own: record ids are drawn at
    random when the archive is written, once. Other columns are not read; an empty table makes an archive without records.
    """
    rows = captures(pages, key, url, payload, least).withColumn("id", F.expr("uuid()"))
    main = F.concat(F.lit("<urn:uuid:"), F.col("id"), F.lit(">"))

    def beside(kind: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), F.col("id"), F.lit(f"-{kind}>"))

    target = _header("WARC-Target-URI", F.col("url"))
    with_main = _header("WARC-Concurrent-To", main)
    path_of = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("/"))
    request = _record(
        F.lit("request"),
        beside("request"),
        [target, with_main],
        "application/http; msgtype=request",
        F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{END}{END}")),
    )
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(END + END),
    )
    again = F.col("kind") == "revisit"
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = _record(
        F.col("kind"),
        main,
        [
            target,
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _header("WARC-Profile", profile),
            _header("WARC-Refers-To-Target-URI", F.col("first_url")),
            _header("WARC-Refers-To-Date", F.when(again, F.lit(DATE))),
        ],
        "application/http; msgtype=response",
        F.when(again, head).otherwise(F.concat(head, F.col("payload"))),
    )
    fields = F.concat(
        _header("page-id", F.col("key").cast("string")),
        _header("payload-bytes", F.col("size").cast("string")),
        _header("refers-to-page-id", F.col("first_key").cast("string")),
    )
    metadata = _record(F.lit("metadata"), beside("metadata"), [target, with_main], "application/warc-fields", fields)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("record"))
    records.write.option("lineSep", END + END).option("compression", "gzip").text(path)


RECORD = StructType(
    [
        StructField("record_id", StringType()),
        StructField("type", StringType()),
        StructField("concurrent_to", StringType()),
        StructField("headers", MapType(StringType(), StringType())),
        StructField("head", StringType()),
        StructField("payload", BinaryType()),
    ]
)


def _lines(rows: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in rows:
        yield from batch.column(0).to_pylist()


def parse_records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of records in lines without their ``\\n``. The block is as long as
    Content-Length says, whatever it holds; only one record is in memory."""
    for line in lines:
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        for line in lines:
            if line in (b"\r", b""):
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        wanted = int(headers.get("content-length", "0"))
        block, size = [], 0
        while size < wanted:
            part = next(lines, None)
            if part is None:
                break
            block += [part, b"\n"]
            size += len(part) + 1
        yield headers, b"".join(block)[:wanted]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``: ``record_id``, ``type``, ``concurrent_to``, all ``headers`` by lower-case
    name, the HTTP ``head`` of a request, response or revisit, and the ``payload`` after it (the whole block of
    other records). A compressed archive is read by one task as a stream of lines."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(RECORD)
        rows, size = [], 0
        for headers, block in parse_records(_lines(batches)):
            head = None
            if headers.get("content-type", "").startswith("application/http"):
                first, _, block = block.partition(b"\r\n\r\n")
                head = first.decode("utf-8", "replace")
            rows.append(
                {
                    "record_id": headers.get("warc-record-id"),
                    "type": headers.get("warc-type"),
                    "concurrent_to": headers.get("warc-concurrent-to"),
                    "headers": list(headers.items()),
                    "head": head,
                    "payload": block,
                }
            )
            size += len(block)
            if size > 4 << 20 or len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return lines.mapInArrow(run, RECORD)


def fields_of(payload: Column) -> Column:
    """The fields of an ``application/warc-fields`` block as a map."""
    return F.str_to_map(payload.cast("string"), F.lit("\r\n"), F.lit(": "))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``main`` (the response, revisit or resource), ``requests`` and
    ``metadata``, arrays of the records that name it in WARC-Concurrent-To.

    All columns of ``records`` go into the nested records. A record that names no capture of the archive makes a
    row with a null ``main``; records without any id are rows of their own under a null id only if several lack
    one. Groups are as large as one capture. An empty archive gives no rows.
    """
    whole = F.struct(*records.columns)
    secondary = F.col("type").isin("request", "metadata")
    capture = F.when(secondary, F.coalesce("concurrent_to", "record_id")).otherwise(F.col("record_id"))
    return records.groupBy(capture.alias("capture_id")).agg(
        F.first(F.when(~secondary, whole), ignorenulls=True).alias("main"),
        F.collect_list(F.when(F.col("type") == "request", whole)).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", whole)).alias("metadata"),
    )
