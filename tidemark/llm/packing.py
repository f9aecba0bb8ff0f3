"""Concatenate-and-cut packing: prefix sums over the tasks' token totals, then windows of fixed length."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from tidemark.llm.shared import stored

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END, LENGTH = 0, 1024
#: Ids of one stored row; a longer document takes several rows.
CHUNK = 1 << 16
#: A run of white space from which on the ranks' word pattern would need too deep a stack.
_BLANK_RUN = re.compile(r"\s{2000}")


class Ids:
    """Ids of whole texts as the tokenizer file gives them.

    The ranks file holds the same vocabulary and the same word pattern and is several times faster; a text that
    holds the string of a special token or a long run of white space goes to the tokenizer file itself.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> None:
        self.whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.specials) or _BLANK_RUN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain.encode_to_numpy(text, disallowed_special=())


def _encoded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pass one: rows of at most CHUNK ids with their place in the document and in what their task has read."""
    schema = StructType(
        [
            StructField(key, docs.schema[key].dataType),
            StructField("part", IntegerType()),
            StructField("at", LongType()),
            StructField("start", LongType()),
            StructField("doc_tokens", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        ids, part, at = Ids(), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, took = [], []
            for k, text in enumerate(batch.column(1)):
                found = np.append(ids.encode(text.as_py()), np.uint32(END))
                for start in range(0, len(found), CHUNK):
                    took.append(k)
                    chunk = found[start : start + CHUNK].astype("<u4").tobytes()
                    rows.append((part, at + start, start, len(found), chunk))
                at += len(found)
            columns = [batch.column(0).take(pa.array(took, pa.int64())).cast(arrow.field(0).type)]
            columns += [pa.array([r[i] for r in rows], arrow.field(i + 1).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: key, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset``.

    Pass one encodes every text, ends it with id 0 and writes the ids once to the shared folder, each row with the
    ids its task had before it. Pass two adds the totals of the earlier tasks (a prefix sum over one row per task)
    and cuts at every multiple of ``length`` of the global offset, so only the last sequence is short. A document
    or sequence on a border between tasks is cut by its global offset like any other.

    A null or empty text is the single id 0. Null keys, repeated rows and repeated keys are packed row by row; other
    columns are not read; an empty table gives no pieces. Ids are stored in rows of at most 65,536, which may cut a
    long document once more within a sequence.
    """
    rows = stored(_encoded(docs, key, text), "packing-ids")
    totals = rows.groupBy("part").agg(F.sum(F.length("ids") / 4).cast("bigint").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task of pass one: a million tasks are 12 MB
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select(
        F.col(key), "start", "doc_tokens", (F.col("base") + F.col("at")).alias("place"), "ids"
    )
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = StructType(
        [
            StructField(key, docs.schema[key].dataType),
            *(StructField(n, LongType()) for n in names),
            StructField("ids", BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            took, rows, ids = [], [], []
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for k, (start, total, place) in enumerate(zip(*columns, strict=True)):
                data = batch.column(4)[k].as_buffer()
                n, i = data.size // 4, 0
                while i < n:
                    offset = (place + i) % length
                    size = min(length - offset, n - i)
                    took.append(k)
                    rows.append((start + i, size, total, (place + i) // length, offset))
                    ids.append(data.slice(4 * i, 4 * size).to_pybytes())
                    i += size
            out = [batch.column(0).take(pa.array(took, pa.int64())).cast(arrow.field(0).type)]
            out += [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())], schema=arrow)

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """Rows ``(sequence_id, ids, n)``: the sequence as an array of ``length`` ids, and how many are no padding.

    A sequence has at most ``length`` ids, so no group is large.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("data"),
        F.sum("length").alias("n"),
    )
    hexed = F.hex("data")
    ids = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.when(
            i < F.col("n"),
            F.conv(
                F.concat(*[F.substring(hexed, i * 8 + 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10
            ).cast("int"),
        ).otherwise(F.lit(pad)),
    )
    return joined.select("sequence_id", ids.alias("ids"), "n")
