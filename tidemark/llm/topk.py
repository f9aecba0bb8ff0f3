"""Exact top-k by inner product: term-at-a-time accumulation over blocks of queries and blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

K, SCALE = 10, 1024
#: Vectors of one block of rows and of one block of queries, and queries scored at a time.
ROWS, QUERIES, LANES = 4096, 1024, 32
#: Blocks of rows that one block of queries meets in one join key.
SPREAD = 8


def usable(key: str, vector: str) -> Column:
    """Rows that take part: neither the key nor the vector nor a component is null, all components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad


def scaled(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _pack(ids: list[int], vectors: list[list[int]]) -> tuple[bytes, int, bytes]:
    """Ids in ascending order, the longest vector's length, and 64-bit components, one term after the other; shorter
    vectors are filled with zeros."""
    order = np.argsort(np.array(ids), kind="stable")
    width = max(map(len, vectors))
    data = np.zeros((width, len(ids)), np.int64)
    for place, i in enumerate(order.tolist()):
        data[: len(vectors[i]), place] = vectors[i]
    return np.array(ids, np.int64)[order].tobytes(), width, data.tobytes()


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks ``(ids, width, data)`` of at most ``size`` of the ``(id, vector)`` rows of a task."""

    def block(ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        columns = [pa.array([x]) for x in _pack(ids, vectors)]
        columns[1] = columns[1].cast(pa.int32())
        return pa.RecordBatch.from_arrays(columns, names=["ids", "width", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield block(ids[:size], vectors[:size])
                ids, vectors = ids[size:], vectors[size:]
        if ids:
            yield block(ids, vectors)

    return rows.mapInArrow(run, "ids binary, width int, data binary")


def _grouped(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks ``(q, ids, width, data)`` of rows with distinct ids, dealt by a hash of the id."""

    def block(group: pa.Table) -> pa.Table:
        ids, width, data = _pack(group.column("id").to_pylist(), group.column("v").to_pylist())
        return pa.table(
            {
                "q": pa.array([group.column("q")[0].as_py()], pa.int32()),
                "ids": pa.array([ids]),
                "width": pa.array([width], pa.int32()),
                "data": pa.array([data]),
            }
        )

    dealt = rows.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("q").applyInArrow(block, "q int, ids binary, width int, data binary")


def accumulate(queries: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Scores of sparse query rows (query x term) over postings (term x row): each term scatters its weighted postings
    into the dense scores of the queries that have it. Rows without the term are left out of its postings."""
    scores = np.zeros((len(queries), terms.shape[1]), np.int64)
    for t in range(min(queries.shape[1], len(terms))):
        having = np.flatnonzero(queries[:, t])
        postings = np.flatnonzero(terms[t])
        if len(having) == 0 or len(postings) == 0:
            continue
        added = queries[having, t][:, None] * terms[t][postings][None, :]
        if len(postings) == terms.shape[1] and len(having) == len(queries):
            scores += added
        else:
            scores[np.ix_(having, postings)] += added
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; ids are in ascending order, so of equal scores the first places win."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def top_k(
    rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: for each query the ``k`` rows of the highest integer inner product of
    the vectors ``floor(scale * x)``, ties to the smaller key; all rows if there are fewer.

    Rows with the query's own key are no candidates. Rows that are null, hold a null or non-finite component or
    have a null key take no part. Vectors of different lengths count as filled with zeros; 64-bit arithmetic, so
    components beyond 2^31 wrap. A repeated query row is answered once; repeated rows are candidates each. Empty
    tables give no rows.

    Queries and rows are packed into blocks. Blocks meet in an equality join on (query block, share of the row
    blocks): a row block is sent once per query block, a query block once per share. Every pair of blocks gives at
    most k rows a query, and a window keeps the k best of those, cut on the map side first.
    """

    def whole(df: DataFrame) -> DataFrame:
        columns = F.col(key).cast("bigint").alias("id"), scaled(vector, scale).alias("v")
        return df.where(usable(key, vector)).select(*columns)

    asked = stored(whole(queries).dropDuplicates(["id"]), "queries")
    blocks = stored(_packed(whole(rows), ROWS), "row-blocks")
    query_blocks, n_blocks = max(1, -(-asked.count() // QUERIES)), blocks.count()
    shares = max(1, -(-n_blocks // SPREAD))
    q = stored(_grouped(asked, query_blocks), "query-blocks")
    left = q.select(
        "q",
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "data")],
    )
    right = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
        (F.rand(11) * shares).cast("int").alias("share"),
        "ids",
        "width",
        "data",
    )
    met = right.join(left, ["q", "share"]).select("q_ids", "q_width", "q_data", "ids", "width", "data")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                q_ids, q_width, q_data, ids, width, data = (x.as_py() for x in row)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                terms = np.frombuffer(data, np.int64).reshape(width, -1)
                sparse = np.frombuffer(q_data, np.int64).reshape(q_width, -1).T
                found = [[], [], []]
                for lane in range(0, len(q_ids), LANES):
                    dense = accumulate(np.ascontiguousarray(sparse[lane : lane + LANES]), terms)
                    for query, scores in zip(q_ids[lane : lane + LANES].tolist(), dense, strict=True):
                        own = np.searchsorted(ids, [query, query + 1])
                        if own[0] < own[1]:
                            use = np.concatenate([np.arange(own[0]), np.arange(own[1], len(ids))])
                            places = use[best(scores[use], ids[use], k)]
                        else:
                            places = best(scores, ids, k)
                        found[0] += [query] * len(places)
                        found[1] += ids[places].tolist()
                        found[2] += scores[places].tolist()
                columns = [pa.array(c, pa.int64()) for c in found]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    partial = met.mapInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
