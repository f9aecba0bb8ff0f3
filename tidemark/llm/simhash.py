"""Near-duplicate texts by SimHash, joined with the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidemark.llm.shared import components, per_text, stored

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Distinct fingerprints that candidate counts are estimated on, and how many of them are held against the rest.
SAMPLE, PROBES = 20_000, 1000
#: What one signature row costs, in candidate pairs.
ROW_COST = 2.0
#: Signature rows of one value beyond which its fingerprints are linked over centres: about as much work as all pairs.
CROWD = 5000
#: For each byte value, its eight bits, the highest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint as a signed long; 0 for a text without words.

    Words are runs of characters other than ASCII white space, A to Z in lower case. A bit is set if more than
    half of the shingle hashes have it, repeated shingles counted each time.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        values = np.array([hashed(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate([[0], ends[:-shingle]]).tolist()
        last = (ends[shingle - 1 :] - 1).tolist()
        spans = zip(first, last, strict=True)
        values = np.fromiter((hashed(joined[i:j], SEED) for i, j in spans), np.uint64, len(first))
    octets = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows ``(key, fp)``; null texts have fingerprint 0."""

    def start() -> Callable:
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return per_text(docs, key, text, [StructField("fp", LongType())], start)


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the fingerprint bits over all distinct fingerprints; each task sums its own
    co-occurrences, so 4,097 sums a task are shuffled and 4,097 reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            data = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(data, axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        values = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values)], names=["i", "n"])

    sums = fps.select("fp").mapInArrow(counted, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for row in sums.collect():
        flat[row["i"]] = row["n"]
    n = max(flat[-1], 1.0)
    both = flat[:-1].reshape(BITS, BITS) / n
    share = np.diag(both)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return np.abs((both - np.outer(share, share)) / np.outer(spread, spread))


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 the highest) in ``parts`` groups of almost equal size, correlated bits together: each group starts
    with the free bit most correlated to other free bits and takes the free bit closest to the group."""
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (correlation[b, rest].sum() - correlation[b, b], -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def probes_of(width: int, threshold: int) -> float:
    """Signature rows of one fingerprint: its own value, and those with 1 to ``threshold`` flipped bits; odd numbers
    of flips are needed from one of the two parities only."""
    return sum(comb(width, j) * (0.5 if j % 2 else 1.0) for j in range(threshold + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 leaves a part out) that add up to ``total`` at the least cost. ``costs[i][t + 1]`` is the cost
    of part i at threshold t. Dynamic programming over the parts and the sum so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for sum_, (cost, chosen) in best.items():
            for t, extra in enumerate(row, start=-1):
                found = following.get(sum_ + t)
                if found is None or cost + extra < found[0]:
                    following[sum_ + t] = (cost + extra, [*chosen, t])
        best = following
    return best[total]


def choose_parts(fps: DataFrame, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Bit groups and their thresholds. Two fingerprints within ``distance`` agree within the threshold in at least
    one group if the thresholds of m groups add up to ``distance - m + 1``; among 2 to ``distance + 1`` groups the
    cheapest estimate wins. Candidate counts come from a sample of at most SAMPLE fingerprints."""
    correlation = bit_correlation(fps)
    drawn = fps.select("fp").sample(min(1.0, SAMPLE / max(n, 1)), 7).limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in drawn], np.int64).view(np.uint64)
    options = []
    for m in range(2, distance + 2):
        groups = grouped_bits(correlation, m)
        costs = []
        for bits in groups:
            mask = np.uint64(mask_of(bits))
            near = np.zeros(distance + 1)
            for one in sample[:PROBES]:
                apart = np.bitwise_count((sample ^ one) & mask)
                near += np.bincount(apart[apart <= distance], minlength=distance + 1)
            tested = max(1, len(sample[:PROBES]) * (len(sample) - 1))
            near[0] -= len(sample[:PROBES])
            row = [0.0]
            for t in range(distance + 1):
                chance = sum(comb(len(bits), j) for j in range(t + 1)) / 2.0 ** len(bits)
                pairs = max(near[: t + 1].sum() / tested, chance) * n * n / 2
                row.append(pairs + ROW_COST * n * (1 + probes_of(len(bits), t)))
            costs.append(row)
        options.append((*allocate(costs, distance - m + 1), groups))
    _, thresholds, groups = min(options, key=lambda o: o[0])
    return list(zip(groups, thresholds, strict=True))


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Rows ``(part, value, fp, probe)``: each fingerprint's own bits of a group, and as probes the values with as
    many flipped bits as the group's threshold allows. Rows a fingerprint has depend on the thresholds alone."""
    plan = []
    for i, (bits, threshold) in enumerate(parts):
        if threshold >= 0:
            flips = [[mask_of(list(c)) for c in combinations(bits, j)] for j in range(1, threshold + 1)]
            plan.append((i, mask_of(bits), flips))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, mask, flips in plan:
                own = fp & np.uint64(mask)
                yield _rows(i, own, fp, False)
                even = np.bitwise_count(own) % 2 == 0
                for j, masks in enumerate(flips, start=1):
                    use = even if j % 2 else np.ones(len(fp), bool)
                    for k in range(0, len(masks), 64):
                        x = np.array(masks[k : k + 64], np.uint64)
                        yield _rows(i, (own[use][:, None] ^ x).ravel(), np.repeat(fp[use], len(x)), True)

    def _rows(part: int, value: np.ndarray, fp: np.ndarray, probe: bool) -> pa.RecordBatch:
        n = len(value)
        columns = [
            pa.array(np.full(n, part, np.int32)),
            pa.array(value.view(np.int64)),
            pa.array(fp.view(np.int64)),
            pa.array(np.full(n, probe)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "value", "fp", "probe"])

    return fps.select("fp").mapInArrow(made, "part int, value long, fp long, probe boolean")


def links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that differ in at most ``distance`` bits, each verified.

    All pairs, but for values that more than CROWD signature rows share: the fingerprints behind those are linked
    over centres (``crowd_links``), which leaves out pairs but no connection, and grows with their number alone.
    """
    rows = signatures(fps, choose_parts(fps, n, distance))
    shared = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowds = stored(shared.select("part", "value"), "simhash-crowds")
    if crowds.isEmpty():
        return _pairs(rows, distance)
    crowd = rows.join(crowds, ["part", "value"], "left_semi").select("fp").distinct()
    rest = rows.join(crowds, ["part", "value"], "left_anti")
    return _pairs(rest, distance).unionByName(crowd_links(stored(crowd, "simhash-crowd"), distance))


def _pairs(rows: DataFrame, distance: int) -> DataFrame:
    own = rows.where("not probe").select("part", "value", F.col("fp").alias("a"))
    other = rows.select("part", "value", F.col("fp").alias("b"), "probe")
    met = own.join(other, ["part", "value"]).where("a <> b and (probe or a < b)")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")


def crowd_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links that connect whatever is within ``distance`` bits, without all pairs.

    Two fingerprints within ``near`` and ``far`` bits of the same centre, ``near + far = distance``, differ in at most
    ``distance`` bits, and of any two that do some centre lies so between them. So each centre links all its
    fingerprints to the least of those within ``near`` bits: as many links as fingerprints, verified by construction.
    A fingerprint has a fixed number of centres, 2,081 for distance 3.
    """
    near = distance // 2
    masks = [mask_of(list(c)) for j in range(distance - near + 1) for c in combinations(range(BITS), j)]
    flips = np.array(masks, np.uint64)
    close = np.bitwise_count(flips) <= near

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column(0).to_numpy().view(np.uint64):
                columns = [(fp ^ flips).view(np.int64), np.full(len(flips), fp).view(np.int64), close]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["centre", "a", "close"])

    rows = fps.select("fp").mapInArrow(made, "centre long, a long, close boolean")
    least = rows.groupBy("centre").agg(
        F.min(F.when(F.col("close"), F.col("a"))).alias("b"), F.count(F.lit(1)).alias("n")
    )
    meeting = least.where("b is not null and n > 1").select("centre", "b")
    return rows.join(meeting, "centre").where("a <> b").select("a", "b").distinct()


def simhash_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """Rows ``(key, fp, component)``: the fingerprint as a signed long and the least key reachable over links.

    Equal fingerprints become one before the join (counted on the map side, so a hot group is one row), links are
    found between distinct ones, and components run over those. Null and empty texts have fingerprint 0 and link
    like any other. Repeated rows and keys stay; a null key takes part, but is no component's name unless all of
    its keys are null. Empty tables give no rows; other columns are not read.
    """
    all_ = stored(fingerprints(docs, key, text, shingle), "simhash-fingerprints")
    distinct = stored(all_.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    found = components(links(distinct, distinct.count(), distance), "simhash")
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(names, "root").select("fp", "component")
    return all_.join(named, "fp").select(F.col(key), "fp", "component")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
