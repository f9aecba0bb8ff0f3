"""Passages that occur more than once, byte by byte, by prefix-free parsing.

A rolling hash over the bytes sets triggers; a trigger closes a phrase. With triggers taken as window minima, every
start of a string of ``length`` bytes belongs to the phrase of the first trigger inside it, and equal strings have
their trigger at the same distance ``d``. So a string is (last ``d`` bytes of a phrase, what follows the trigger):
the order of all suffixes, cut at ``length`` bytes, falls apart into classes of equal phrase tails and followings.

Level 0 classes whole phrases with what follows, level 1 blocks of 16 starts, level 2 single starts. A class that
occurs twice is repeated as a whole; one that occurs once goes down a level only if its core, which all its
strings share, occurs in another class. Only ends of matches go down, so the levels below are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidemark.llm.shared import dropped, settled, stored

LENGTH = 400
#: Repeated passages of more words go, found as runs of repeated strings of so many bytes: 51 words of two letters. The
#: shortest 51 words in a row of the sf0.1 documents have 230.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 152
GRAM, BLOCK = 16, 16
#: Bytes parsed at a time; a longer text is parsed in overlapping pieces.
PIECE = 1 << 22
GROUP = 1 << 18


def window_of(length: int) -> int:
    """The widest power of two of grams that fits into a string."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes are compared, not {length}")
    return 1 << ((length - GRAM + 1).bit_length() - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit rolling hash of each 16-byte gram, by doubling the width."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    h ^= h >> np.uint32(15)
    width = 1
    for factor in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1):
        h = h[:-width] * np.uint32(factor) + h[width:]
        width *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def triggers(data: np.ndarray, window: int) -> np.ndarray:
    """For each window of grams, by its start, the place of its least hash; of equal ones the last."""
    return _minima(gram_hashes(data), window)


def _minima(hashes: np.ndarray, window: int) -> np.ndarray:
    key = hashes.astype(np.uint64) << np.uint64(32)
    n = len(key)
    key |= np.arange(n, 0, -1, dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    return n - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pieces_of(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, offset, bytes): every start of a string lies in exactly one piece."""
    for i, data in enumerate(texts):
        for at in range(0, max(len(data) - length + 1, 0), PIECE):
            yield i, at, data[at : at + PIECE + length - 1]


def phrases(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """(text, first start, starts, distance of the last start to the trigger, class, core) for each phrase."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for piece in pieces_of(texts, length):
        held.append(piece)
        size += len(piece[2])
        if size >= GROUP:
            yield from _parsed(held, length)
            held, size = [], 0
    if held:
        yield from _parsed(held, length)


def _parsed(pieces: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    window = window_of(length)
    buffer = b"".join(p[2] for p in pieces)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    trigger = triggers(np.frombuffer(buffer, np.uint8), window)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(trigger)]
    inside = np.arange(len(trigger)) + length <= ends[piece]
    trigger = np.where(inside, trigger, -1)
    new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(piece) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(trigger)]]) - 1
    use = trigger[first] >= 0
    first, last, at = first[use], last[use], trigger[first][use]
    begin = ends - sizes
    core, cls = length - window + 1, xxhash.xxh3_128_digest
    for k, a, i, j in zip(piece[first].tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
        text, offset, _ = pieces[k]
        yield (
            text,
            offset + i - int(begin[k]),
            j - i + 1,
            a - j,
            cls(buffer[i : j + length], a - j),
            xxhash.xxh3_64_intdigest(buffer[a : a + core]),
        )


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """Pass one over ``(k, th, w, text)``: the parse, a row for each phrase of each text."""
    schema = StructType(
        [docs.schema["k"], *(StructField(n, LongType()) for n in ("th", "w", "lo", "n", "d", "f1", "f2", "core"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = [t.encode() for t in batch.column(3).to_pylist()]
            rows = list(phrases(texts, length))
            if rows:
                index, lo, n, d, digests, core = zip(*rows, strict=True)
                index = pa.array(index, pa.int64())
                columns = [batch.column(i).take(index).cast(arrow.field(i).type) for i in range(3)]
                columns += [pa.array(c, pa.int64()) for c in (lo, n, d)]
                yield pa.RecordBatch.from_arrays([*columns, *_longs(digests), _signed(core)], schema=arrow)

    return docs.mapInArrow(run, schema)


def _classes(rows: DataFrame, name: str) -> DataFrame:
    """Classes ``(f1, f2, copies, mark, open)`` that matter of rows ``(f1, f2, core, mark, w)``.

    ``copies`` is how often the class occurs, a row counting ``w`` times, and ``mark`` its least mark. A class is open if its core occurs in
    another class and some class of that core occurs once. Classes that occur once and are not open are left out.
    Counts are combined on the map side, so a phrase that a third of all texts share is one row a task.
    """
    counts = rows.groupBy("f1", "f2", "core").agg(F.sum("w").alias("copies"), F.min("mark").alias("mark"))
    cores = counts.groupBy("core").agg(F.count(F.lit(1)).alias("classes"), F.max(F.col("copies") == 1).alias("single"))
    shared = stored(cores.where("classes > 1 and single").select("core", F.lit(True).alias("open")), f"{name}-cores")
    joined = counts.join(shared, "core", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    return stored(joined.where("copies > 1 or open").drop("core"), f"{name}-classes")


def _settled(joined: DataFrame, length: int, words: int, result: str) -> DataFrame:
    """Rows without open phrases get their result; of the others all columns stay, and their result is null."""
    given = [StructField(f.name, f.dataType) for f in joined.schema]
    schema = StructType([*given, *_result_fields(result)])
    place = {name: i for i, name in enumerate(joined.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        given = list(arrow)[: len(place)]
        for batch in batches:
            waits = pc.fill_null(pc.greater(pc.list_value_length(batch.column(place["olo"])), 0), False)
            rest = batch.filter(waits)
            columns = [c.cast(f.type) for c, f in zip(rest.columns, given, strict=True)]
            columns += [pa.nulls(len(rest), f.type) for f in list(arrow)[len(place) :]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            own = batch.filter(pc.invert(waits))
            kept = ("k", "carried")
            columns = [own.column(i).cast(f.type) if f.name in kept else pa.nulls(len(own), f.type) for i, f in enumerate(given)]
            columns += _results(*[own.column(place[c]) for c in ("text", "lo", "n")], length, words, result, arrow)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(run, schema)


def _contexts(pending: DataFrame, length: int) -> DataFrame:
    """Open phrases with their bytes: rows ``(k, th, lo, n, d, f1, f2, bytes)``."""
    names = ("olo", "on", "od", "of1", "of2")
    schema = StructType(
        [
            pending.schema["k"],
            *(StructField(x, LongType()) for x in ("th", "lo", "n", "d", "f1", "f2")),
            StructField("bytes", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows, index, data = [], [], []
            columns = [c.to_pylist() for c in batch.columns[2:]]
            for i, (text, *arrays) in enumerate(zip(*columns, strict=True)):
                whole = text.encode()
                for row in zip(*arrays, strict=True):
                    index.append(i)
                    rows.append(row)
                    data.append(whole[row[0] : row[0] + row[1] + length - 1])
            if rows:
                index = pa.array(index, pa.int64())
                out = [batch.column(0).take(index).cast(arrow.field(0).type), batch.column(1).take(index)]
                out += [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(data, pa.binary())], schema=arrow)

    return pending.select("k", "th", "text", *names).mapInArrow(run, schema)


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Level 1: rows ``(p1, p2, block, lo, n, f1, f2, core)`` of each context ``p``; ``lo`` counts from its first
    start. The core is what all 16 starts of the block share."""
    names = ("p1", "p2", "block", "lo", "n", "f1", "f2", "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, cores = [], [], []
            for p1, p2, n, d, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                top = d + n - 1  # distance of the first start to the trigger
                for block in range(d // BLOCK, top // BLOCK + 1):
                    far, near = min(top, block * BLOCK + BLOCK - 1), max(d, block * BLOCK)
                    lo, last = top - far, top - near
                    rows.append((p1, p2, block, lo, last - lo + 1))
                    digests.append(xxhash.xxh3_128_digest(data[lo : last + length], near))
                    at = top - block * BLOCK
                    cores.append(xxhash.xxh3_64_intdigest(data[at : at + length - BLOCK + 1], block))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *_longs(digests), _signed(cores)], names=names)

    return contexts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _starts(open_blocks: DataFrame, length: int) -> DataFrame:
    """Level 2: rows ``(p1, p2, lo, f1, f2)`` of each start in ``(p1, p2, lo, n, bytes)``."""
    names = ("p1", "p2", "lo", "f1", "f2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for p1, p2, lo, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(lo, lo + n):
                    rows.append((p1, p2, i))
                    digests.append(xxhash.xxh3_128_digest(data[i : i + length]))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *_longs(digests)], names=names)

    return open_blocks.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans as maximal runs; touching ones become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


def _result_fields(result: str) -> list[StructField]:
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    name = {"bytes": "kept", "text": "kept", "sha256": "kept_sha256"}[result]
    last = StructField(name, BinaryType() if result == "bytes" else StringType())
    return [StructField("n_bytes", LongType()), StructField("spans", spans), last]


def _results(
    text: pa.Array, lo: pa.Array, n: pa.Array, length: int, words: int, result: str, arrow: pa.Schema
) -> list[pa.Array]:
    """Bytes, removed spans and what is left of texts with their arrays of repeated starts."""
    sizes, found, kept = [], [], []
    for t, starts, counts in zip(text.to_pylist(), lo.to_pylist(), n.to_pylist(), strict=True):
        data = t.encode()
        spans = zip(starts or (), counts or (), strict=True)
        runs = [(i, j + length - 1) for i, j in merged([(i, i + k) for i, k in spans])]
        runs = merged([(i, j) for i, j in runs if j - i >= LENGTH or not words or len(data[i:j].split()) > words])
        rest = without(data, runs)
        sizes.append(len(data))
        found.append([{"start": i, "end": j} for i, j in runs])
        if result == "sha256":
            kept.append(hashlib.sha256(rest).hexdigest())
        else:
            kept.append(rest.decode("utf-8", "ignore") if result == "text" else rest)
    fields = list(arrow)[-3:]
    return [pa.array(c, f.type) for c, f in zip((sizes, found, kept), fields, strict=True)]


def _cut(docs: DataFrame, length: int, words: int, result: str) -> DataFrame:
    """Results of rows ``(k, carried, text, lo, n)``."""
    schema = StructType([docs.schema["k"], docs.schema["carried"], *_result_fields(result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            own = [batch.column(i).cast(arrow.field(i).type) for i in range(2)]
            columns = _results(*batch.columns[2:], length, words, result, arrow)
            yield pa.RecordBatch.from_arrays([*own, *columns], schema=arrow)

    return docs.select("k", "carried", "text", "lo", "n").mapInArrow(run, schema)


def _beside(docs: DataFrame, other: DataFrame) -> DataFrame:
    """Left join on the row's identity; a null key is equal to a null key."""
    other = other.withColumnsRenamed({"k": "__k", "th": "__th"})
    on = F.col("k").eqNullSafe(F.col("__k")) & (F.col("th") == F.col("__th"))
    return docs.join(other, on, "left").drop("__k", "__th")


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    result: str = "bytes",
    carry: tuple[str, ...] = (),
    words: int = 0,
) -> DataFrame:
    """Per row: its key, the columns of ``carry``, ``n_bytes`` (UTF-8), ``spans`` (maximal runs of removed bytes, end
    exclusive) and ``kept``, the rest as bytes; with ``result="text"`` as text, without characters that a cut leaves
    incomplete; with ``"sha256"`` in its place ``kept_sha256``, the digest of the bytes.

    A byte goes if a string of ``length`` bytes that covers it starts at another place too, in any text or the same.
    Strings do not cross texts, and the input is judged, not what is left. Strings count as equal by 128-bit hashes.
    With ``words``, a run of such starts that covers less than LENGTH bytes goes only if it has more words than that;
    words are parted by ASCII spaces, and one that the run cuts counts.

    A null text is empty; a text shorter than ``length`` stays whole. A repeated row is another place: the text
    goes from every copy. Rows that agree in key and text take part once, with a weight, however many they are; null and
    repeated keys are allowed. An empty table gives no rows, and columns that are not asked for are not read.
    """
    carried = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(True).alias("own"))
    own = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), carried.alias("carried"))
    own = own.select("k", F.xxhash64("text").alias("th"), "text", "carried")
    copied = stored(own.groupBy("k", "th").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), "copied")
    copies = None
    if copied.isEmpty():
        own = own.withColumn("w", F.lit(1).cast("bigint"))
    else:
        marked = _beside(own, copied.withColumn("w", F.lit(2).cast("bigint")).drop("n_rows"))
        copies = marked.where("w = 2")
        nothing = [F.lit(None).cast(docs.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(carry)]
        none = F.struct(*nothing, F.lit(False).alias("own")).alias("carried")
        one_each = copies.groupBy("k", "th").agg(F.first("text").alias("text")).select("k", "th", "text", none, F.lit(2).cast("bigint").alias("w"))
        own = marked.where("w is null").withColumn("w", F.lit(1).cast("bigint")).unionByName(one_each)

    parse = stored(_parse(own.select("k", "th", "w", "text"), length), "phrases")
    place = F.xxhash64("k", "th", "lo")
    classes = _classes(parse.select("f1", "f2", "core", place.alias("mark"), "w"), "phrase")

    # one phrase stands for an open class that occurs more often: what is equal to it repeats in any case
    stands = F.col("open") & ((F.col("copies") == 1) | (F.col("mark") == place))
    judged = parse.drop("core", "w").join(classes, ["f1", "f2"])
    per_text = judged.groupBy("k", "th").agg(
        F.collect_list(F.when(F.col("copies") > 1, F.struct("lo", "n"))).alias("done"),
        F.collect_list(F.when(stands, F.struct("lo", "n", "d", "f1", "f2"))).alias("opens"),
    )
    arrays = [F.col(f"done.{c}").alias(c) for c in ("lo", "n")]
    arrays += [F.col(f"opens.{c}").alias(f"o{c}") for c in ("lo", "n", "d", "f1", "f2")]
    beside = _beside(own.drop("w"), per_text.select("k", "th", *arrays))
    first = stored(_settled(beside, length, words, result), "first")
    dropped(parse, classes)

    names = ["k", "carried", *(f.name for f in _result_fields(result))]
    pending = first.where("text is not null").drop(*names[2:])
    found = settled(lambda: _resolved(stored(_contexts(pending, length), "contexts"), length), "found")
    late = found.groupBy("k", "th").agg(F.collect_list(F.struct("lo", "n")).alias("late"))
    all_ = _beside(pending, late)
    more = [F.concat(c, F.coalesce(F.col(f"late.{c}"), F.array().cast("array<bigint>"))).alias(c) for c in ("lo", "n")]
    rest = _cut(all_.select("k", "carried", "text", *more), length, words, result)
    both = first.where("text is null").select(*names).unionByName(rest)
    if copies is not None:  # every string of a copied row starts in its copies too
        starts = F.octet_length("text") - (length - 1)
        every = [F.when(starts > 0, F.array(x)).cast("array<bigint>").alias(c) for c, x in (("lo", F.lit(0)), ("n", starts))]
        whole = _cut(copies.select("k", "carried", "text", *every), length, words, result)
        both = both.where("carried.own").unionByName(whole)
    carried_out = [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)]
    return both.select(F.col("k").alias(key), *carried_out, *names[2:])


def _resolved(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts ``(k, th, lo, n)`` of open phrases, by way of blocks and single starts."""
    blocks = stored(_blocks(contexts.select("f1", "f2", "n", "d", "bytes"), length), "blocks")
    mark = F.xxhash64("p1", "p2", "block")
    classes = _classes(blocks.select("f1", "f2", "core", mark.alias("mark"), F.lit(1).cast("bigint").alias("w")), "block")
    judged = blocks.drop("core").join(classes, ["f1", "f2"]).drop("f1", "f2")
    whole = judged.where("copies > 1").select("p1", "p2", "lo", "n")
    stands = F.col("open") & ((F.col("copies") == 1) | (F.col("mark") == mark))
    left = judged.where(stands).select("p1", "p2", "lo", "n")
    bytes_ = contexts.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), "bytes")
    starts = stored(_starts(left.join(bytes_, ["p1", "p2"]).select("p1", "p2", "lo", "n", "bytes"), length), "starts")
    twice = starts.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    single = starts.join(stored(twice, "repeated-starts"), ["f1", "f2"])
    found = whole.unionByName(single.select("p1", "p2", "lo", F.lit(1).cast("bigint").alias("n")))
    places = contexts.select("k", "th", F.col("lo").alias("base"), F.col("f1").alias("p1"), F.col("f2").alias("p2"))
    return found.join(places, ["p1", "p2"]).select("k", "th", (F.col("base") + F.col("lo")).alias("lo"), "n")


# --- passages of words -----------------------------------------------------------------------------------------


def row_id(key: str = "doc_id", text: str = "text") -> Column:
    """A row by its key and text, in 64 bits: rows that agree in both are copies."""
    return F.xxhash64(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def _word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts whose words are parted by single blanks as one, and where each word begins and ends."""
    buffer = b" ".join(texts)
    blanks = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    return buffer, np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(buffer)]])


def word_phrases(texts: list[str], words: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(text, first start, starts, class, core) for each phrase of windows of ``words`` words; starts count in words.

    A trigger is the least gram at the start of a word. The last words of a window set none, so that grams lie within it.
    """
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        data = b" ".join(text.encode().split())
        if data.count(b" ") + 1 >= words:
            held.append((i, data))
            size += len(data)
        if size >= GROUP:
            yield from _word_parsed(held, words)
            held, size = [], 0
    if held:
        yield from _word_parsed(held, words)


def _word_parsed(held: list[tuple[int, bytes]], words: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    core = GRAM // 2 + 1  # so many words have more bytes than a gram
    buffer, begin, end = _word_places([data for _, data in held])
    padded = np.frombuffer(buffer + bytes(GRAM), np.uint8)
    cuts = range(0, len(buffer), PIECE)
    of_cut = np.searchsorted(begin, [*cuts, len(padded)])
    hashes = [
        gram_hashes(padded[at : at + PIECE + GRAM - 1])[begin[i:j] - at]
        for at, i, j in zip(cuts, of_cut[:-1], of_cut[1:], strict=True)
    ]
    trigger = _minima(np.concatenate(hashes), words - core + 1)
    counts = np.array([data.count(b" ") + 1 for _, data in held])
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(held)), counts)[: len(trigger)]
    trigger = np.where(np.arange(len(trigger)) + words <= ends[text], trigger, -1)
    new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(trigger)]]) - 1
    use = trigger[first] >= 0
    first, last, at = first[use], last[use], trigger[first][use]
    which = text[first]
    columns = (
        which, first - (ends - counts)[which], last - first + 1, at - last,
        begin[first], end[last + words - 1], begin[at], end[at + core - 1],
    )
    for k, lo, n, d, i, j, a, z in zip(*(c.tolist() for c in columns), strict=True):
        yield held[k][0], lo, n, xxhash.xxh3_128_digest(buffer[i:j], d), xxhash.xxh3_64_intdigest(buffer[a:z])


def _parse_words(docs: DataFrame, words: int) -> DataFrame:
    """The parse of ``(row, text)`` in words, a row for each phrase of each text."""
    names = ("row", "lo", "n", "f1", "f2", "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(word_phrases(batch.column(1).to_pylist(), words))
            if rows:
                index, lo, n, digests, core = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(index, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in (lo, n)]
                yield pa.RecordBatch.from_arrays([*columns, *_longs(digests), _signed(core)], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _word_starts(docs: DataFrame, words: int) -> DataFrame:
    """Rows ``(row, lo, f1, f2, across)`` of each start in the open phrases of ``(row, text, lo, n, across)``."""
    names = ("row", "lo", "f1", "f2", "across")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, starts, digests, across = [], [], [], []
            for k, (text, *phrases) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                buffer, begin, end = _word_places([b" ".join(text.encode().split())])
                for lo, n, elsewhere in zip(*phrases, strict=True):
                    places = zip(begin[lo : lo + n].tolist(), end[lo + words - 1 : lo + n + words - 1].tolist(), strict=True)
                    digests += [xxhash.xxh3_128_digest(buffer[i:j]) for i, j in places]
                    starts += range(lo, lo + n)
                    index += [k] * n
                    across += [elsewhere] * n
            if index:
                columns = [batch.column(0).take(pa.array(index, pa.int64())), pa.array(starts, pa.int64()), *_longs(digests)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(across, pa.bool_())], names=names)

    return docs.mapInArrow(run, "row long, lo long, f1 long, f2 long, across boolean")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``(row, n_passage_words)``: how many words of a text lie in passages of over ``words`` words that stand in another
    row too. Words are parted by ASCII white space of any length; rows go by their ``row_id``, and ones without such a
    passage are left out. A repeated row is another row, so all words of its copies count if they are over ``words``.

    Found as in ``remove_repeats``, with triggers at the starts of words: whole phrases, then single starts of those whose
    core stands in another row.
    """
    words += 1
    if words <= GRAM:
        raise ValueError(f"passages of at least {GRAM} words are compared, not {words - 1}")
    own = docs.select(row_id(key, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parse = stored(_parse_words(own, words), "word-phrases")
    counts = parse.groupBy("f1", "f2", "core").agg(F.min("row").alias("least"), F.max("row").alias("most"))
    counts = counts.withColumn("across", F.col("least") < F.col("most"))
    cores = counts.groupBy("core").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.min("across").alias("all"))
    shared = cores.where("a < b and not all").select("core", F.lit(True).alias("open"))
    joined = counts.join(shared, "core", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    classes = joined.where("across or open").select("f1", "f2", "least", "across", "open")

    # the phrases of one row stand for an open class that several rows have
    stands = F.col("open") & (~F.col("across") | (F.col("row") == F.col("least")))
    judged = parse.drop("core").join(classes, ["f1", "f2"])
    per_row = judged.groupBy("row").agg(
        F.collect_set(F.when(F.col("across"), F.struct("lo", "n"))).alias("done"),
        F.collect_set(F.when(stands, F.struct("lo", "n", "across"))).alias("opens"),
    )
    per_row = stored(per_row, "word-rows")
    copied = parse.groupBy("row").agg(F.sum("n").alias("starts"), F.count_if(F.col("lo") == 0).alias("copies"))
    copied = stored(copied.where("copies > 1"), "word-copies")
    dropped(parse)

    opens = per_row.where("size(opens) > 0").select("row", *[F.col(f"opens.{c}").alias(c) for c in ("lo", "n", "across")])
    starts = stored(_word_starts(own.join(opens, "row").select("row", "text", "lo", "n", "across"), words), "word-starts")
    twice = starts.groupBy("f1", "f2").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.max("across").alias("any"))
    found = starts.where(~F.col("across")).join(twice.where("a < b or any").select("f1", "f2"), ["f1", "f2"])
    late = found.groupBy("row").agg(F.collect_set(F.struct("lo", F.lit(1).cast("bigint").alias("n"))).alias("late"))

    none = F.array().cast(per_row.schema["done"].dataType)
    spans = F.sort_array(F.concat("done", F.coalesce("late", none)))
    zero = F.lit(0).cast("bigint")

    def covered(seen, span):
        end = span["lo"] + span["n"] + (words - 1)
        more = F.greatest(zero, end - F.greatest(seen["end"], span["lo"]))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + more).alias("n"))

    n = F.aggregate(spans, F.struct(zero.alias("end"), zero.alias("n")), covered, lambda seen: seen["n"])
    some = per_row.select("row", "done").join(late, "row", "left").select("row", n.alias("n_passage_words")).where("n_passage_words > 0")
    every = copied.select("row", (F.expr("starts div copies") + (words - 1)).alias("n_passage_words"))
    return some.join(copied, "row", "left_anti").unionByName(every)
