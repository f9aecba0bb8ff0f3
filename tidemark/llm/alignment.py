"""Which tokens of two tokenizers lie over each other, and how often over the whole corpus.

Both tokenizers encode a whole text first. Byte offsets where tokens of both end are shared ends; those before a space-marked
token of both are anchors and cut the text into windows of token ids. What lies over what inside a window depends on its
ids alone, so a task keeps the alignment of each window it has seen, by the tuple of its ids.

Links are pairs of ids, of which there are few beside their occurrences. Each part of the corpus numbers the pairs it
meets, writes them once with their counts, and its texts as numbers of pairs. Counts are summed over parts, and what a pair is
worth goes back to the parts that hold it. So shuffles carry the pairs of a part and one row for each text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)
from tokenizers import Tokenizer

from tidemark.llm.shared import by_bytes, keeping, stored

LEFT, LEFT_RANKS, RIGHT = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A part of the corpus ends when its texts have more bytes than this, or its pairs are more.
PART_BYTES, PART_PAIRS = 64 << 20, 1_000_000
#: Windows that a task keeps, and the most ids of one that it keeps.
KEPT_WINDOWS, KEPT_IDS = 400_000, 64
#: A key with at least one of so many shares of all rows is joined by broadcast: there can be no more such keys.
SHARES = 20_000
#: A run of white space from which on the ranks' word pattern would need too deep a stack.
_BLANK_RUN = re.compile(r"\s{2000}")
#: A single space at which both tokenizers start anew: neither more blanks nor the visible form of a space beside it.
_SAFE, _UNSAFE = re.compile(r"(?<=[^ ▁]) (?=[^\s▁])"), re.compile(r" \s|▁|^ | $")
#: Pieces of texts whose ids a task keeps, and the longest that it looks up again.
KEPT, SHORT = 400_000, 48
#: Bytes of texts that are aligned at once, so that the arrays of a batch stay in a core's cache.
WORK_BYTES = 1 << 17
#: Bytes of pieces that are encoded as one text, and the ids or links after which a task starts its tables anew.
JOINED, KEPT_VALUES = 8192, 1 << 23


class Left:
    """Ids and bytes of the byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, tokenizer: str = LEFT, ranks: str = LEFT_RANKS) -> None:
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.whole.encode_special_tokens = True
        self.bytes = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        if _BLANK_RUN.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


class Right:
    """Ids and bytes of the pieces of a SentencePiece model."""

    def __init__(self, model: str = RIGHT) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            known = self.library.is_byte(i)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if known else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def overlaps(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of tokens with given byte ends (both sides cover the same bytes), and the end of each link. Between two
    neighbouring ends of either side one token of each lies, so there is one link for each distinct end."""
    ends = np.union1d(ends_a, ends_b)
    left, right = a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)]
    return (left.astype(np.int64) << 32) + right, ends


class Pool:
    """Runs of numbers, told by their place in the order in which they came."""

    def __init__(self) -> None:
        self.values, self.used = np.zeros(1 << 16, np.uint32), 0
        self.stops = np.zeros(1 << 12, np.int64)

    def extend(self, values: np.ndarray, stops: np.ndarray, n: int) -> None:
        """Append runs that end at ``stops`` within ``values``, after ``n`` runs."""
        used = self.used + len(values)
        if used > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(used, np.uint32)])
        if n + len(stops) + 1 > len(self.stops):
            self.stops = np.concatenate([self.stops[: n + 1], np.zeros(n + len(stops) + 1, np.int64)])
        self.values[self.used : used] = values
        self.stops[n + 1 : n + 1 + len(stops)] = stops + self.used
        self.used = used

    def runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places one after the other, and the size of each."""
        starts = self.stops[places]
        sizes = self.stops[places + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.arange(total) + np.repeat(starts - ends + sizes, sizes)], sizes


class Aligner:
    """Windows of whole texts, and the pairs of ids of a part of the corpus, numbered from 0."""

    def __init__(self) -> None:
        self.left, self.right = Left(), Right()
        self.left_sizes = np.array([len(x) for x in self.left.bytes])
        self.right_sizes = np.array([len(x) for x in self.right.bytes])
        n_a, n_b = len(self.left_sizes), len(self.right_sizes)
        self.ids = np.dtype("<u2" if max(n_a, n_b) < 0xFFFF else "<u4")
        self.border = np.iinfo(self.ids).max
        # an id with what follows it: left ones inside a group, at the end of its left side, then right ones
        self.marked = [f"{i}{end}" for n, end in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]
        rng = np.random.default_rng(11)
        self.mix = rng.integers(1, 1 << 63, size=int(self.border) + 1 if self.ids.itemsize == 2 else 1 << 16, dtype=np.uint64)
        self.pieces: dict[str, int] = {}
        self.sides, self.n_kept = (Pool(), Pool()), 0
        self.begin()

    def begin(self) -> None:
        """A new part: its pairs are numbered anew."""
        self.pairs: dict[int, int] = {}
        self.counts = np.zeros(1024, np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.links, self.n_windows = Pool(), 0

    def encode(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the texts that have tokens, the ids of both sides of them, and how many ids each text has there. A text
        has none where a side does not give its bytes again. Texts are parted where both tokenizers start anew, and the ids
        of a piece that comes back are kept."""
        if len(self.pieces) > KEPT or self.sides[0].used > KEPT_VALUES:
            self.pieces, self.sides, self.n_kept = {}, (Pool(), Pool()), 0
        flat: list[str] = []
        bounds, odd = [], set()
        for text in texts:
            if _UNSAFE.search(text):
                split = _SAFE.split(text)
                odd.update(split)
            else:
                split = text.split(" ")
            flat += split
            bounds.append(len(flat))
        codes = np.array(list(map(self.pieces.get, flat)), np.float64)  # a piece that is not kept gives NaN
        unknown = np.flatnonzero(np.isnan(codes))
        places = np.where(np.isnan(codes), 0, codes).astype(np.int64)
        if len(unknown):
            wanted = list(map(flat.__getitem__, unknown.tolist()))
            fresh = dict.fromkeys(wanted)
            alone = {p for p in fresh if not p or p[0].isspace() or (p in odd and _UNSAFE.search(p))}
            for some in by_bytes([p for p in fresh if p not in alone] if alone else fresh, JOINED):
                self._learn(some)
            for piece in alone:
                self._learn([piece])
            places[unknown] = list(map(self.pieces.__getitem__, wanted))
            for piece in [p for p in fresh if len(p) > SHORT]:
                del self.pieces[piece]
        lost = np.concatenate([[0], np.cumsum(places < 0)])
        ends = np.array(bounds)
        starts = np.concatenate([[0], ends[:-1]])
        use = np.flatnonzero(lost[ends] == lost[starts])
        keep = np.repeat(lost[ends] == lost[starts], ends - starts)
        places = places[keep]
        piece_ends = np.cumsum((ends - starts)[use])
        out = []
        for side in self.sides:
            ids, sizes = side.runs(places)
            total = np.concatenate([[0], np.cumsum(sizes)])[piece_ends]
            out.append((ids, np.diff(total, prepend=0)))
        (a, n_a), (b, n_b) = out
        return use.tolist(), a, b, n_a, n_b

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces. They are encoded as one text, in which each is encoded as it is alone; if that does not
        give the bytes again, one by one."""
        text = " ".join(pieces)
        b = self.right.encode([text])[0] if text else []
        a = self.left.encode(" " + text)
        data = (" " + text).encode()
        whole = b"".join(map(self.right.bytes.__getitem__, b)) == data == b"".join(map(self.left.bytes.__getitem__, a))
        if not whole or not text:
            if len(pieces) == 1:
                self.pieces[pieces[0]] = -1
            else:
                for piece in pieces:
                    self._learn([piece])
            return
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)) + 1)
        n = self.n_kept
        for ids, widths, side in zip((a, b), (self.left_sizes, self.right_sizes), self.sides, strict=True):
            ids = np.array(ids, np.uint32)
            side.extend(ids, np.searchsorted(np.cumsum(widths[ids]), ends) + 1, n)
        self.pieces.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.n_kept = n + len(pieces)

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(left ids, right ids, groups: how many of each, groups as text, numbers of pairs, how often) of each text."""
        none = np.zeros(0, np.int32)
        out: list = [(0, 0, 0, "", none, none)] * len(texts)
        use, a, b, n_a, n_b = self.encode(texts)
        if not use:
            return out
        if len(self.known) > KEPT_WINDOWS or self.links.used > KEPT_VALUES:
            self.forget()
        data = np.frombuffer(b"".join([(" " + texts[k]).encode() for k in use] + [b" "]), np.uint8)
        ends_a, ends_b = np.cumsum(self.left_sizes[a]), np.cumsum(self.right_sizes[b])
        bounds = ends_a[np.cumsum(n_a) - 1]
        is_end = np.zeros(len(data), bool)
        is_end[ends_a] = True
        shared = ends_b[is_end[ends_b]]
        anchors = shared[data[shared] == 32]  # each text starts with a space, so the end of the one before is one too
        stop_a, stop_b = np.searchsorted(ends_a, anchors) + 1, np.searchsorted(ends_b, anchors) + 1
        numbers = self._numbers(a, b, stop_a, stop_b)
        last = np.searchsorted(anchors, bounds) + 1
        n_windows = np.diff(last, prepend=0)
        n_groups = np.diff(np.searchsorted(shared, bounds) + 1, prepend=0)
        # (text, pair) of all links of the batch, counted at once
        pairs, n_links = self.links.runs(numbers)
        width = len(self.pairs)
        of = np.repeat(np.repeat(np.arange(len(use)), n_windows), n_links)
        keys, times = np.unique(of * width + pairs, return_counts=True)
        of, pairs = np.divmod(keys, width)
        self.counts[:width] += np.bincount(pairs, times, width).astype(np.int64)
        cuts = np.searchsorted(of, np.arange(1, len(use)))
        pairs, times = np.split(pairs.astype(np.int32), cuts), np.split(times.astype(np.int32), cuts)
        listed, strings = self._marked(a, b, ends_a, ends_b, shared), self.marked.__getitem__
        at = 0
        for i, (k, to) in enumerate(zip(use, np.cumsum(n_a + n_b).tolist(), strict=True)):
            text = "".join(map(strings, listed[at:to].tolist()))[:-1]
            out[k] = (int(n_a[i]), int(n_b[i]), int(n_groups[i]), text, pairs[i], times[i])
            at = to
        return out

    def _marked(self, a, b, ends_a, ends_b, shared) -> np.ndarray:
        """Places in ``marked`` of all ids, group by group, each with its left ids first."""
        last_a, last_b = np.isin(ends_a, shared, assume_unique=True), np.isin(ends_b, shared, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])  # right ids before each group
        until_a = np.flatnonzero(last_a) + 1  # left ids up to the end of each group
        out = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.left_sizes), len(self.right_sizes)
        out[np.arange(len(a)) + before_b[group_a]] = a + n_a * last_a
        out[np.arange(len(b)) + until_a[group_b]] = b + 2 * n_a + n_b * last_b
        return out

    def _names(self, a, b, stop_a, stop_b) -> tuple[np.ndarray, np.ndarray]:
        """The id tuples of all windows in one array (left ids, border, right ids), and where each ends."""
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        stop = np.cumsum(n_a + n_b + 1)
        names = np.full(int(stop[-1]), self.border, self.ids)
        window = np.arange(len(stop_a))
        of_a, of_b = np.repeat(window, n_a), np.repeat(window, n_b)
        names[np.arange(len(a)) + (stop_b - n_b)[of_a] + of_a] = a
        names[np.arange(len(b)) + stop_a[of_b] + of_b + 1] = b
        return names, stop

    def _distinct(self, names: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One window of each id tuple of the batch, and for each window the place of its own among them. Tuples are found
        equal by a sum of mixed ids and then compared id by id."""
        sizes = np.diff(stop, prepend=0)
        start = stop - sizes
        inside = np.arange(len(names)) - np.repeat(start, sizes)
        mixed = self.mix[names & np.uint32(len(self.mix) - 1)] * (2 * inside.astype(np.uint64) + np.uint64(1))
        mixed ^= mixed >> np.uint64(31)
        sums = np.add.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), start) + sizes.astype(np.uint64)
        _, first, which = np.unique(sums, return_index=True, return_inverse=True)
        of = first[which]
        same = sizes[of] == sizes
        if same.all() and np.array_equal(names[np.arange(len(names)) + np.repeat(start[of] - start, sizes)], names):
            return first, which
        return np.arange(len(stop)), np.arange(len(stop))

    def _numbers(self, a, b, stop_a, stop_b) -> np.ndarray:
        """The number of each window; one that is not kept is aligned."""
        names, stop = self._names(a, b, stop_a, stop_b)
        first, which = self._distinct(names, stop)
        width, buffer = self.ids.itemsize, names.tobytes()
        stops = (stop[first] * width).tolist()
        starts = np.concatenate([[0], stop])[first] * width
        tuples = [buffer[i:j] for i, j in zip(starts.tolist(), stops, strict=True)]
        known = self.known
        numbers = list(map(known.get, tuples))
        if None in numbers:
            added = list(dict.fromkeys(name for name, n in zip(tuples, numbers, strict=True) if n is None))
            known.update(zip(added, range(self.n_windows, self.n_windows + len(added)), strict=True))
            numbers = list(map(known.__getitem__, tuples))
            self._link(added)
            for name in [name for name in added if len(name) > KEPT_IDS * width]:
                del known[name]
        return np.array(numbers, np.int64)[which]

    def _link(self, names: list[bytes]) -> None:
        """Append the numbers of the pairs of each window."""
        ids = np.frombuffer(b"".join(names), self.ids)
        sizes = np.array([len(name) // self.ids.itemsize for name in names])
        borders = np.flatnonzero(ids == self.border)
        place, border = np.arange(len(ids)), np.repeat(borders, sizes)
        a, b = ids[place < border], ids[place > border]
        ends_a, ends_b = np.cumsum(self.left_sizes[a]), np.cumsum(self.right_sizes[b])
        links, ends = overlaps(a, b, ends_a, ends_b)
        last_a = np.cumsum(borders - (np.cumsum(sizes) - sizes)) - 1  # the last left id of each window
        stops = np.searchsorted(ends, ends_a[last_a]) + 1
        distinct, which = np.unique(links, return_inverse=True)
        pairs = self.pairs
        numbers = np.array([pairs.setdefault(p, len(pairs)) for p in distinct.tolist()], np.uint32)
        if len(pairs) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(2 * len(pairs) - len(self.counts), np.int64)])
        self.links.extend(numbers[which], stops, self.n_windows)
        self.n_windows += len(names)


def _schema(docs: DataFrame, key: str, result: str) -> StructType:
    last = "groups" if result == "groups" else "groups_sha256"
    numbers = ArrayType(IntegerType())
    return StructType(
        [
            StructField(key, docs.schema[key].dataType),
            StructField("part", LongType()),
            *(StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups")),
            StructField(last, StringType()),
            StructField("numbers", numbers),
            StructField("times", numbers),
            StructField("number", IntegerType()),
            StructField("pair", LongType()),
            StructField("n", LongType()),
        ]
    )


def _encoded(docs: DataFrame, key: str, text: str, result: str) -> DataFrame:
    """Rows of texts (``pair`` is null) and rows of pairs (``pair`` is not) of all parts."""
    schema = _schema(docs, key, result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        aligner, size, part = Aligner(), 0, TaskContext.get().partitionId() << 32

        def rows(size: int, **columns) -> pa.RecordBatch:
            arrays = []
            for f in arrow:
                column = columns.get(f.name)
                column = pa.nulls(size, f.type) if column is None else column
                arrays.append(column if isinstance(column, pa.Array) else pa.array(column, f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def lists(values: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([0, *map(len, values)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values))).cast(arrow.field("times").type)

        def pairs() -> pa.RecordBatch:
            n = len(aligner.pairs)
            counted = rows(
                n, part=[part] * n, number=list(range(n)), pair=list(aligner.pairs), n=pa.array(aligner.counts[:n])
            )
            aligner.begin()
            return counted

        for batch in batches:
            keys, at = batch.column(0).cast(arrow.field(0).type), 0
            for texts in by_bytes([t or "" for t in batch.column(1).to_pylist()], WORK_BYTES):
                with keeping():
                    n_a, n_b, n_groups, groups, numbers, times = zip(*aligner.align(texts), strict=True)
                if result == "sha256":
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                kept = {"groups" if result == "groups" else "groups_sha256": list(groups)}
                yield rows(
                    len(texts), part=[part] * len(texts), n_a=list(n_a), n_b=list(n_b), n_groups=list(n_groups), **kept,
                    numbers=lists(list(numbers)), times=lists(list(times)), **{key: keys.slice(at, len(texts))},
                )
                at += len(texts)
                size += sum(map(len, texts))
                if size > PART_BYTES or len(aligner.pairs) > PART_PAIRS:
                    yield pairs()
                    size, part = 0, part + 1
        yield pairs()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def looked_up(rows: DataFrame, table: DataFrame, on: str, weight: str) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose ``weight`` is the number of rows of the key.

    Keys of at least one of SHARES shares of all rows, of which there can be no more than SHARES, are broadcast; the
    rest is joined by a shuffle in which no key is hot.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * F.lit(SHARES) >= F.lit(total)
    few = F.broadcast(table.where(hot).drop(weight))
    return rows.join(few, on).unionByName(
        rows.join(F.broadcast(table.where(hot).select(on)), on, "left_anti").join(table.where(~hot).drop(weight), on)
    )


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", result: str = "groups") -> DataFrame:
    """Per row: its key, ``n_a`` and ``n_b`` (tokens of both sides), ``n_groups``, ``n_links``, ``n_best`` (links whose
    pair is the most frequent of its right id in the corpus, ties included), ``count_sum`` (corpus counts over its
    links) and ``groups``, the ids as ``a1,a2|b1;a3|b2,b3``; with ``result="sha256"`` in its place
    ``groups_sha256``, the digest of that text.

    The left side encodes a space and the text, the right side the text. Null and empty texts, and those whose tokens
    do not give these bytes again, have no tokens: zeros and an empty text, no digest. Repeated rows count as often as
    they stand, null and repeated keys are allowed, other columns are not read, an empty table gives no rows. A text
    without anchors is one window. What a part sends to one task is bounded by PART_BYTES of texts and PART_PAIRS pairs, and
    one more batch.
    """
    kept = "groups" if result == "groups" else "groups_sha256"
    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    both = stored(_encoded(named, "k", "t", result), "alignment")
    texts = both.where("pair is null").select("k", F.col("part").alias("of"), "n_a", "n_b", "n_groups", kept, "numbers", "times")
    parts = both.where("pair is not null").select("part", "number", "pair", "n")

    pairs = stored(parts.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("rows")), "pairs")
    pairs = pairs.withColumn("right", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # one row for each id of the right vocabulary at most
    top = F.broadcast(pairs.groupBy("right").agg(F.max("count").alias("top")))
    best = (F.col("count") == F.col("top")).cast("long").alias("best")
    judged = pairs.join(top, "right").select("pair", "count", best, "rows")
    worth = looked_up(parts.select("part", "number", "pair"), judged, "pair", "rows").drop("pair")

    schema = StructType(
        [
            docs.schema[key],
            *(StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
            StructField(kept, StringType()),
        ]
    )

    def summed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(schema)
        order = np.argsort(pairs["number"].to_numpy())
        values = [pairs[c].to_numpy()[order] for c in ("best", "count")]
        sums: list[list[int]] = [[], []]
        for numbers, times in zip(texts["numbers"], texts["times"], strict=True):
            own, often = numbers.values.to_numpy(), times.values.to_numpy()
            for out, value in zip(sums, values, strict=True):
                out.append(int((value[own] * often).sum()) if len(own) else 0)
        plain = [texts[c].combine_chunks() for c in ("n_a", "n_b", "n_groups")]
        n_links = pc.subtract(pc.add(plain[0], plain[1]), plain[2])
        columns = [texts["k"].combine_chunks().cast(arrow.field(0).type), *plain, n_links, *(pa.array(s, pa.int64()) for s in sums)]
        return pa.Table.from_arrays([*columns, texts[kept].combine_chunks().cast(arrow.field(7).type)], schema=arrow)

    return texts.groupBy("of").cogroup(worth.groupBy("part")).applyInArrow(summed, schema)
