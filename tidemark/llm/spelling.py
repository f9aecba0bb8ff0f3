"""Spelling variants: words one inserted, deleted or replaced letter apart, and the form each is a variant of.

The letters of a word, each with the number of times it stood before, are a binary vector. One replaced letter changes two
of its places, one inserted or deleted letter one. Signatures by partition and enumeration find all vectors that close:
the places are dealt into parts, and a signature is what a vector holds outside some of the parts. Two vectors of equal size
that differ in two places agree outside two parts, two whose sizes differ by one agree outside one. Equal signatures are
joined on distinct vectors, whose letters are compared; words of the pairs that remain are compared letter by letter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_TIMES, DROP_EVERY, TIMES_MORE = 7, 2, 31, 10
#: Parts of the places for vectors of equal size (two parts are left out) and for sizes one apart (one is left out).
EQUAL_PARTS, APART_PARTS = 8, 6


def damaged(key: Column, run: Column) -> Column:
    """The run without its letter number h mod length if 31 divides h, the CRC of ``key:run``; letters count from 0."""
    h = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(h % DROP_EVERY == 0, shorter).otherwise(run)


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct words ``(word, n)`` of at least seven letters and two occurrences. Shorter runs cannot give one."""
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{LEAST_LETTERS},}}"), F.lit(0)))
    low = docs.select(F.col(key).alias("k"), runs.alias("run"))
    low = low.select("k", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    words = low.select(damaged(F.col("k"), F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


def _places(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit values of the places of all vectors: a letter and how often it stood before."""
    rows, values, known = [], [], {}
    for row, sorted_letters in enumerate(letters):
        before, times = "", 0
        for letter in sorted_letters:
            times = times + 1 if letter == before else 0
            before = letter
            value = known.get((letter, times))
            if value is None:
                value = known[letter, times] = xxhash.xxh3_64_intdigest(f"{letter}{times}")
            rows.append(row)
            values.append(value)
    return np.array(rows, np.int64), np.array(values, np.uint64)


def signatures(letters: list[str], sizes: list[int], parts: int, out: int) -> list[np.ndarray]:
    """For each choice of ``out`` parts the signature of each vector: its places outside these parts, and a size."""
    rows, values = _places(letters)
    held = np.zeros((len(letters), parts), np.uint64)
    np.add.at(held, (rows, (values % np.uint64(parts)).astype(np.int64)), values * np.uint64(0x9E3779B97F4A7C15))
    whole = held.sum(axis=1, dtype=np.uint64)
    size = np.array(sizes, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    found = []
    for number, left_out in enumerate(combinations(range(parts), out)):
        salt = np.uint64(xxhash.xxh3_64_intdigest(f"{parts}:{out}:{number}"))
        value = whole - held[:, list(left_out)].sum(axis=1, dtype=np.uint64)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size + salt
        found.append((value ^ (value >> np.uint64(32))).view(np.int64))
    return found


def _signed(vectors: DataFrame) -> DataFrame:
    """Rows ``(sig, kind, letters)`` of distinct vectors: kind 0 for equal sizes, 1 as the smaller and 2 as the larger of two
    sizes one apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(0).to_pylist()
            sizes = list(map(len, letters))
            smaller = [n - 1 for n in sizes]
            for kind, given, parts, out in ((0, sizes, EQUAL_PARTS, 2), (1, sizes, APART_PARTS, 1), (2, smaller, APART_PARTS, 1)):
                for found in signatures(letters, given, parts, out):
                    kinds = pa.array(np.full(len(letters), kind, np.int8))
                    yield pa.RecordBatch.from_arrays([pa.array(found), kinds, batch.column(0)], names=["sig", "kind", "letters"])

    return vectors.mapInArrow(run, "sig long, kind byte, letters string")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of vectors of equal size with two different places (a < b), or of sizes one apart (a is the
    smaller) with one. Vectors are given as sorted letters; ones that differ so are at most two edits apart."""
    signed = _signed(vectors)
    a, b = (signed.select("sig", F.col("kind").alias(f"kind_{x}"), F.col("letters").alias(x)) for x in "ab")
    equal = (F.col("kind_a") == 0) & (F.col("kind_b") == 0) & (F.col("a") < F.col("b"))
    apart = (F.col("kind_a") == 1) & (F.col("kind_b") == 2)
    close = F.levenshtein("a", "b", 2) >= 0
    return a.join(b, "sig").where((equal | apart) & close).select("a", "b").distinct()


def links(words: DataFrame) -> DataFrame:
    """All pairs of near words in both directions: ``(word, n, other, other_n)``."""
    lettered = stored(words.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), "")), "lettered")
    pairs = stored(near_vectors(lettered.select("letters").distinct()), "near-vectors")
    a, b = (lettered.select(F.col("letters").alias(x), F.col("word").alias(f"w{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(F.levenshtein("wa", "wb", 1) == 1)
    names = ("word", "n", "other", "other_n")
    both = [F.struct(*[F.col(c).alias(o) for c, o in zip(of, names, strict=True)]) for of in (("wa", "na", "wb", "nb"), ("wb", "nb", "wa", "na"))]
    return near.select(F.inline(F.array(*both)))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows ``(word, root)`` of ``(word, form)``: each round doubles the steps. Forms are ten times as frequent at each
    step, so a chain has at most 18 and five rounds reach its end."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(further, "root", "left")
        moved = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near`` (near words), ``form`` (the near word of largest n, of equal ones the first in
    code-point order, if its n is at least ten times the word's; else null), ``form_n`` and ``root`` (where the forms
    lead to; the word itself without a form).

    Runs of letters are whole in whole texts; a null text has none and a null key counts as an empty one. Repeated rows
    count as often as they stand, other columns are not read, an empty table gives none. Pairs of vectors and of words
    are compared in equality joins, which adaptive execution splits where a signature is frequent; none is left out.
    """
    words = stored(words_of(docs, key, text), "words")
    near = stored(links(words), "near-words")
    # the largest n, then the first word: the least of (-n, word)
    first = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    judged = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), first.alias("f"))
    enough = -F.col("f.m") >= F.col("n") * TIMES_MORE
    judged = stored(
        judged.select("word", "n_near", F.when(enough, F.col("f.w")).alias("form"), F.when(enough, -F.col("f.m")).alias("form_n")),
        "judged",
    )
    roots = _roots(judged.where("form is not null"))
    all_ = words.join(judged, "word", "left").join(roots, "word", "left")
    return all_.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
    )
