"""Language of a text: known words by log frequency, unknown ones by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from tidemark.llm.shared import is_drawn, per_text

#: Expected texts of each language that the model is learned from, and entries it keeps of each kind and language.
SAMPLE_TEXTS, WORDS, GRAMS = 1500, 12_000, 5000
ORDERS = (5, 4, 3, 2, 1)
#: Log10 share of a word or n-gram that a language does not have.
MISSING = -7.0
UNKNOWN = "und"
#: Scores of unknown words kept per task.
KEPT = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between two spaces."""
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning, by its key; one without a key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict:
    """The model of rows with a text and a language: ``{"langs": [...], "tables": {0: {word: scores}, n: {gram: scores}}}``.

    Rows are drawn evenly, by a hash of key and text, at a rate that gives about SAMPLE_TEXTS whole texts of each language;
    counts are added up in Spark, and the most frequent WORDS words and GRAMS n-grams of each length are kept for each
    language, which bounds what reaches the driver for each. Languages are taken to be few, as labels of a table are.
    Without labelled rows the model knows no language.
    """
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    labelled = labelled.where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "tables": {}}
    # by key and text, so a text that a third of all rows share cannot fill the sample
    rates = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, SAMPLE_TEXTS / n)])
    drawn = labelled.where(is_drawn(rates[F.col("l")], "k", "t")).select("t", "l")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(words_of(t))
            rows = []
            for name, found in words.items():
                rows += [(name, 0, w, n) for w, n in found.items()]
                for order in ORDERS:
                    parts = Counter()
                    for w, n in found.items():
                        for g in grams(w, order):
                            parts[g] += n
                    rows += [(name, order, g, n) for g, n in parts.items()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["l", "kind", "gram", "n"])

    counts = drawn.mapInArrow(counted, "l string, kind int, gram string, n long")
    summed = counts.groupBy("l", "kind", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l", "kind").orderBy(F.desc("n"), "gram"))
    kept = summed.withColumn("r", rank).where(F.col("r") <= F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS))
    return _model(sorted(sizes), kept.select("l", "kind", "gram", "n").collect())


def _model(langs: list[str], rows: list) -> dict:
    totals: Counter = Counter()
    for name, kind, _, n in rows:
        totals[name, kind] += n
    tables: dict[int, dict[str, list[float]]] = {k: {} for k in (0, *ORDERS)}
    place = {name: i for i, name in enumerate(langs)}
    for name, kind, gram, n in rows:
        scores = tables[kind].setdefault(gram, [MISSING] * len(langs))
        scores[place[name]] = math.log10(n / totals[name, kind])
    return {"langs": langs, "tables": tables}


class Scorer:
    def __init__(self, model: dict) -> None:
        self.langs, self.tables = model["langs"], model["tables"]
        self.unseen: dict[str, list[float]] = {}

    def word(self, word: str) -> list[float]:
        """Scores of an unknown word: the mean over its longest n-grams of which any is known."""
        for order in ORDERS:
            table = self.tables[order]
            found = [table[g] for g in grams(word, order) if g in table]
            if found:
                return [sum(s) / len(found) for s in zip(*found)]
        return [MISSING] * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the probability over all learned languages."""
        words = words_of(text) if text else {}
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        if len(self.unseen) > KEPT:
            self.unseen = {}
        known, unseen, total = self.tables[0], self.unseen, [0.0] * len(self.langs)
        for w, n in words.items():
            scores = known.get(w) or unseen.get(w)
            if scores is None:
                scores = unseen[w] = self.word(w)
            total = [t + n * s for t, s in zip(total, scores)]
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        odds = sum(10.0 ** max(t - total[best], -300.0) for t in total)
        return self.langs[best], 1.0 / odds


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, ``lang_pred`` and ``score`` in [0, 1].

    Each word scores the log10 of its share in each language's words; a word no language knows falls back to its
    5-grams, then 4-grams and so on to single characters. Sums over the text's words decide, ties go to the first
    language name. A null text, one without a letter, and any text when no language was learned is ``und`` with
    score 0. Repeated rows get equal results; nothing is shuffled and no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS for each language

    def start() -> Callable:
        scorer = Scorer(shared.value)

        def apply(texts):
            found = [scorer.predict(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return apply

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return per_text(docs, key, text, fields, start)
