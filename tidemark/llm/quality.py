"""Quality rules as a short-circuit cascade, in DataFrame functions alone."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
SPAN = 8
# Bullets, and frequent function words of English, French, German and Spanish.
BULLETS = "•‣●*–-"
STOP_WORDS = (
    "the of and to in that it is was for on with as at by from this are be or "
    "de la le les et des en un une que du est pour dans "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine "
    "el los del las por con para se es al lo su"
).split()
#: Texts the cost and selectivity of the rules are estimated on, as expected rows of the sample.
SAMPLE_ROWS = 2000
SEED = 17


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("bigint")


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.regexp_count(text, F.lit(rf"{WORD}[^\n]*")).cast("bigint")


def n_bullets(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?md)^[\x20\x09]*[{BULLETS}]")).cast("bigint")


def n_ellipses(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?md)(\.\.\.|…)[\x20\x09\r]*$")).cast("bigint")


def n_alphabetic(text: Column) -> Column:
    """Words with a letter."""
    return F.regexp_count(text, F.lit(rf"\p{{L}}{WORD}*")).cast("bigint")


def top_pair(words: Column) -> Column:
    """How often the most frequent two neighbouring words stand, or 0 where so many pairs differ that it cannot be a fifth of
    all: texts whose pairs nearly all differ are not sorted."""
    pairs = _doubled(1)(F.transform(words, lambda w: F.xxhash64(w)))

    def longest(h: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("of"), F.lit(0).alias("run"), F.lit(0).alias("top"))

        def step(a: Column, x: Column) -> Column:
            run = F.when(a["of"] == x, a["run"]).otherwise(F.lit(0)) + 1
            return F.struct(x.alias("of"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

        return F.aggregate(F.sort_array(h), start, step, lambda a: a["top"])

    def counted(h: Column) -> Column:
        few = F.size(F.array_distinct(h)) * 5 < F.size(h) * 4 + 5
        return F.when(few, longest(h)).otherwise(F.lit(0))

    return let(pairs, counted).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def _doubled(width: int):
    """Hashes of windows twice as wide, from those of windows of ``width`` words."""

    def wider(h: Column) -> Column:
        n = F.greatest(F.size(h) - width, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, width + 1, n), lambda a, b: F.xxhash64(a, b))

    return wider


def n_repeat_words(words: Column, span: int = SPAN) -> Column:
    """Words in windows of ``span`` words (a power of two) that are found twice or more in the text.

    Window hashes come from doubling the width. Texts whose hashes all differ stop there; the others sort
    (hash, place), keep the places whose neighbour has the same hash and add up what the windows cover.
    """
    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < span:
        hashes = let(hashes, _doubled(width))
        width *= 2

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
                        ),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
                lambda a, i: F.struct(
                    (a["total"] + i + span - F.greatest(a["end"], i)).alias("total"), (i + span).alias("end")
                ),
                lambda a: a["total"],
            ),
        )

    return F.when(F.size(words) < span, F.lit(0)).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
    ).cast("bigint")


@dataclass(frozen=True)
class Rule:
    """A name and the condition for rejecting a row, over the columns ``words`` and ``text``."""

    name: str
    rejects: Column


def base_rules(words: Column) -> list[Rule]:
    return [
        Rule("few_words", F.size(words) < 20),
        Rule("repeated_words", n_repeat_words(words) * 100 > F.size(words) * 30),
    ]


def counts_of(text: Column, words: Column) -> dict[str, Column]:
    """What more than one rule or column needs of a text."""
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": word_chars(words),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_lines": n_lines(text),
    }


def shape_rules(text: Column, words: Column, counts: dict[str, Column] | None = None) -> list[Rule]:
    """Rules beyond the base ones, with wide bounds: a clean text passes all of them. ``counts`` are columns that hold
    what ``counts_of`` gives; without them each rule counts for itself."""
    c = counts or counts_of(text, words)
    n, lines = c["n_words"], c["n_lines"]
    return [
        Rule("symbols", c["n_symbols"] * 5 > n),
        Rule("word_length", (c["word_chars"] < n * 2) | (c["word_chars"] > n * 20)),
        Rule("duplicate_lines", c["n_dup_lines"] * 2 > lines),
        Rule("short_lines", n < lines * 2),
        Rule("bullets", n_bullets(text) * 10 > lines * 9),
        Rule("ellipses", n_ellipses(text) * 10 > lines * 3),
        Rule("alphabetic_words", n_alphabetic(text) * 10 < n * 6),
        Rule("stop_words", (n >= 100) & ~F.exists(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        Rule("top_pair", (n >= 20) & (top_pair(words) * 5 > n - 1)),
    ]


def order_rules(sample: DataFrame, rules: list[Rule], clock=time.perf_counter) -> list[Rule]:
    """The rules by rejections per second on the sample, the best first.

    Each rule runs alone over the sample; a plain count of it is the part of the time that no rule causes. The
    order changes how long the cascade takes, never its result.
    """

    def timed(condition: Column) -> tuple[float, int]:
        start = clock()
        n = sample.agg(F.sum(F.when(condition, 1).otherwise(0)), F.count("text"), F.count("words")).first()[0]
        return clock() - start, n or 0

    idle, _ = timed(F.lit(False))
    rates = []
    for rule in rules:
        took, rejected = timed(rule.rejects)
        rates.append((rejected / max(took - idle, 1e-3), rule))
    return [rule for _, rule in sorted(rates, key=lambda r: -r[0])]


def sample_of(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts, drawn evenly from the whole table, as columns ``text`` and ``words``; empty tables give
    none."""
    fraction = min(1.0, rows / max(1, docs.count()))
    drawn = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(fraction, SEED)
    return stored(drawn.select("text", words_of(F.col("text")).alias("words")), "quality-sample")


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; rules after it are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def cascade(docs: DataFrame, text: str = "text", verdict: str = "rejected_by") -> DataFrame:
    """All columns and rows of ``docs`` and ``verdict``: the first rule of the cascade that rejects the text, null for
    kept texts.

    A null text is an empty one and has too few words. Repeated rows get the same verdict, an empty table gives
    none. Other columns are passed on whatever their names; one named as the verdict is replaced.
    """
    order = order_rules(sample_of(docs, text), [*base_rules(F.col("words")), *shape_rules(F.col("text"), F.col("words"))])
    names = {r.name: i for i, r in enumerate(order)}
    own = F.coalesce(F.col(text), F.lit(""))
    rules = [*base_rules(F.col("__words")), *shape_rules(own, F.col("__words"))]
    rules.sort(key=lambda r: names[r.name])
    # a generator of one row: a later filter on the verdict stays above it, so words are split once
    split = docs.drop(verdict).select("*", F.explode(F.array(words_of(own))).alias("__words"))
    judged = split.select("*", F.explode(F.array(first_rejection(rules))).alias(verdict))
    return judged.drop("__words")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` and ``kept``: false where the base rules fail, else what the cascade of the other rules says.
    Null texts have no words; nothing is shuffled."""
    order = order_rules(sample_of(docs, text), shape_rules(F.col("text"), F.col("words")))
    names = {r.name: i for i, r in enumerate(order)}
    own = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("__key"), own.alias("__text"), F.explode(F.array(words_of(own))).alias("__words"))
    text_, words = F.col("__text"), F.col("__words")
    # a generator of one row: the rules read the counts and do not count again
    counts = {**counts_of(text_, words), "n_repeat_words": n_repeat_words(words)}
    counted = split.select("__key", "__text", "__words", F.inline(F.array(F.struct(*[c.alias(n) for n, c in counts.items()]))))
    rules = shape_rules(text_, words, {n: F.col(n) for n in counts})
    rules.sort(key=lambda r: names[r.name])
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return counted.select(
        F.col("__key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(first_rejection(rules).isNull()).alias("kept"),
    )
