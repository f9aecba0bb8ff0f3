"""Documents to training sequences: quality rules, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, quality, simhash, suffix_dedup
from tidemark.llm.shared import prepare, stored
from tidemark.llm.suffix_dedup import PASSAGE_BYTES, PASSAGE_WORDS
from tidemark.sources.basic import spread



def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts have too few words and go."""
    prepare(spark, docs)
    judged = quality.cascade(docs, verdict="__rejected_by")
    return judged.where("__rejected_by is null").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id (then the least text hash); of rows that
    agree in both one stays."""
    prepare(spark, docs)
    named = docs.withColumn("__id", F.struct(F.col("doc_id"), F.xxhash64("text").alias("th")))
    groups = simhash.simhash_groups(named, key="__id")
    first = groups.where(F.col("__id") == F.col("component")).select("__id").distinct()
    return named.dropDuplicates(["__id"]).join(first, "__id", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once and have over PASSAGE_WORDS words or 400 bytes;
    characters that a cut leaves incomplete go as well. A document that is left empty stays as one with an empty text."""
    prepare(spark, docs)
    named = docs.select("doc_id", "text", _others(docs))
    cut = suffix_dedup.remove_repeats(
        named, length=PASSAGE_BYTES, words=PASSAGE_WORDS, result="text", carry=("__others",)
    )
    return _with_text(cut, "kept", docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    prepare(spark, docs)
    named = docs.select(_others(docs), "text")
    found = pii.find_personal_data(named, pii.learn(docs), key="__others", mask=True)
    return _with_text(found, "masked", docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    prepare(spark, docs)
    pieces = packing.pack(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _others(docs: DataFrame) -> Column:
    """All columns but the text as one, so that their names cannot clash with those of an operator."""
    return F.struct(*[c for c in docs.columns if c != "text"]).alias("__others")


def _with_text(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents with another text and, where there is such a column, the number of its characters."""
    made = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[(made[c] if c in made else F.col("__others")[c]).alias(c) for c in columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Fingerprints, phrase classes, the random field and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    prepare(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
