"""Named queries of the operators on texts: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment,
    byte_pairs,
    language_id,
    packing,
    pii,
    quality,
    sentence_pieces,
    simhash,
    spelling,
    suffix_dedup,
    tokens,
    topk,
    warc,
)
from tidemark.llm.shared import prepare, settled
from tidemark.session import scratch_path, size_shuffles, table_bytes
from tidemark.sources.basic import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's scan; shuffles are sized for it."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size_shuffles(spark, table_bytes(rows))
    return rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a small table of fewer splits than cores is dealt out first."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


@query
def op1_language_id(spark, sf_dir):
    """Language of every text, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op2_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of its strings of 400 bytes that occur anywhere else; beside it, how many of its
    words lie in passages of over 50 words that stand in another document too, which can be shorter."""
    docs = documents(spark, sf_dir)
    passages = settled(lambda: suffix_dedup.repeated_passages(docs), "passages")
    found = suffix_dedup.remove_repeats(docs.withColumn("row", suffix_dedup.row_id()), result="sha256", carry=("row",))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    cut = found.select(
        "row",
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )
    more = F.coalesce("n_passage_words", F.lit(0).cast("bigint")).alias("n_passage_words")
    return cut.join(passages, "row", "left").select(*cut.columns[1:], more)


@query
def op3_warc(spark, sf_dir):
    """Every page written to web archives, read back and put together again by capture."""
    path = scratch_path(spark, "archive")
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, path)
    records = warc.read_records(spark, path)
    # the payload ends here: only its digest and size go on into the captures
    sized = records.select(
        "record_id",
        "type",
        "concurrent_to",
        F.when(F.col("type") == "response", F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        F.element_at("headers", "warc-payload-digest").alias("digest"),
        F.when(F.col("type") == "metadata", warc.fields_of(F.col("payload"))).alias("fields"),
    )
    captures = warc.assemble(sized)
    main, fields = F.col("main"), F.col("metadata")[0]["fields"]
    again = main["type"] == "revisit"
    return captures.select(
        F.element_at(fields, "page-id").cast("bigint").alias("page_id"),
        F.when(again, F.element_at(fields, "payload-bytes").cast("bigint")).otherwise(main["n_bytes"]).alias("payload_bytes"),
        F.when(again, F.substring(main["digest"], 6, 40)).otherwise(main["sha1"]).alias("payload_digest"),
        main["type"].alias("record_type"),
        F.element_at(fields, "refers-to-page-id").cast("bigint").alias("refers_to"),
    )


@query
def op4_exact_topk(spark, sf_dir):
    """For each hundredth vector the ten others with the highest integer inner product."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


@query
def op5_quality_rules(spark, sf_dir):
    """Measures and verdict of the quality cascade for every document."""
    return quality.measures(documents(spark, sf_dir))


@query
def op6_token_counts(spark, sf_dir):
    """Token counts of every document."""
    return tokens.token_counts(documents(spark, sf_dir))


@query
def op7_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 ids."""
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op8_pii(spark, sf_dir):
    """Personal data in every document."""
    docs = documents(spark, sf_dir)
    found = pii.find_personal_data(docs, pii.learn(docs))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        n = F.size(F.filter("base", lambda s: s["kind"] == kind))
        return n.cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[counted(k) for k in pii.KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


@query
def op9_simhash(spark, sf_dir):
    """Fingerprints and near-duplicate components of all documents."""
    groups = simhash.simhash_groups(documents(spark, sf_dir))
    return groups.select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op10_sentence_pieces(spark, sf_dir):
    """Ids of every document by the shared-prefix search, and the digest of the text they decode to."""
    docs = documents(spark, sf_dir)
    coded = sentence_pieces.encode(docs, decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op11_byte_pairs(spark, sf_dir):
    """Ids of every document by forced boundaries, and the text they decode to."""
    coded = byte_pairs.encode(documents(spark, sf_dir), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op12_alignment(spark, sf_dir):
    """Alignment of the tokens of two tokenizers in every document, with corpus counts of linked ids."""
    found = alignment.align(documents(spark, sf_dir), result="sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_spelling_variants(spark, sf_dir):
    """Frequent spellings of all words of the documents."""
    return spelling.variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
