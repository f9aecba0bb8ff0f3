"""The pipeline against a plain version of its stages, on odd texts and on a small table."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zlib
from tokenizers import Tokenizer

import corpus_pipeline
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.conftest import SMALL, words
from tidemark.llm import pii
from tidemark.llm.packing import TOKENIZER
from tidemark.llm.queries import QUERIES
from tidemark.llm.shared import stored
from tidemark.llm.sql import ORACLE


good = brute.good


def one_of_each(rows):
    """(doc_id, text) rows: of each component the least by (doc_id, hash of the text), nulls first."""

    def identity(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return (row[0] is not None, row[0] or 0, h - 2**64 if h >= 2**63 else h)

    groups = brute.components([brute.fingerprint(t) for _, t in rows])
    first: dict = {}
    for row, g in zip(rows, groups, strict=True):
        first[g] = min(first.get(g, row), row, key=identity)
    return list(first.values())


def without_repeats(rows, length=corpus_pipeline.PASSAGE_BYTES):
    """Runs of strings that start elsewhere too go if they cover 400 bytes or over 50 words."""
    out = []
    texts = [t.encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    for (k, _), data in zip(rows, texts, strict=True):
        gone = np.zeros(len(data), bool)
        again = [i for i in range(len(data) - length + 1) if seen[data[i : i + length]] > 1]
        for n, i in enumerate(again):
            if n == 0 or again[n - 1] != i - 1:
                first = i
            if n + 1 == len(again) or again[n + 1] != i + 1:
                end = i + length
                if end - first >= 400 or len(data[first:end].split()) > 50:
                    gone[first:end] = True
        out.append((k, bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("table", ["odd", "small"])
def test_stages(prepared, odd, table):
    docs = odd if table == "odd" else prepared.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = stored(stages[name](prepared, df, SMALL), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r["n_chars"] in (None, len(r["text"])) for r in out.collect())
        return out

    df = run("quality_rules", docs)
    rows = [(k, t) for k, t in rows if good(t)]
    assert pairs(df) == Counter(rows)

    df = run("near_duplicates", df)
    rows = one_of_each(rows)
    assert pairs(df) == Counter(rows)

    df = run("repeated_passages", df)
    rows = without_repeats(rows)
    assert pairs(df) == Counter(rows)

    field = pii.Field(pii.learn(df))
    df = run("personal_data", df)
    rows = [(k, pii.masked(t, field.spans(t, pii.base_spans(t)))) for k, t in rows]
    assert pairs(df) == Counter(rows)
    assert not any(pii.base_spans(t) for _, t in rows)

    pieces = run("packing", df).orderBy("sequence_id", "offset").collect()
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    expected = Counter()
    for k, t in rows:
        expected[k, len(whole.encode(t, add_special_tokens=False).ids) + 1] += 1
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == expected
    assert [p["sequence_id"] * 1024 + p["offset"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
    if table == "small":
        ids = {k: np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in rows}
        for p in pieces:
            own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(own.tobytes()) == p["ids_crc32"]
        whole_run = corpus_pipeline.run(prepared, SMALL)
        assert Counter((r["doc_id"], r["doc_tokens"]) for r in whole_run.where("start = 0").collect()) == expected


def test_empty_table(prepared, none):
    df = none
    for name, stage in corpus_pipeline.STAGES:
        df = stored(stage(prepared, df, SMALL), name)
        assert df.count() == 0
    assert "sequence_id" in df.columns


def test_packing_stage_on_long_blank_runs(prepared):
    docs = prepared.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(i, f"a{blank * 1_200_000}b") for i, blank in enumerate((" ", "\n", "\t", "\u00a0"))]
    df = prepared.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], docs.schema)
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    pieces = corpus_pipeline.packed(prepared, df, SMALL).where("start = 0").collect()
    expected = {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows}
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == expected


def test_planted_copies_and_passages(prepared):
    """Exact and near copies go but for one, a passage that documents share goes, clean documents stay as they are."""
    docs = prepared.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.where("length(text) between 1500 and 4000").orderBy("doc_id").limit(60).collect()]
    texts = [t for t in texts if good(t) and "\n" in t][:12]
    passage = texts[-1][:600]
    rows = [(i, t) for i, t in enumerate(texts[:6])]
    rows += [(100 + i, texts[0]) for i in range(5)] + [(200 + i, texts[1] + f" tail{i}") for i in range(3)]
    rows += [(300 + i, f"{t} {passage} end{i}.") for i, t in enumerate(texts[6:9])]
    df = prepared.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], docs.schema)
    kept = corpus_pipeline.near_duplicates(prepared, corpus_pipeline.quality_rules(prepared, df, SMALL), SMALL)
    expected = one_of_each([(k, t) for k, t in rows if good(t)])
    assert pairs(kept) == Counter(expected)
    assert not {k for k, _ in expected} & set(range(100, 105))
    left = corpus_pipeline.repeated_passages(prepared, kept, SMALL)
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert all(passage not in got[k] for k in (300, 301, 302) if k in got)
    assert all(got[k] == t for k, t in expected if k < 100 and passage not in t)


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(prepared, name):
    assert compare(QUERIES[name](prepared, SMALL), connect(SMALL), ORACLE[name]) is None


def test_every_query_is_registered(prepared):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_passages_of_51_words(prepared):
    """A passage of 51 short words in three documents goes; one of 45 words and the documents around them stay."""
    docs = prepared.read.parquet(f"{SMALL}/documents.parquet")
    around = [words(60, 100 + i) for i in range(6)]
    short = words(45, 99)
    passage = " ".join(w[:4] for w in words(51, 98).split())
    tiny = " ".join(w[:2] for w in words(51, 97).split())
    assert all(corpus_pipeline.PASSAGE_BYTES <= len(p) < 300 for p in (short, passage, tiny))
    assert len(tiny) == 51 * 3 - 1
    rows = [(i, f"{around[2 * i]} Q {passage} {'XYZ'[i]} {around[2 * i + 1]}") for i in range(3)]
    rows += [(10 + i, f"{words(50, 200 + i)} {'UVW'[i]} {short} {'RST'[i]} {words(50, 300 + i)}") for i in range(3)]
    rows += [(20 + i, f"{words(50, 400 + i)} {'XYZ'[i]} {tiny} {'RST'[i]} {words(50, 500 + i)}") for i in range(3)]
    df = prepared.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], docs.schema)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(prepared, df, SMALL).collect()}
    for i in range(3):
        assert got[i] == f"{around[2 * i]}{'XYZ'[i]} {around[2 * i + 1]}"
        assert got[10 + i] == dict(rows)[10 + i]
        assert tiny not in got[20 + i] and got[20 + i].startswith(words(50, 400 + i)) and got[20 + i].endswith(words(50, 500 + i))
