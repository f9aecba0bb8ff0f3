"""Each operator against a plain version, on odd texts and on the small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import SMALL, odd_texts, words
from tests.llm.test_pipeline import without_repeats
from tidemark.llm import language_id, packing, pii, quality, sentence_pieces, simhash, suffix_dedup, tokens, topk, warc
from tidemark.llm.queries import QUERIES
from tidemark.session import scratch_path


@pytest.fixture(scope="module")
def small_texts(prepared):
    rows = prepared.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def by_key(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- repeated passages ---------------------------------------------------------------------------------------


def test_repeats_of_small_table(prepared, small_texts):
    found = by_key(QUERIES["op2_suffix_dedup"](prepared, SMALL), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = brute.repeats([t for _, t in small_texts])
    assert found == {k: e for (k, _), e in zip(small_texts, expected, strict=True)}


def test_passages_of_odd_texts(odd):
    found = suffix_dedup.remove_repeats(odd, length=suffix_dedup.PASSAGE_BYTES, words=50, result="text")
    texts = [(k, t or "") for k, t in odd_texts()]
    assert rows_of(found.select("doc_id", "kept")) == Counter(without_repeats(texts))


def test_many_copies_of_a_row(prepared):
    """Hundreds of copies of a long row, with and without a key, beside variants of its parts."""
    long = words(2500, 70)
    rows = [(k, long) for k in [1] * 300 + [None] * 300] + [(2, None)] * 50 + [(3, "short")] * 50
    rows += [(10 + i, f"{words(40, 80 + i)} {long[i * 900 : i * 900 + 3000]} {words(40, 90 + i)}") for i in range(4)]
    df = prepared.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(df, result="sha256")
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    got = rows_of(found.select("doc_id", "n_bytes", size, F.size("spans"), "kept_sha256"))
    few = [(1, long), (None, long), (3, "short"), (2, None), *rows[-4:]]  # two copies repeat as many do
    plain = dict(zip([(k, t) for k, t in few], brute.repeats([t for _, t in few]), strict=True))
    assert got == Counter((k, *plain[k, t]) for k, t in rows)


@pytest.mark.parametrize("length", [32, 50, 400])
def test_repeats_of_odd_texts(odd, length):
    found = suffix_dedup.remove_repeats(odd, length=length, result="sha256")
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    got = rows_of(found.select("doc_id", "n_bytes", size, F.size("spans"), "kept_sha256"))
    texts = odd_texts()
    expected = brute.repeats([t for _, t in texts], length)
    assert got == Counter((k, *e) for (k, _), e in zip(texts, expected, strict=True))


def test_repeats_in_pieces(prepared, monkeypatch):
    texts = [t for _, t in odd_texts() if t]
    whole = {(i, lo + j) for i, lo, n, *_ in suffix_dedup.phrases([t.encode() for t in texts], 400) for j in range(n)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    cut = [(i, lo + j) for i, lo, n, *_ in suffix_dedup.phrases([t.encode() for t in texts], 400) for j in range(n)]
    assert len(cut) == len(set(cut)) and set(cut) == whole
    assert whole == {(i, j) for i, t in enumerate(texts) for j in range(len(t.encode()) - 399)}


def test_kept_text_and_carried_columns(odd):
    cut = suffix_dedup.remove_repeats(odd, result="text", carry=("lang", "k"))
    assert cut.columns == ["doc_id", "lang", "k", "n_bytes", "spans", "kept"]
    rows = cut.collect()
    assert {r["k"] for r in rows} == {"clash"}
    plain = {k: t or "" for k, t in odd_texts()}
    assert all(r["kept"] == plain[r["doc_id"]] for r in rows if r["doc_id"] is not None and not r["spans"] and r["doc_id"] != 9)


def passage_words(df, words=50):
    found = suffix_dedup.repeated_passages(df, words=words).collect()
    by_row = {r["row"]: r["n_passage_words"] for r in found}
    assert len(by_row) == len(found) and all(n > words for n in by_row.values())
    rows = df.select("doc_id", "text", suffix_dedup.row_id().alias("row")).collect()
    return Counter((r["doc_id"], r["text"], by_row.get(r["row"], 0)) for r in rows)


def test_passage_words_of_small_table(prepared, small_texts):
    found = by_key(QUERIES["op2_suffix_dedup"](prepared, SMALL), "doc_id", "n_passage_words")
    plain = brute.passage_words([t for _, t in small_texts])
    assert found == {k: (n,) for (k, _), n in zip(small_texts, plain, strict=True)}
    assert any(plain)


@pytest.mark.parametrize("size", [16, 50])
def test_passage_words_of_odd_texts(odd, size):
    texts = odd_texts()
    plain = brute.passage_words([t for _, t in texts], size)
    assert passage_words(odd, size) == Counter((k, t, n) for (k, t), n in zip(texts, plain, strict=True))


def test_passages_under_400_bytes(prepared):
    """Passages of 51 words and 50, of one letter, across white space, within one row alone, at either end, in copies."""
    a, b, c = words(51, 1), words(50, 2), words(200, 3)
    texts = [
        f"{words(40, 4)} {a} {words(40, 5)}", f"{a} {words(70, 6)}", f"{words(70, 7)}\n" + a.replace(" ", " \t\r\n"),
        f"{words(40, 8)} {b} {words(40, 9)}", f"{b} {words(70, 10)}",
        f"{words(60, 11)} {words(3, 12)} {words(60, 11)}",
        f"{words(60, 13)} {c[:600]} {words(60, 14)}", f"{words(9, 15)} {c[100:500]} {words(60, 16)}", c[300:],
        *(" ".join(words(9, 20 + i % 3) for i in range(j, j + 12)) for j in range(3)),
        "x " * 900, "x " * 50, "x y " * 30, "x " * 51,
    ]
    rows = [(i % 12, t) for i, t in enumerate(texts)] + [(None, c), (None, c), (8, texts[8])]
    plain = brute.passage_words([t for _, t in rows])
    assert plain[:6] == [51, 51, 51, 0, 0, 0] and min(plain[6:12]) > 50
    df = prepared.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert passage_words(df) == Counter((k, t, n) for (k, t), n in zip(rows, plain, strict=True))
    first = prepared.createDataFrame(rows[:6], "doc_id long, text string")
    assert not any(r["spans"] for r in suffix_dedup.remove_repeats(first, result="sha256").collect())


def test_word_phrases_in_pieces(monkeypatch):
    texts = [t for _, t in odd_texts() if t]
    whole = list(suffix_dedup.word_phrases(texts, 51))
    starts = [(i, lo + j) for i, lo, n, *_ in whole for j in range(n)]
    assert starts == [(i, j) for i, t in enumerate(texts) for j in range(len(brute.SPACE.findall(t)) - 50)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert list(suffix_dedup.word_phrases(texts, 51)) == whole


# --- archives ----------------------------------------------------------------------------------------------


def captured(pages):
    path = scratch_path(pages.sparkSession, "archive")
    warc.write_archive(pages, path)
    return warc.assemble(warc.read_records(pages.sparkSession, path))


def test_odd_pages(prepared):
    large, tricky = "é" * 600, "a\r\n\r\nWARC/1.1\r\n\r\r\n\r\n\n\n" + "z" * 1000 + "\r\n"
    pages = [
        (1, "http://a/1", large),
        (2, "http://a/2 x\r\ny", large),
        (3, None, large),
        (4, "http://a/4", tricky),
        (4, "http://a/4", tricky),
        (5, "http://a/5", "short"),
        (6, "http://a/6", "short"),
        (7, "http://a/7", None),
        (8, "http://a/8", ""),
        (None, "http://a/9", "n" * 2000),
        (None, "http://a/9", "n" * 2000),
    ]
    df = prepared.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    rows = captured(df).collect()
    got = Counter()
    for r in rows:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        assert r["requests"][0]["concurrent_to"] == r["capture_id"] == r["main"]["record_id"]
        fields = dict(x.split(": ", 1) for x in bytes(r["metadata"][0]["payload"]).decode().split("\r\n") if x)
        got[
            int(fields["page-id"]) if "page-id" in fields else None,
            bytes(r["main"]["payload"]).decode(),
            r["main"]["type"],
            int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None,
        ] += 1
    expected = Counter()
    for k, _, html in pages:
        first = 3 if html == large else None
        again = first is not None and k != first
        expected[k, "" if again else html or "", "revisit" if again else "response", first if again else None] += 1
    assert got == expected


def test_no_pages(prepared):
    pages = prepared.createDataFrame([], "page_id long, url string, html string")
    assert captured(pages).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=60), st.sampled_from([b"\r\n", b"", b"\n"])), max_size=5))
def test_records_survive_any_block(blocks):
    data = b""
    for block, tail in blocks:
        block += tail
        data += b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    lines = iter(data.split(b"\n")[:-1])
    assert [b for _, b in warc.parse_records(lines)] == [b + t for b, t in blocks]


# --- top-k -------------------------------------------------------------------------------------------------


def plain_top(rows, k=10, step=1):
    out = set()
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    scaled = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in usable]
    for i, v in scaled:
        if i % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in scaled if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def test_top_of_small_table(prepared):
    rows = [tuple(r) for r in prepared.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {tuple(r) for r in QUERIES["op4_exact_topk"](prepared, SMALL).collect()}
    assert got == plain_top(rows, step=100)


def test_top_of_odd_vectors(prepared, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 3)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "SPREAD", 2)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [0.0, 0.0]), (4, [1.0]), (5, []), (6, None),
        (7, [nan, 0.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [-3.0, 2.0, 5.0]), (11, [0.1, 0.2]),
    ]
    df = prepared.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    for k in (2, 10):
        rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        assert {tuple(r) for r in topk.top_k(df, df, k=k).collect()} == plain_top(rows32, k)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    twice = df.where("vec_id in (0, 4)").unionByName(df.where("vec_id = 0"))
    assert [tuple(r) for r in topk.top_k(twice, twice).where("query_id = 4").orderBy("rank").collect()] == [
        (4, 1, 0, 512 * 1024), (4, 2, 0, 512 * 1024)
    ]


def test_accumulation_skips_zero_terms():
    rng = np.random.default_rng(1)
    q, t = rng.integers(-3, 4, (5, 40)), rng.integers(-3, 4, (40, 30))
    q[rng.random(q.shape) < 0.7] = 0
    t[rng.random(t.shape) < 0.7] = 0
    assert (topk.accumulate(q, t) == q @ t).all()


# --- quality -------------------------------------------------------------------------------------------------


def test_measures(odd, prepared, small_texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = Counter()
    for k, t in odd_texts():
        m = brute.measures(t)
        expected[k, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]] += 1
    assert rows_of(quality.measures(odd).select("doc_id", *names)) == expected
    found = by_key(QUERIES["op5_quality_rules"](prepared, SMALL), "doc_id", *names[:5])
    assert found == {k: brute.measures(t) for k, t in small_texts}


def test_kept_is_the_cascade(odd, none):
    kept = rows_of(quality.measures(odd).where("kept").select("doc_id"))
    assert rows_of(quality.cascade(odd).where("rejected_by is null").select("doc_id")) == kept
    assert quality.cascade(odd).count() == len(odd_texts())
    assert set(quality.cascade(odd).columns) == set(odd.columns)
    assert quality.cascade(none).count() == quality.measures(none).count() == 0


JUNK = {
    "symbols": words(80, 61).replace(" ", " #|# ") + " the",
    "short_lines": words(60, 62).replace(" ", "\n"),
    "bullets": "\n".join(f"  - {words(6, 700 + i)} the" for i in range(12)) + "\n\n",
    "ellipses": "\n".join(f"{words(6, 720 + i)} the... \t" for i in range(12)),
    "alphabetic_words": words(30, 63) + " 12 3.4" * 40 + " the",
    "stop_words": words(120, 64),
    "top_pair": " ".join(f"{words(2, 740 + i)} of it" for i in range(40)),
    "word_length": "a " * 10 + " ".join(str(i) + "x" * 40 for i in range(60)) + " the",
    "duplicate_lines": "\n".join([words(9, 65)] * 2 + [words(9, 66) + " x"] * 2 + [words(9, 66) + " y"] * 2 + ["of it"] * 20),
    "blank runs": words(60, 67) + " " * 300_000 + "\n" * 200_000 + "." * 200_000 + " the " + "7" * 200_000,
}


def test_each_rule_rejects_its_junk(prepared):
    clean = [words(70, 800 + i).replace("a ", "the ") + " and so on." for i in range(5)]
    clean += ["\n".join(words(12, 900 + i) + " of" for i in range(10))]
    rows = [*((name, text) for name, text in JUNK.items()), *((f"clean {i}", t) for i, t in enumerate(clean))]
    df = prepared.createDataFrame(rows, "doc_id string, text string")
    found = by_key(quality.cascade(df), "doc_id", "rejected_by")
    assert {k: v is None for k, (v,) in found.items()} == {k: brute.good(t) for k, t in rows}
    assert by_key(quality.measures(df), "doc_id", "kept") == {k: (brute.good(t),) for k, t in rows}
    rules = {r.name: r for r in quality.shape_rules(F.col("text"), quality.words_of(F.col("text")))}
    for name in rules:
        assert df.where(rules[name].rejects).where(F.col("doc_id") == name).count() == 1, name
        assert df.where(rules[name].rejects).where(F.col("doc_id").startswith("clean")).count() == 0, name


def test_clean_texts_are_kept(prepared):
    kept = QUERIES["op5_quality_rules"](prepared, SMALL)
    labels = prepared.read.parquet(f"{SMALL}/labels.parquet")
    rows = kept.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in rows)


def test_order_follows_rejections_per_second(prepared):
    sample = prepared.range(10).select(F.lit("x").alias("text"), F.array(F.lit("x")).alias("words"))
    ticks = iter([0.0, 1.0, 10.0, 13.0, 20.0, 22.0, 30.0, 31.5])
    rules = [quality.Rule("dear", F.lit(True)), quality.Rule("cheap", F.lit(True)), quality.Rule("idle", F.lit(False))]
    assert [r.name for r in quality.order_rules(sample, rules, lambda: next(ticks))] == ["cheap", "dear", "idle"]


def test_no_python_in_quality_plans(odd):
    for df in (quality.measures(odd), quality.cascade(odd).where("rejected_by is null")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- tokens and packing -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces_model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))


def test_token_counts(odd, none, pieces_model, small_texts, prepared):
    expected = Counter()
    for k, t in odd_texts():
        n = len(pieces_model.encode(t or ""))
        expected[k, len((t or "").encode()), n, n > 4096] += 1
    assert rows_of(tokens.token_counts(odd)) == expected
    assert tokens.token_counts(none).count() == 0
    found = by_key(QUERIES["op6_token_counts"](prepared, SMALL), "doc_id", "n_tokens")
    assert found == {k: (len(pieces_model.encode(t)),) for k, t in small_texts}


@settings(max_examples=300, deadline=None)
@given(st.text("ab ▁\n\t.é日\x00<s>", max_size=30))
def test_safe_boundaries(text):
    counter = test_safe_boundaries.__dict__.setdefault("counter", tokens.PieceCounter(public_tokenizers.path(tokens.MODEL)))
    assert counter.lengths([text]) == [len(counter.encoder.encode(text))]


def test_packing(odd, none):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = Counter((k, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 0])) for k, t in odd_texts())
    rows = packing.pack(odd).orderBy("sequence_id", "offset").collect()
    place, texts = 0, []
    for r in rows:
        assert (r["sequence_id"], r["offset"]) == divmod(place, 1024) and 1 <= r["length"] <= 1024 - r["offset"]
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        if r["start"] == 0:
            texts.append((r["doc_id"], r["doc_tokens"], []))
        assert texts[-1][0] == r["doc_id"] and len(texts[-1][2]) == r["start"]
        texts[-1][2].extend(ids)
        place += r["length"]
    assert Counter((k, tuple(ids)) for k, _, ids in texts) == expected
    assert all(n == len(ids) for _, n, ids in texts)
    assert packing.pack(none).count() == 0
    packed = packing.sequences(packing.pack(odd)).orderBy("sequence_id").collect()
    flat = [i for _, _, ids in texts for i in ids]
    assert [i for r in packed for i in r["ids"][: r["n"]]] == flat
    assert all(len(r["ids"]) == 1024 for r in packed) and all(r["n"] == 1024 for r in packed[:-1])


BLANK_RUNS = [(i, f"a{blank * 2_000_000}b") for i, blank in enumerate((" ", "\n", "\t", "\u00a0"))]


def test_packing_of_long_blank_runs(prepared):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    df = prepared.createDataFrame(BLANK_RUNS, "doc_id long, text string").repartition(4)
    pieces = packing.pack(df).select("doc_id", "start", F.crc32("ids").alias("crc"), "length", "doc_tokens").collect()
    expected = {}
    for k, t in BLANK_RUNS:
        expected[k] = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
    assert sum(p["length"] for p in pieces) == sum(map(len, expected.values()))
    for p in pieces:
        own = expected[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["crc"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())


def test_five_megabytes_without_a_space(prepared, pieces_model):
    text = words(1_200_000, 44).replace(" ", "")[:5_000_000]
    df = prepared.createDataFrame([(1, text, "xx"), (2, "plain words", "xx")], "doc_id long, text string, lang string").repartition(2)
    n = len(pieces_model.encode(text))
    assert by_key(tokens.token_counts(df), "doc_id", "n_bytes", "n_tokens")[1] == (5_000_000, n)
    assert by_key(sentence_pieces.encode(df), "doc_id", "n_tokens")[1] == (n,)
    assert by_key(pii.find_personal_data(df, pii.learn(df)), "doc_id", F.size("spans"))[1] == (0,)
    found = by_key(language_id.identify(df, language_id.learn(df)), "doc_id", "lang_pred")
    assert found[1] == ("xx",)


def test_packing_crc(prepared, small_texts):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {k: np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in small_texts}
    rows = QUERIES["op7_packing"](prepared, SMALL).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))


# --- personal data ------------------------------------------------------------------------------------------------


def listed(spans):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def test_personal_data(odd, none, prepared, small_texts):
    model = pii.learn(odd)
    rows = pii.find_personal_data(odd, model, mask=True).collect()
    assert Counter((r["doc_id"], listed(r["base"])) for r in rows) == Counter((k, brute.personal(t)[1]) for k, t in odd_texts())
    for r in rows:
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    masked = next(r["masked"] for r in rows if r["doc_id"] == 13)
    assert "<EMAIL>" in masked and "4111 1111" not in masked and "10.0.0.255" not in masked
    assert pii.find_personal_data(none, pii.learn(none)).count() == 0
    found = by_key(QUERIES["op8_pii"](prepared, SMALL), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for k, t in small_texts:
        counts, joined = brute.personal(t)
        assert found[k] == (*counts, hashlib.sha256(joined.encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-+1 20(5", max_size=40))
def test_patterns(text):
    found = ",".join(f"{pii.KINDS[k]}:{i}:{j}" for i, j, k in pii.base_spans(text))
    assert found == brute.personal(text)[1]


def test_likeness_alone_adds_nothing(prepared):
    """Numbers of a card's length that fail the check stay, even if they repeat; a phone number keeps its label without
    its prefix."""
    docs = prepared.read.parquet(f"{SMALL}/documents.parquet")
    field = pii.Field(pii.learn(docs))
    for text in ("order 4111111111111112 and 4111111111111112 again 4111111111111112", "in 2024 we sold 1234567 of 1234567"):
        assert field.spans(text, pii.base_spans(text)) == []


def test_labels_are_carried_along_skips():
    """The same digits with other separators, far from the first mention, take its label; plain numbers do not."""
    rows = [("digits 12-19|letters 0|dots 3|dashes 0|at False plus False bracket False", -1, pii.OUTSIDE, 5)]
    for kind in (pii.CHAIN, pii.SAME, pii.ALIKE):
        for label in range(pii.LABELS):
            rows.append((str(kind), label, label, 200))
    model = pii._trained(rows)
    model["weights"][:] *= 0.2
    text = f"pay 4111 1111 1111 1111 now {'and so on ' * 50} to 4111.1111.1111.1111, not 1234567890 nor 2024"
    base = pii.base_spans(text)
    spans = pii.Field(model).spans(text, base)
    assert [text[i:j] for i, j, _ in spans] == ["4111 1111 1111 1111", "4111.1111.1111.1111"]


def test_labels_reach_thirty_repeats():
    """Each of thirty repeats without the prefix takes the label of the one match, before or after it."""
    rows = [("digits 12-19|letters 0|dots 0|dashes 0|at False plus False bracket False", -1, pii.OUTSIDE, 5)]
    for kind in (pii.CHAIN, pii.SAME, pii.ALIKE):
        for label in range(pii.LABELS):
            rows.append((str(kind), label, label, 20000))
    model = pii._trained(rows)
    model["weights"][:] *= 0.02
    repeats = [f"{'and so on ' * 20}0049301234567 " for _ in range(30)]
    for texts in (["call +49 30 1234567 ", *repeats], [*repeats, "call +49 30 1234567 "]):
        text = "".join(texts)
        spans = pii.Field(model).spans(text, pii.base_spans(text))
        assert len(spans) == 31 and {k for *_, k in spans} == {pii.KINDS.index("phone")}


# --- near-duplicates -------------------------------------------------------------------------------------------------


def test_fingerprints_and_components(odd, none, prepared, small_texts):
    for texts, df in ((odd_texts(), odd), (small_texts, prepared.read.parquet(f"{SMALL}/documents.parquet"))):
        fps = [brute.fingerprint(t) for _, t in texts]
        groups = brute.components(fps)
        least: dict = {}
        for (k, _), g in zip(texts, groups, strict=True):
            least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
        got = rows_of(simhash.simhash_groups(df).select("doc_id", simhash.hex_digits(F.col("fp")), "component"))
        assert got == Counter((k, f"{f:016x}", least[g]) for (k, _), f, g in zip(texts, fps, groups, strict=True))
    assert simhash.simhash_groups(none).count() == 0


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return sorted({*base.tolist(), *near.tolist(), *(near ^ np.uint64(1)).tolist()})


@pytest.mark.parametrize("thresholds", [(1, 1), (3, -1), (0, 2), (0, 0, 1), (-1, 1, 1), (0, 0, 0, 0), (2, -1, 0, -1)])
def test_links_at_any_thresholds(prepared, monkeypatch, thresholds):
    values = planted(150, 3)
    pairs = {
        (a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3
    }
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = prepared.createDataFrame([(s,) for s in signed], "fp long")
    if -1 in thresholds and 3 in thresholds or thresholds == (0, 2):
        sizes = [20, 44] if 3 in thresholds else [40, 24]
    else:
        sizes = [64 // len(thresholds)] * (len(thresholds) - 1)
        sizes.append(64 - sum(sizes))
    order, parts = np.random.default_rng(0).permutation(64).tolist(), []
    for size, threshold in zip(sizes, thresholds, strict=True):
        parts.append((sorted(order[:size]), threshold))
        order = order[size:]
    monkeypatch.setattr(simhash, "choose_parts", lambda *a: parts)
    got = {tuple(sorted(x % 2**64 for x in r)) for r in simhash.links(fps, len(values)).collect()}
    assert got == pairs


@pytest.mark.parametrize("crowd", [0, 2, 6])
def test_crowds_keep_their_components(prepared, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    values = planted(60, 4)
    hub = values[0]
    values = sorted({*values, *(hub ^ (1 << i) ^ (1 << j) for i in range(0, 40, 5) for j in range(i, 64, 9))})
    fps = prepared.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    pairs = {tuple(x % 2**64 for x in r) for r in simhash.links(fps, len(values)).collect()}
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in pairs)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[root(a)] = root(b)
    expected = brute.components(values)
    found = [root(v) for v in values]
    assert len(set(zip(found, expected, strict=True))) == len(set(found)) == len(set(expected))


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        costs = rng.random((3, 5)).tolist()
        plain = min(
            sum(costs[i][t + 1] for i, t in enumerate(ts))
            for ts in np.ndindex(5, 5, 5)
            for ts in [tuple(t - 1 for t in ts)]
            if sum(ts) == 1
        )
        cost, chosen = simhash.allocate(costs, 1)
        assert sum(chosen) == 1 and abs(cost - plain) < 1e-12


def test_grouped_bits_keep_correlated_ones_together():
    correlation = np.eye(64)
    for a, b in ((0, 63), (1, 40), (7, 9)):
        correlation[a, b] = correlation[b, a] = 0.9
    groups = simhash.grouped_bits(correlation, 2)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(any({a, b} <= set(g) for g in groups) for a, b in ((0, 63), (1, 40), (7, 9)))


# --- languages -------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(prepared):
    docs = prepared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op1_language_id"](prepared, "/root/testdata/sf0.01")
    held = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)


def test_languages_of_odd_texts(odd, none):
    model = language_id.learn(odd)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(odd_texts())
    expected = Counter((k, "xx" if any(map(str.isalpha, t or "")) else "und") for k, t in odd_texts())
    assert Counter((r["doc_id"], r["lang_pred"]) for r in rows) == expected
    unknown = language_id.learn(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, unknown).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_languages_of_small_table(prepared):
    table = prepared.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r["text"], r["lang"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in table]
    plain = brute.languages(rows, language_id.WORDS, language_id.GRAMS)
    got = by_key(QUERIES["op1_language_id"](prepared, SMALL), "doc_id", "held_out", "lang_pred", "score")
    for r, (_, _, held), (lang, score) in zip(table, rows, plain, strict=True):
        found = got[r["doc_id"]]
        assert found[:2] == (held, lang) and abs(found[2] - score) < 1e-6


def test_queries_on_odd_documents(prepared, odd):
    """Queries read a table with nulls, repeated keys and clashing column names."""
    folder = scratch_path(prepared, "odd")
    odd.write.parquet(f"{folder}/documents.parquet")
    keys = Counter(k for k, _ in odd_texts())
    for name in ("op1_language_id", "op5_quality_rules", "op6_token_counts", "op8_pii", "op9_simhash", "op11_byte_pairs", "op12_alignment"):
        rows = QUERIES[name](prepared, folder).collect()
        assert Counter(r["doc_id"] for r in rows) == keys, name
        if name == "op1_language_id":
            assert all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
        if name == "op5_quality_rules":
            plain = Counter((k, *brute.measures(t)) for k, t in odd_texts())
            columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            assert Counter(tuple(r[c] for c in columns) for r in rows) == plain


def test_samples_do_not_depend_on_the_files(prepared):
    docs = prepared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    assert model == language_id.learn(docs.orderBy("text").repartition(7))


def test_backoff_uses_the_longest_known_grams():
    model = {"langs": ["a", "b"], "tables": {k: {} for k in (0, *language_id.ORDERS)}}
    model["tables"][0]["known"] = [-1.0, -3.0]
    model["tables"][2]["no"] = [-5.0, -1.0]
    model["tables"][3][" kn"] = [-2.0, -1.5]
    scorer = language_id.Scorer(model)
    assert scorer.predict("known")[0] == "a"
    assert scorer.word("knowing") == [-2.0, -1.5]
    assert scorer.word("snow") == [-5.0, -1.0]
    assert scorer.predict("zzz")[0] == "a"
    assert scorer.predict("12 ½ _") == ("und", 0.0)


# --- sentence pieces ---------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_library(odd, none, prepared, pieces_model, small_texts):
    rows = sentence_pieces.encode(odd, decoded=True).collect()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows)
    expected = Counter()
    for k, t in odd_texts():
        ids = pieces_model.encode(t or "")
        expected[k, len(ids), np.array(ids, "<u4").tobytes(), pieces_model.decode(ids)] += 1
    assert got == expected
    back = sentence_pieces.decode(sentence_pieces.encode(odd)).collect()
    assert Counter(r["text"] for r in back) == Counter(e[3] for e in expected.elements())
    assert sentence_pieces.encode(none).count() == 0
    found = by_key(QUERIES["op10_sentence_pieces"](prepared, SMALL), "doc_id", "n_tokens", "ids_crc32", "decoded_sha256")
    for k, t in small_texts:
        ids = pieces_model.encode(t)
        assert found[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest())


def test_steps_of_the_walk_are_kept(small_texts):
    """Distinct words over steps met before are walked without looking for each start whether its characters grow into a
    piece, which took more than half of the operator's time."""

    class Counted(dict):
        looks = 0

        def get(self, *args):
            Counted.looks += 1
            return super().get(*args)

    encoder = sentence_pieces.Encoder()
    encoder.search.prefixes = Counted(encoder.search.prefixes)
    texts = [t for _, t in small_texts[:20]] + ["nation 日本 ½x"]
    first = encoder.encode(texts)
    met, Counted.looks, encoder.known = Counted.looks, 0, {}
    assert encoder.encode(texts) == first
    assert met > 0 and Counted.looks == 0


def test_walk_with_few_kept_steps(monkeypatch, pieces_model, small_texts):
    """Steps and pairs beyond the bound are found again: a bounded table, the same ids."""
    monkeypatch.setattr(sentence_pieces, "KEPT_STEPS", 50)
    monkeypatch.setattr(sentence_pieces, "KEPT_PAIRS", 50)
    encoder = sentence_pieces.Encoder()
    for _, text in small_texts[:20]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == pieces_model.encode(text)
        assert sum(len(n.following) for n in [encoder.search.root, *encoder.search.nodes.values()]) <= 50


@settings(max_examples=400, deadline=None)
@given(st.text("aabethinor  ▁.,1é\n日😀", max_size=30))
def test_pieces_of_any_text(text):
    encoder = test_pieces_of_any_text.__dict__.setdefault("encoder", sentence_pieces.Encoder())
    library = encoder.vocabulary.library
    ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
    assert ids == library.encode(text)
    assert encoder.vocabulary.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("▁aethin日", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
def test_unigram_search_is_the_best_sum(words):
    walk = test_unigram_search_is_the_best_sum.__dict__.setdefault(
        "walk", sentence_pieces.Unigram(sentence_pieces.Vocabulary(public_tokenizers.path(sentence_pieces.MODEL)))
    )

    def score(piece):
        return walk.scores.get(piece, walk.low if len(piece) == 1 else -np.inf)

    for word, pieces in walk.encode(words).items():
        assert "".join(pieces) == word
        sums = [0.0]
        for end in range(1, len(word) + 1):
            sums.append(max(sums[i] + score(word[i:end]) for i in range(end)))
        assert sum(map(score, pieces)) == pytest.approx(sums[-1])
