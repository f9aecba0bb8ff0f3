"""Byte pairs, alignment and spelling variants against plain versions, on odd texts and on the small table."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute_tokens as brute
from tests.llm.conftest import SMALL, odd_texts
from tidemark.llm import alignment, byte_pairs, spelling
from tidemark.llm.queries import QUERIES
from tidemark.llm.shared import by_bytes

EXTRA = [
    (20, "<|endoftext|>x <|startoftext|><|endoftext|>É<|endoftext|>"),
    (21, "It's WE'LL İstanbul ΣΑΣ ŉ ǆ naïve ñ Å 日本語 １２3½ \x1c\x85\xa0 a b"),
    (22, "<s> </s> <unk> <0x41> ▁ a▁b  two  blanks \n\n x"),
    (23, " leading and trailing "),
    (24, "x" + " " * 5000 + "y" + "\n" * 5000 + "z" + " " * 3000),
    (25, "abcdefghij" * 400),
    (26, "﻿bom ‍​ 👩‍👩‍👧 é é"),
]


@pytest.fixture(scope="module")
def rows(odd):
    return odd_texts() + EXTRA


@pytest.fixture(scope="module")
def documents(prepared, odd, rows):
    more = prepared.createDataFrame(EXTRA, "doc_id long, text string")
    return odd.unionByName(more, allowMissingColumns=True)


@pytest.fixture(scope="module")
def small(prepared):
    table = prepared.read.parquet(f"{SMALL}/documents.parquet")
    return table, [(r["doc_id"], r["text"]) for r in table.collect()]


def got(df):
    return Counter(tuple(r) for r in df.collect())


# --- byte pairs ----------------------------------------------------------------------------------------------


def test_byte_pairs_query(prepared, small):
    expected = Counter((k, *x) for (k, _), x in zip(small[1], brute.byte_pairs([t for _, t in small[1]]), strict=True))
    assert got(QUERIES["op11_byte_pairs"](prepared, SMALL)) == expected


def test_byte_pairs_of_odd_texts(documents, rows, none):
    found = byte_pairs.encode(documents, decoded=True)
    digests = Counter((r[0], r[1], brute.digest(" ".join(map(str, r[2]))), brute.digest(r[3])) for r in found.collect())
    assert digests == Counter((k, *x) for (k, _), x in zip(rows, brute.byte_pairs([t for _, t in rows]), strict=True))
    again = byte_pairs.decode(byte_pairs.encode(documents))
    assert got(again) == Counter((r["doc_id"], r["decoded"]) for r in found.collect())
    assert byte_pairs.encode(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_byte_pairs_of_any_text(texts):
    codec = _codec()
    expected = [e.ids for e in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in codec.encode(texts)] == expected
    for ids in expected:
        assert codec.decode(ids) == codec.library.decode(ids, skip_special_tokens=False)


def _codec(kept=[]):  # noqa: B006
    if not kept:
        kept.append(byte_pairs.Codec())
    return kept[0]


def test_cuts_are_certain():
    merges = _codec().merges
    letters = [t.removesuffix("</w>") for t in merges.ids]
    inside = {t[i : i + 2] for t in letters for i in range(len(t) - 1)}
    draw, cut = random.Random(3), 0
    for _ in range(3000):
        word = "".join(draw.choices("etaoinqxzjkv!?#é", k=draw.randint(1, 12))).encode().decode("latin-1").translate(_codec().letters)
        parts = merges.fragments(word)
        assert "".join(parts) == word and all(parts)
        cut += len(parts) > 1
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                assert any(sum(map(len, parts[:k])) == i for k in range(1, len(parts)))
        whole = list(word[:-1]) + [word[-1] + "</w>"]
        assert [merges.ids[p] for p in merges._heaped(whole)] == np.frombuffer(merges.encode(word), np.uint32).tolist()
    assert cut > 1000


# --- alignment -----------------------------------------------------------------------------------------------


def aligned(rows, digest=False):
    plain = brute.alignment([t for _, t in rows])
    return Counter((k, *x[:6], brute.digest(x[6]) if digest and x[6] else x[6]) for (k, _), x in zip(rows, plain, strict=True))


def test_alignment_query(prepared, small):
    assert got(QUERIES["op12_alignment"](prepared, SMALL)) == aligned(small[1], digest=True)


@pytest.mark.parametrize("part", [None, 2000])
def test_alignment_of_odd_texts(documents, rows, none, part, monkeypatch):
    if part:
        monkeypatch.setattr(alignment, "PART_BYTES", part)
        monkeypatch.setattr(alignment, "KEPT_VALUES", 500)
        monkeypatch.setattr(alignment, "KEPT", 40)
        monkeypatch.setattr(alignment, "SHARES", 3)
    assert got(alignment.align(documents)) == aligned(rows)
    assert alignment.align(none).count() == 0


def test_alignment_of_one_common_text(prepared):
    rows = [(i, "the same words in every text") for i in range(300)] + [(i, f"word{i}") for i in range(300, 400)]
    found = alignment.align(prepared.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert got(found) == aligned(rows)


def test_alignment_works_on_small_batches(rows, monkeypatch):
    texts = [t or "" for _, t in rows]
    whole, parts = alignment.Aligner(), alignment.Aligner()
    at_once = whole.align(texts)
    cut = list(by_bytes(texts, alignment.WORK_BYTES // 64))
    assert len(cut) > 1
    one_by_one = [x for some in cut for x in parts.align(some)]

    def told(aligner, found):
        pairs = list(aligner.pairs)
        return [(*x[:4], {pairs[p]: n for p, n in zip(x[4].tolist(), x[5].tolist(), strict=True)}) for x in found]

    assert told(whole, at_once) == told(parts, one_by_one)
    counts = [dict(zip(a.pairs, a.counts.tolist(), strict=False)) for a in (whole, parts)]
    assert counts[0] == counts[1]
    assert alignment.WORK_BYTES <= 1 << 17  # arrays of a batch stay in a core's cache


def test_links_of_a_group():
    links, _ = alignment.overlaps(np.array([1, 2, 3]), np.array([7, 8]), np.array([2, 3, 6]), np.array([4, 6]))
    assert [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()] == [(1, 7), (2, 7), (3, 7), (3, 8)]


# --- spelling variants ---------------------------------------------------------------------------------------

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def variants(df):
    return got(spelling.variants(df).select(*COLUMNS))


def test_spelling_query(prepared, small):
    assert got(QUERIES["op13_spelling_variants"](prepared, SMALL)) == Counter(brute.spellings(small[1]))


def test_spelling_of_odd_texts(documents, rows, none):
    assert variants(documents) == Counter(brute.spellings(rows))
    assert spelling.variants(none).count() == 0


def test_spelling_chains_and_ties(prepared):
    words = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "abcdefghijk": 2000, "abcdxfgh": 20, "abcdéfgh": 20, "Èbcdefgh": 3}
    words |= {"aaaaaaab": 2, "aaaaaaa": 40, "aaaaaabb": 2, "gfedcba": 5, "abcdefg": 60, "÷×÷×÷×÷": 4, "÷×÷×÷×": 4}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    rows += [(None, "hundreds of Hundreds"), (None, "hundreds of Hundreds"), (99, None)]
    expected = brute.spellings(rows)
    assert variants(prepared.createDataFrame(rows, "doc_id long, text string")) == Counter(expected)
    assert any(form and root != form for _, form, root, *_ in expected)


def test_spelling_of_many_damaged_words(prepared):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdé", k=draw.randint(7, 11))) for _ in range(150)]
    rows = [(i, " ".join(draw.choices(words, k=40))) for i in range(400)]
    expected = brute.spellings(rows)
    assert variants(prepared.createDataFrame(rows, "doc_id long, text string")) == Counter(expected)
    assert sum(x[1] is not None for x in expected) > 20


@settings(max_examples=100, deadline=None)
@given(st.text("abcé", min_size=7, max_size=14), st.integers(0, 13), st.sampled_from("abcdé"))
def test_signatures_find_every_edit(word, at, letter):
    """One edited letter leaves a signature of the letters, in the kind of pair it makes."""
    at %= len(word)

    def found(a, b, parts, out, size):
        a, b = ("".join(sorted(x)) for x in (a, b))
        return any(int(s[0]) == int(s[1]) for s in spelling.signatures([a, b], [size, size], parts, out))

    assert found(word, word[:at] + letter + word[at + 1 :], spelling.EQUAL_PARTS, 2, len(word))
    assert found(word, word[:at] + letter + word[at:], spelling.APART_PARTS, 1, len(word))
