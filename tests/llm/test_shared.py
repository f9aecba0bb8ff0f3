"""What the operators on texts share: shuffle width, scratch tables, batches, components with a hot root."""

from __future__ import annotations

import gc
import os

import pytest

from tests.llm.conftest import SMALL
from tidemark import session
from tidemark.llm import queries, shared


@pytest.fixture
def width(prepared, monkeypatch):
    """The number of partitions that shuffles start with, with a partition for each 4 KB."""
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 4096)
    prepared.conf.unset(session.INITIAL)
    yield lambda: int(prepared.conf.get(session.INITIAL, "0"))
    prepared.conf.unset(session.INITIAL)


def test_shuffles_follow_what_is_read_and_stored(prepared, width):
    docs = queries.documents(prepared, SMALL)
    size = os.path.getsize(f"{SMALL}/documents.parquet")
    assert width() >= size // 4096
    plan = docs.groupBy("lang").count()
    rows = shared.stored(prepared.range(100_000).selectExpr("uuid() as u"), "wide")
    assert width() >= session.table_bytes(rows) // 4096 > size // 4096
    shared.prepare(prepared)
    assert width() >= session.table_bytes(rows) // 4096  # a query built before still runs as wide
    assert plan.count() > 0
    prepared.conf.unset(session.INITIAL)
    shared.prepare(prepared, docs)
    assert width() >= size // 4096


def test_scratch_of_a_finished_pass_goes(prepared):
    made = []

    def build():
        made.append(shared.stored(prepared.range(10), "first"))
        made.append(shared.stored(made[0].where("id > 4"), "second"))
        return made[1].join(made[0], "id")

    kept = shared.settled(build, "kept")
    assert sorted(r[0] for r in kept.collect()) == [5, 6, 7, 8, 9]
    assert not any(os.path.exists(t.stored_at) for t in made) and os.path.exists(kept.stored_at)
    shared.dropped(kept)
    assert not os.path.exists(kept.stored_at)


def test_batches_are_balanced_by_bytes():
    texts = ["a" * 40, "é" * 40, "日" * 40, "", "b" * 500, "c"]
    batches = list(shared.by_bytes(texts, 130))
    assert [t for b in batches for t in b] == texts
    assert all(len(b) == 1 or sum(len(t.encode()) for t in b) <= 130 for b in batches)
    assert batches[0] == texts[:2]


def test_cycles_are_searched_again():
    with shared.keeping():
        with shared.keeping():
            assert not gc.isenabled()
        assert not gc.isenabled()
    assert gc.isenabled()


def test_samples_are_even(prepared):
    from pyspark.sql import functions as F

    rows = prepared.range(40_000)
    n = rows.where(shared.is_drawn(F.lit(0.25), "id")).count()
    assert 9_500 < n < 10_500
    assert rows.where(shared.is_drawn(F.lit(2.0), "id")).count() == 40_000


def test_a_third_of_all_nodes_in_one_component(prepared):
    """A star with a hot centre, a long chain, and pairs."""
    star = prepared.range(1, 3001).selectExpr("id as a", "cast(0 as bigint) as b")
    chain = prepared.range(10_000, 10_300).selectExpr("id as a", "id + 1 as b")
    pairs = prepared.range(20_000, 26_000, 2).selectExpr("id as a", "id + 1 as b")
    found = shared.components(star.unionByName(chain).unionByName(pairs), "test")
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert all(roots[i] == 0 for i in range(1, 3001))
    assert all(roots[i] == 10_000 for i in range(10_001, 10_301))
    assert all(roots[i] == i - 1 for i in range(20_001, 26_000, 2))
