from __future__ import annotations

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.shared import prepare

SMALL = "/root/testdata/sf0.001"
#: Column names that the operators use for themselves or return.
CLASHING = (
    "k th lo n d f1 f2 words text_ rejected_by kept spans n_tokens n_words fp component root start ids part "
    "lang_pred score l t gram base masked decoded carried late olo"
).split()


@pytest.fixture(scope="session")
def prepared(spark):
    return prepare(spark)


def words(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank and very long texts, ties, repeated rows and repeated keys."""
    passage = words(140, 1)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "one two"),
        (6, f"{words(30, 2)} {passage} {words(30, 3)}"),
        (7, f"{words(25, 4)} {passage}"),
        (8, f"{passage} {words(25, 5)}"),
        (8, f"{passage} {words(25, 5)}"),
        (9, words(60, 6)),
        (9, words(61, 7)),
        (None, words(60, 6)),
        (None, None),
        (10, "a" * 3000),
        (11, words(6000, 8)),
        (12, f"{words(6000, 8)} tail"),
        (13, "é日本 mail a.b+c@ex-ample.co.uk, +49 (30) 123-456-78 card 4111 1111 1111 1111 ip 10.0.0.255 4111.1111.1111.1111"),
        (14, "ab " * 700),
        (15, "x\x00y \x1cz ▁ <s> <|endoftext|> 😀"),
        (16, "ñ" * 1001),
        (17, "ñ" * 1001 + "!"),
    ]


@pytest.fixture(scope="session")
def odd(prepared):
    """The odd texts as documents with columns whose names clash with those of the operators."""
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            StructField("lang", StringType()),
            StructField("source", StringType()),
            StructField("n_chars", LongType()),
            *(StructField(c, StringType()) for c in CLASHING),
        ]
    )
    rows = [(k, t, "xx", None, None, *["clash"] * len(CLASHING)) for k, t in odd_texts()]
    return prepared.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
