"""Token counts per text: batches of distinct pieces go through the tokenizer, only lengths come back."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidemark.llm.shared import by_bytes, per_text

MODEL = "piece_bpe_32k.model"
#: Lengths kept per task between batches, for pieces of at most SHORT characters.
KEPT, SHORT = 400_000, 48
#: A single space between two characters that are neither a space nor its visible form. The library puts a marker
#: for the space before what follows, and before the start of a text as well, so the two sides encode alike apart.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def safe_pieces(text: str) -> list[str]:
    """The text without its safe boundaries: the pieces' token counts add up to that of the text."""
    if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    return text.split(" ")


class PieceCounter:
    """Token counts of whole texts with a SentencePiece model."""

    def __init__(self, model: str, kept: int = KEPT) -> None:
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.kept = kept
        self.known: dict[str, int] = {"": 0}

    def lengths(self, texts: list[str]) -> list[int]:
        """Lengths for one batch; memory holds the batch's distinct pieces and at most ``kept`` earlier ones."""
        split = [safe_pieces(t) for t in texts]
        if len(self.known) > self.kept:
            self.known = {"": 0}
        known = self.known
        fresh = set().union(*split).difference(known)
        long = {}
        for batch in by_bytes(fresh):
            ids = self.encoder.encode(batch, num_threads=1)
            for piece, n in zip(batch, map(len, ids), strict=True):
                (known if len(piece) <= SHORT else long)[piece] = n
        if not long:
            return [sum(map(known.__getitem__, pieces)) for pieces in split]
        return [sum(long[p] if p in long else known[p] for p in pieces) for pieces in split]


def token_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = 4096
) -> DataFrame:
    """Per row: its key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model`` is the name of a SentencePiece file of the tokenizer folder. Null and empty texts have no bytes and
    no tokens. Repeated rows give repeated results, null keys stay, an empty table gives none, other columns are
    not read. Nothing is shuffled. Texts are encoded in batches of about a MB, cut at safe boundaries: a long text
    is never encoded as one string unless it has no single space.
    """

    def start() -> Callable:
        counter = PieceCounter(public_tokenizers.path(model))

        def apply(texts):
            found = []
            for batch in by_bytes([t or "" for t in texts]):
                found += counter.lengths(batch)
            sizes = [len((t or "").encode()) for t in texts]
            return [sizes, found]

        return apply

    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    counted = per_text(docs, key, text, fields, start)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
