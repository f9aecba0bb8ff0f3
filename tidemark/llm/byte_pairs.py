"""Byte-pair ids of texts, and texts of ids, with forced boundaries.

A merge can only join what stands side by side inside some token of the vocabulary. Two neighbouring bytes that no token
holds side by side are therefore never joined: each such place is a certain cut, and the fragments between cuts are encoded
apart and put together again. Fragments are short and come back often, so a task keeps the ids of those it has seen.

Bytes that end a word carry the mark of a word's end and are told apart from others: a cut before the last byte of a word
needs a pair that no token has at its own end.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField
from tokenizers import Tokenizer

from tidemark.llm.shared import by_bytes, per_text

TOKENIZER = "word_bpe_49k.json"
#: Chunks and fragments that a task keeps between batches, and the longest that it keeps.
KEPT, SHORT = 400_000, 48
#: Fragments of more bytes are merged with a heap instead of a scan for each merge.
SCANNED = 40
#: Characters from which the library's normaliser and word pattern give what ``lower`` and ``_WORDS`` give.
_PLAIN = re.compile("[!-~À-ÿ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_BLANKS = "\t\n\x0b\x0c\r"


def byte_characters() -> list[str]:
    """The character that stands for each byte: its own if that is visible, else the next from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Ids of words in byte characters."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str) -> None:
        self.ids, self.end = vocabulary, end
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.inner: set[str] = set()
        self.last: set[str] = set()
        for token in vocabulary:
            ends = bool(end) and token.endswith(end)
            letters = token[: -len(end)] if ends else token
            joined = [letters[i : i + 2] for i in range(len(letters) - 1)]
            if ends and joined:
                self.last.add(joined.pop())
            self.inner.update(joined)
        self.known: tuple[dict, dict] = ({}, {})

    def fragments(self, word: str) -> list[str]:
        """The word cut at every pair of neighbours that no token holds; the last fragment ends the word."""
        inner, start, out = self.inner, 0, []
        n = len(word) - 1
        for i in range(1, n):
            if word[i - 1 : i + 1] not in inner:
                out.append(word[start:i])
                start = i
        if n > 0 and word[n - 1 :] not in (self.last if self.end else inner):
            out.append(word[start:n])
            start = n
        out.append(word[start:])
        return out

    def encode(self, word: str) -> bytes:
        """Ids as unsigned 32-bit numbers. A word among the kept last fragments has no cut inside."""
        found = self.known[True].get(word)
        if found is not None:
            return found
        *before, last = self.fragments(word)
        return b"".join([*(self.fragment(f, False) for f in before), self.fragment(last, True)])

    def fragment(self, letters: str, ends: bool) -> bytes:
        known = self.known[ends]
        found = known.get(letters)
        if found is None:
            parts = list(letters)
            if ends:
                parts[-1] += self.end
            parts = self._scanned(parts) if len(parts) <= SCANNED else self._heaped(parts)
            found = array("I", map(self.ids.__getitem__, parts)).tobytes()
            if len(letters) <= SHORT:
                if len(known) >= KEPT:
                    known.clear()
                known[letters] = found
        return found

    def _scanned(self, parts: list[str]) -> list[str]:
        """Always the merge of the least rank, of equal ones the leftmost."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
        return parts

    def _heaped(self, parts: list[str]) -> list[str]:
        """The same in time n log n: parts as a linked list, merges in a heap by rank and place."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(rank, i) for i in range(n - 1) if (rank := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or get((parts[i], parts[j])) != rank:
                continue  # a part of it has been merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (rank := get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (rank, k))
        return [p for p in parts if p]


class Codec:
    """Ids of whole texts as the tokenizer file gives them, and the text of ids.

    The file's normaliser and word pattern come before the merges. No word holds white space, so the chunks between
    ASCII blanks are encoded apart. A special token's string is that token wherever it stands, as is the file's default.
    """

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        path = public_tokenizers.path(tokenizer)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.letters = dict(enumerate(byte_characters()))
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.tokens = [""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = token
        self.known: dict[str, bytes] = {"": b""}

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk in byte characters."""
        if _PLAIN.fullmatch(chunk):
            words = _WORDS.findall(chunk.lower())
            if chunk.isascii():
                return words
            return [w.encode().decode("latin-1").translate(self.letters) for w in words]
        normal = self.library.normalizer.normalize_str(chunk)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def chunk(self, chunk: str) -> bytes:
        encode = self.merges.encode
        if chunk.isascii() and chunk.isalpha():
            return encode(chunk.lower())
        if "<|" not in chunk:
            return b"".join(map(encode, self.words(chunk)))
        out = []
        for part in self.special.split(chunk):
            if part in self.added:
                out.append(array("I", [self.added[part]]).tobytes())
            elif part:
                out += map(encode, self.words(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text of a batch; between batches at most KEPT chunks stay."""
        split = []
        for text in texts:
            for blank in _BLANKS:
                if blank in text:
                    text = text.replace(blank, " ")
            split.append(text.split(" "))
        if len(self.known) > KEPT:
            self.known = {"": b""}
        known, long = self.known, {}
        for chunk in set().union(*split).difference(known):
            (known if len(chunk) <= SHORT else long)[chunk] = self.chunk(chunk)
        if long:
            known = known | long
        return [np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.uint32) for chunks in split]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens stand as they are with a space between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of ids as an Arrow column."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, decoded: bool = False
) -> DataFrame:
    """Per row: its key, ``n_tokens`` and ``ids`` of the text; with ``decoded`` also the text that the ids stand for.

    The ids are those of the library for the tokenizer file without added special tokens. Null and empty texts have no ids
    and decode to the empty text. Repeated rows give equal results, null keys stay, other columns are not read, an empty
    table gives none, nothing is shuffled. A chunk of any length without a blank is merged in time n log n.
    """

    def start() -> Callable:
        codec = Codec(tokenizer)

        def apply(texts):
            found: list[np.ndarray] = []
            for batch in by_bytes([t or "" for t in texts]):
                found += codec.encode(batch)
            columns = [list(map(len, found)), lists(found)]
            if decoded:
                columns.append([codec.decode(ids.tolist()) for ids in found])
            return columns

        return apply

    fields = [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))]
    if decoded:
        fields.append(StructField("decoded", StringType()))
    return per_text(docs, key, text, fields, start)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Per row: its key and the ``text`` that an array of ids stands for; null ids give the empty text."""

    def start() -> Callable:
        codec = Codec(tokenizer)
        return lambda coded: [[codec.decode(c or []) for c in coded]]

    return per_text(rows.select(F.col(key), F.col(ids)), key, ids, [StructField("text", StringType())], start)
