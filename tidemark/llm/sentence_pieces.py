"""SentencePiece ids of texts, and texts of ids: forward search over a trie of distinct words.

A text becomes marked words: each space is written as the marker, one marker is put before the text, and a word starts
at the markers before it. No piece of a usable model reaches over such a start, so words are encoded apart. The
distinct words of a batch are sorted, which is a depth-first walk over their trie: what the forward search found for a
prefix stays on the stack and serves every word below it.

For a unigram model the forward score of a prefix is the best sum of piece scores (Viterbi). For a BPE model the
scores are merge ranks, and their best sum is not what the merges give. There the forward search has one state for
each prefix, the last piece of the prefix's own encoding: a piece can follow that state if the two, merged alone,
stay the two pieces, and only one piece can (see ``BytePairs``). So both are one forward pass with other transitions.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from tidemark.llm.shared import by_bytes, per_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words, pairs of pieces and steps between nodes that a task keeps between batches; a batch is about this many characters.
KEPT_WORDS, KEPT_PAIRS, KEPT_STEPS, BATCH = 400_000, 1_000_000, 500_000, 2 << 20
#: Score below the worst piece that an unknown character has in a unigram model.
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def marked_words(text: str) -> list[str]:
    """The words of a text, markers included; none for an empty text."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return [MARK + w for w in text.split(" ")]
    return _WORDS.findall(MARK + text.replace(" ", MARK))


class Vocabulary:
    """Pieces of a model file: ids and scores by piece, bytes, and what each id stands for."""

    def __init__(self, model: str | bytes) -> None:
        given = {"model_proto": model} if isinstance(model, bytes) else {"model_file": model}
        self.library = sentencepiece.SentencePieceProcessor(**given)
        n = self.library.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = self.library.unk_id()
        self.text: list[bytes] = [b""] * n
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not self.library.is_control(i) and i != self.unknown:
                self.ids[piece] = i
                self.scores[piece] = self.library.get_score(i)
                self.text[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that reach over the start of a word")

    def piece_ids(self, piece: str) -> list[int]:
        """The id of a piece; of an unknown character the ids of its bytes, or that of unknown ones."""
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Node:
    """The longest end of a path that a piece starts with. ``ends`` are the pieces that can be the last of the path, longest
    first: its length, the piece, and what is known of the pieces before it. ``following`` are the nodes after one more
    character, as far as they were met."""

    __slots__ = ("text", "ends", "following")

    def __init__(self, text: str, ends: list[tuple[int, int, dict[int, bool]]]) -> None:
        self.text, self.ends = text, ends
        self.following: dict[str, Node] = {}


class Walk:
    """Depth-first walk over the trie of distinct words, in sorted order, with the forward states of one path.

    A state is the last piece of the best encoding of a prefix (its number, and where it starts). Beside it the walk
    keeps the node of the prefix, which tells in one step what pieces can end after the next character. Both serve all
    words below the prefix. What may follow what, and which of the possible last pieces is best, is up to the subclass.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.names = sorted(vocabulary.ids)
        self.scores = vocabulary.scores
        self.prefixes: dict[str, int] = {p[:i]: -1 for p in self.names for i in range(1, len(p))}
        self.prefixes.update((p, i) for i, p in enumerate(self.names))
        self.nodes: dict[str, Node] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the nodes and what may stay beside what. Nodes refer to each other, and tasks do not search for cycles."""
        for node in self.nodes.values():
            node.following.clear()
        self.root, self.nodes = Node("", []), {}
        self.befores: dict[int, dict[int, bool]] = {}
        self.n_steps = self.n_pairs = 0

    def character(self, char: str) -> int:
        """The number of a character that is no piece; bounded by the number of characters."""
        self.names.append(char)
        self.prefixes[char] = len(self.names) - 1
        return len(self.names) - 1

    def grow(self, node: Node, char: str) -> Node:
        """The node after one more character."""
        prefixes = self.prefixes
        if prefixes.get(char, -1) < 0:
            self.character(char)
        text = node.text + char
        while text not in prefixes:
            text = text[1:]
        grown = self.nodes.get(text)
        if grown is None:
            tails = ((len(text) - i, prefixes.get(text[i:], -1)) for i in range(len(text)))
            ends = [(n, piece, self.befores.setdefault(piece, {})) for n, piece in tails if piece >= 0]
            grown = self.nodes[text] = Node(text, ends)
        if self.n_steps < KEPT_STEPS:
            self.n_steps += 1
            node.following[char] = grown
        return grown

    def search(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Distinct words and the numbers of their pieces."""
        if self.n_steps >= KEPT_STEPS or self.n_pairs >= KEPT_PAIRS:
            self.forget()
        self.path, self.last, self.starts = [self.root], [-1], [0]
        path, last, starts, before = self.path, self.last, self.starts, ""
        self.begin()
        for word in sorted(words):
            common, limit = 0, min(len(word), len(before))
            while common < limit and word[common] == before[common]:
                common += 1
            del path[common + 1 :], last[common + 1 :], starts[common + 1 :]
            self.extend(word, common)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end = starts[end]
            pieces.reverse()
            yield word, pieces
            before = word

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of distinct words."""
        return {word: [self.names[p] for p in pieces] for word, pieces in self.search(words)}


class Unigram(Walk):
    """The best sum of piece scores; of equal sums the longest last piece wins."""

    def begin(self) -> None:
        self.sums = [0.0]
        self.low = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def extend(self, word: str, depth: int) -> None:
        sums, scores, names, low = self.sums, self.scores, self.names, self.low
        del sums[depth + 1 :]
        node = self.path[depth]
        for end in range(depth + 1, len(word) + 1):
            char = word[end - 1]
            node = node.following.get(char) or self.grow(node, char)
            totals = [sums[end - n] + scores.get(names[piece], low) for n, piece, _ in node.ends]
            top = max(totals)
            n, piece, _ = node.ends[totals.index(top)]
            sums.append(top)
            self.path.append(node)
            self.last.append(piece)
            self.starts.append(end - n)


class BytePairs(Walk):
    """The merges' own encoding of each prefix.

    Merges go from the best score to the worst, of equal ones from left to right, and what happens on one side of a
    place that no merge crosses does not depend on the other side. So a sequence of pieces is the encoding of its text
    exactly if each neighbouring pair is that of its own, and the encoding of a prefix is the encoding of a shorter
    prefix and one more piece. Only one of the possible last pieces can stay beside the state it follows.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary)
        self.histories: dict[int, tuple] = {}  # one for each piece or unknown character

    def begin(self) -> None:
        pass

    def extend(self, word: str, depth: int) -> None:
        path, last, starts = self.path, self.last, self.starts
        node = path[depth]
        for end in range(depth + 1, len(word) + 1):
            char = word[end - 1]
            node = node.following.get(char) or self.grow(node, char)
            for n, piece, befores in node.ends:
                start = end - n
                stays = befores.get(last[start])
                if stays is None:
                    stays = befores[last[start]] = self.stays(last[start], piece)
                    self.n_pairs += 1
                if stays:
                    break
            else:
                raise AssertionError("no piece can end the prefix")
            path.append(node)
            last.append(piece)
            starts.append(start)

    def history(self, piece: int) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether the merges make one piece of the piece's text, and for each of them its score and the first and the
        last part after it, after an entry for the characters alone."""
        known = self.histories.get(piece)
        if known is None:
            parts, scores = list(self.names[piece]), self.scores
            events = [(0.0, parts[0], parts[-1])]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = scores.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                events.append((best, parts[0], parts[-1]))
            known = self.histories[piece] = (len(parts) <= 1, events)
        return known

    def stays(self, before: int, piece: int) -> bool:
        """Whether merging the two together gives the two pieces: their merges run side by side, the better score first
        and the left side first among equals, until a merge over the border comes before both."""
        whole, right = self.history(piece)
        if not whole or before < 0:
            return whole
        left, scores = self.history(before)[1], self.scores
        i = j = 0
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else None
            next_right = right[j + 1][0] if j + 1 < len(right) else None
            over = scores.get(left[i][2] + right[j][1])
            if over is not None and (next_left is None or over > next_left) and (next_right is None or over >= next_right):
                return False
            if next_left is not None and (next_right is None or next_left >= next_right):
                i += 1
            elif next_right is not None:
                j += 1
            else:
                return True


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, model: str | bytes = MODEL, unigram: bool = False) -> None:
        self.vocabulary = Vocabulary(public_tokenizers.path(model) if isinstance(model, str) else model)
        self.search = Unigram(self.vocabulary) if unigram else BytePairs(self.vocabulary)
        self.coded = [self.piece(name) for name in self.search.names]
        self.known: dict[str, bytes] = {}

    def piece(self, name: str) -> bytes:
        return array("I", self.vocabulary.piece_ids(name)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [marked_words(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        fresh = set().union(*split).difference(self.known)
        coded, names, known = self.coded, self.search.names, self.known
        for word, pieces in self.search.search(fresh):
            while len(coded) < len(names):
                coded.append(self.piece(names[len(coded)]))
            known[word] = b"".join([coded[p] for p in pieces])
        return [b"".join(map(known.__getitem__, words)) for words in split]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, decoded: bool = False) -> DataFrame:
    """Per row: its key, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of the text; with ``decoded`` also
    the text that the ids stand for.

    The ids are those of the library for the model file, without begin and end. Null and empty texts have no ids; a
    null text decodes to the empty one. Repeated rows give equal results, null keys stay, other columns are not
    read, nothing is shuffled. A text is held with its distinct words; a word without a space is searched in time
    in proportion to its length.
    """

    def start() -> Callable:
        encoder = Encoder(model)

        def apply(texts):
            coded = []
            for batch in by_bytes([t or "" for t in texts], BATCH):
                coded += encoder.encode(batch)
            columns = [[len(c) // 4 for c in coded], coded]
            if decoded:
                columns.append([encoder.vocabulary.decode(array("I", c).tolist()) for c in coded])
            return columns

        return apply

    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    if decoded:
        fields.append(StructField("decoded", StringType()))
    return per_text(docs, key, text, fields, start)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Per row: its key and the ``text`` of ids in the form ``encode`` gives; null ids give the empty text. Bytes that
    are no UTF-8 become replacement characters."""

    def start() -> Callable:
        vocabulary = Vocabulary(public_tokenizers.path(model))
        return lambda coded: [[vocabulary.decode(array("I", c or b"").tolist()) for c in coded]]

    plain = rows.select(F.col(key), F.col(ids))
    return per_text(plain, key, ids, [StructField("text", StringType())], start)
