"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that carries their labels on.

Nodes are the matches of the patterns and, outside them, the words with a digit or an ``@``; all other words are
outside for certain. Neighbouring nodes share a chain potential; nodes that repeat (same characters without
punctuation) or resemble each other (same last digits) share a skip potential, however far apart they are. Loopy
sum-product messages run over both kinds of links, and a word whose label is likely enough becomes a span.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.shared import is_drawn, per_text

# The kinds in the order spans are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

OUTSIDE = len(KINDS)
LABELS = len(KINDS) + 1
CHAIN, SAME, ALIKE = range(3)
#: Expected texts with a digit or an ``@`` that the potentials are learned from.
SAMPLE_TEXTS = 4000
ROUNDS, DAMPING, SURE = 10, 0.5, 0.9
SETTLED = 1e-4
#: A repeated word needs this many letters and digits, a similar one this many last digits.
SAME_CHARS, ALIKE_DIGITS = 6, 7
_WORD = re.compile(r"\S+")
_ANY = re.compile("[0-9@]")
_EDGE = ".,;:!?()[]{}<>\"'"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Linear: from each ``@``, back over the local part and on over the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all pattern matches that pass their test, by start, then kind; code points."""
    found = []
    if "@" in text:
        found += [(i, j, 0) for i, j in _emails(text)]
    if _ANY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


class Nodes:
    """The nodes of one text: places, observed labels (OUTSIDE where no pattern matches), features and links."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        units = []
        last = -1
        for start, end, kind in base:
            if start >= last:
                units.append((start, end, kind))
            last = max(last, end)
        taken = iter([*units, (len(text) + 1, len(text) + 1, OUTSIDE)])
        start, end, _ = next(taken)
        for m in _WORD.finditer(text):
            if not _ANY.search(m[0]):
                continue
            i, j = m.span()
            while end <= i:
                start, end, _ = next(taken)
            if j <= start:
                units.append((i, j, OUTSIDE))
        units.sort()
        self.spans = []
        for i, j, kind in units:
            if kind == OUTSIDE:
                word = text[i:j]
                i += len(word) - len(word.lstrip(_EDGE))
                j -= len(word) - len(word.rstrip(_EDGE))
            if i < j:
                self.spans.append((i, j, kind))
        self.words = [text[i:j] for i, j, _ in self.spans]
        self.labels = np.array([k for _, _, k in self.spans], np.int64)
        self.links = [(i, i + 1, CHAIN) for i in range(len(self.spans) - 1) if self.spans[i + 1][0] - self.spans[i][1] <= 3]
        self.links += self._skips()

    def _skips(self) -> list[tuple[int, int, int]]:
        """Each node and the next one with the same key: chains through the text, never all pairs."""
        links, seen = [], {}
        for i, word in enumerate(self.words):
            plain = "".join(filter(str.isalnum, word.lower()))
            digits = "".join(c for c in word if "0" <= c <= "9")
            keys = []
            if len(plain) >= SAME_CHARS:
                keys.append((SAME, plain))
            if len(digits) >= ALIKE_DIGITS:
                keys.append((ALIKE, digits[-ALIKE_DIGITS:]))
            for key in keys:
                if key in seen:
                    links.append((seen[key], i, key[0]))
                seen[key] = i
        return links

    def groups(self) -> list[int]:
        """A number for each node, equal for nodes that skips connect."""
        parent = list(range(len(self.spans)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j, kind in self.links:
            if kind != CHAIN:
                parent[root(j)] = root(i)
        return [root(i) for i in range(len(parent))]

    def features(self) -> list[tuple[str, ...]]:
        return [features(w) for w in self.words]


def _many(n: int) -> str:
    return str(n) if n < 4 else "4-6" if n < 7 else "7-11" if n < 12 else "12-19" if n < 20 else "20+"


def features(word: str) -> tuple[str, ...]:
    """What a node shows on its own: a bounded set of values."""
    figures = "".join(c for c in word if "0" <= c <= "9")
    digits, letters = len(figures), sum(map(str.isalpha, word))
    parts = re.findall("[0-9]+", word)
    return (
        "digits " + _many(digits),
        "luhn " + (str(_luhn(figures)) if 12 <= digits <= 19 else "-"),
        "octets " + (str(all(len(p) < 4 and int(p) < 256 for p in parts)) if len(parts) == 4 else "-"),
        "letters " + ("0" if not letters else "1-3" if letters < 4 else "4+"),
        "dots " + _many(word.count(".")),
        "dashes " + _many(word.count("-")),
        f"at {'@' in word} plus {word[:1] == '+'} bracket {'(' in word}",
    )


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict:
    """Potentials from what the patterns find in about SAMPLE_TEXTS texts drawn evenly, by a hash of key and text, from
    those with a digit or an ``@``. Each kind of factor is trained on its own: node weights by softmax regression over the counts of feature
    sets, pair potentials by how much more often two labels meet than by chance. Counts are added up in Spark; the
    feature sets are few whatever the input."""
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    rate = SAMPLE_TEXTS / max(1, marked.count())
    drawn = marked.where(is_drawn(F.lit(rate), "k", "t")).select("t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                nodes = Nodes(t, base_spans(t))
                for f, label in zip(nodes.features(), nodes.labels.tolist(), strict=True):
                    found["|".join(f), -1, label] += 1
                for i, j, kind in nodes.links:
                    found[str(kind), int(nodes.labels[i]), int(nodes.labels[j])] += 1
        rows = [(*k, n) for k, n in found.items()]
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=["what", "a", "b", "n"])

    rows = drawn.mapInArrow(counted, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    return _trained([tuple(r) for r in rows.collect()])


def _trained(rows: list[tuple[str, int, int, int]]) -> dict:
    sets: dict[str, np.ndarray] = {}
    pairs = np.full((3, LABELS, LABELS), 0.5)
    for what, a, b, n in rows:
        if a < 0:
            sets.setdefault(what, np.zeros(LABELS))[b] += n
        else:
            pairs[int(what), a, b] += n
            pairs[int(what), b, a] += n
    share = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    alone = share.sum(axis=2)
    potentials = np.log(share) - np.log(alone[:, :, None]) - np.log(alone[:, None, :])
    names = sorted({f for what in sets for f in what.split("|")})
    place = {f: i for i, f in enumerate(names)}
    ordered = sorted(sets)
    x = np.zeros((len(ordered), len(names) + 1))
    x[:, -1] = 1.0
    for r, what in enumerate(ordered):
        for f in what.split("|"):
            x[r, place[f]] = 1.0
    counts = np.array([sets[w] for w in ordered]).reshape(-1, LABELS)
    weights, total = np.zeros((x.shape[1], LABELS)), max(counts.sum(), 1.0)
    size = counts.sum(axis=1, keepdims=True)
    for _ in range(500):
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights += 2.0 * (x.T @ (counts - size * p)) / total - 1e-4 * weights
    if not len(ordered):
        weights[-1, OUTSIDE] = 5.0
    return {"place": place, "weights": weights, "pairs": potentials}


def _sweeps(links: list[tuple[int, int]], n: int) -> list[np.ndarray]:
    """The messages of a sweep along the links and one back, in steps: a node sends after all that it waits for. Message
    ``i`` goes along link ``i``, message ``len(links) + i`` back."""
    steps = []
    ahead, behind = [0] * n, [0] * n
    for i, j in sorted(links, key=lambda x: x[1]):
        ahead[j] = max(ahead[j], ahead[i] + 1)
    for i, j in sorted(links, reverse=True):
        behind[i] = max(behind[i], behind[j] + 1)
    for first, level in ((0, [ahead[i] for i, _ in links]), (len(links), [behind[j] for _, j in links])):
        order = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.diff(np.array(level)[order])) + 1
        steps += [first + part for part in np.split(order, cuts)]
    return steps


class Field:
    """The random field with learned potentials."""

    def __init__(self, model: dict) -> None:
        self.place, self.weights, self.pairs = model["place"], model["weights"], model["pairs"]

    def node_potentials(self, nodes: Nodes) -> np.ndarray:
        out = np.empty((len(nodes.words), LABELS))
        for i, found in enumerate(nodes.features()):
            out[i] = self.weights[-1]
            for f in found:
                if f in self.place:
                    out[i] += self.weights[self.place[f]]
        fixed = nodes.labels != OUTSIDE
        out[fixed] = -30.0
        out[fixed, nodes.labels[fixed]] = 0.0
        return out

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities after rounds of messages, each a sweep along the text and one back, until no message
        changes by SETTLED. A sweep sends from a node once all messages to it are there, so the first round, whose messages
        have none before them to be damped by, crosses any number of links; ROUNDS only ends messages that go in circles."""
        own = self.node_potentials(nodes)
        belief = own.copy()
        if nodes.links:
            links = sorted({(i, j) for i, j, _ in nodes.links})  # several between two nodes act as one, and echo nothing
            place = {link: i for i, link in enumerate(links)}
            joint = np.zeros((len(links), LABELS, LABELS))
            np.add.at(joint, [place[i, j] for i, j, _ in nodes.links], self.pairs[[kind for *_, kind in nodes.links]])
            a, b = np.array(links).T
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            pair = np.concatenate([joint, joint])
            message = np.zeros((len(source), LABELS))
            steps = _sweeps(links, len(own))
            for turn in range(ROUNDS):
                change = 0.0
                for now in steps:
                    sent = (belief[source[now]] - message[back[now]])[:, :, None] + pair[now]
                    top = sent.max(axis=1, keepdims=True)
                    fresh = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
                    fresh -= fresh.max(axis=1, keepdims=True)
                    more = fresh - message[now]
                    change = max(change, float(np.abs(more).max()))
                    if turn:
                        more *= 1 - DAMPING
                    message[now] += more
                    np.add.at(belief, target[now], more)
                if change < SETTLED:
                    break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Base spans and the words that the field is sure of and that repeat or resemble, over any number of links, a base
        span of their kind: likeness to a kind alone does not make personal data."""
        if not _ANY.search(text):
            return base
        nodes = Nodes(text, base)
        if (nodes.labels == OUTSIDE).all():
            return base
        p = self.marginals(nodes)
        best = p[:, :OUTSIDE].argmax(axis=1)
        sure = (nodes.labels == OUTSIDE) & (p[np.arange(len(p)), best] >= SURE)
        if not sure.any():
            return base
        group = nodes.groups()
        seen = {(g, k) for g, k in zip(group, nodes.labels.tolist(), strict=True) if k != OUTSIDE}
        added = [(*nodes.spans[i][:2], int(best[i])) for i in np.flatnonzero(sure).tolist() if (group[i], int(best[i])) in seen]
        return sorted([*base, *added], key=lambda s: (s[0], s[2]))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as ``<KIND>``; of overlapping spans the first names them all."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])


def find_personal_data(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", mask: bool = False) -> DataFrame:
    """Per row: its key, ``base`` and ``spans``, arrays of (start, end, kind) in code points, by start, then kind; with
    ``mask`` also ``masked``, the text with its spans replaced by ``<KIND>`` (null for a null text).

    ``base`` are the pattern matches, ``spans`` these and what the random field adds. Null and empty texts have
    none. Repeated rows give equal results; null keys stay; other columns are not read; nothing is shuffled.
    Patterns and links take time in proportion to the text, so very long texts are no special case.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred feature weights

    def start() -> Callable:
        field = Field(shared.value)

        def apply(texts):
            base, all_, hidden = [], [], []
            for t in texts:
                found = base_spans(t or "")
                spans = field.spans(t or "", found)
                base.append([{"start": i, "end": j, "kind": KINDS[k]} for i, j, k in found])
                all_.append([{"start": i, "end": j, "kind": KINDS[k]} for i, j, k in spans])
                if mask:
                    hidden.append(None if t is None else masked(t, spans))
            return [base, all_, hidden] if mask else [base, all_]

        return apply

    fields = [StructField("base", ArrayType(_SPAN)), StructField("spans", ArrayType(_SPAN))]
    if mask:
        fields.append(StructField("masked", StringType()))
    return per_text(docs, key, text, fields, start)
