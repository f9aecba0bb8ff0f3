"""Plain versions of the operators on byte pairs, alignment and spellings, over lists."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def byte_pairs(texts: list[str | None]) -> list[tuple[int, str, str]]:
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [(len(i), digest(" ".join(map(str, i))), digest(library.decode(i, skip_special_tokens=False))) for i in coded]


def alignment(texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [x for x in range(256) if chr(x).isprintable() and x not in (32, 173)]
    letters = {chr(x): x for x in visible}
    letters.update((chr(256 + n), x) for n, x in enumerate(x for x in range(256) if x not in visible))

    def piece(i: int) -> bytes:
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends = [[], []]
        for side, data in enumerate((bytes_a, bytes_b)):
            for x in data:
                ends[side].append((ends[side][-1] if ends[side] else 0) + len(x))
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[], []] for _ in shared]
        for side, ids in enumerate((ids_a, ids_b)):
            for i, end in zip(ids, ends[side], strict=True):
                groups[bisect_left(shared, end)][side].append(str(i))
        groups = ["|".join(",".join(side) for side in group) for group in groups]
        pairs, j = [], 0
        for i, (x, end) in enumerate(zip(ids_a, ends[0], strict=True)):
            begin = end - len(bytes_a[i])
            while ends[1][j] <= begin:
                j += 1
            k = j
            while k < len(ids_b) and ends[1][k] - len(bytes_b[k]) < end:
                pairs.append((x, ids_b[k]))
                k += 1
        links.append(pairs)
        found.append((len(ids_a), len(ids_b), len(groups), ";".join(groups)))
    count = Counter(p for pairs in links for p in pairs)
    top: dict[int, int] = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (n_a, n_b, n_groups, groups), pairs in zip(found, links, strict=True):
        best = sum(count[p] == top[p[1]] for p in pairs)
        out.append((n_a, n_b, n_groups, len(pairs), best, sum(count[p] for p in pairs), groups))
    return out


def spellings(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(word, form, root, n, n_near, form_n) of all words."""
    counts: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    without = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :]].add(w)  # one deleted letter
            without[w[:i] + "\0" + w[i + 1 :]].add(w)  # one replaced letter
    near = defaultdict(set)
    for short, group in without.items():
        for w in group:
            near[w] |= group - {w} if "\0" in short else set()
            if "\0" not in short and short in words:
                near[w].add(short)
                near[short].add(w)
    forms: dict[str, str | None] = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w: str) -> str:
        while forms[w] is not None:
            w = forms[w]
        return w

    return [(w, forms[w], root(w), n, len(near[w]), words[forms[w]] if forms[w] else None) for w, n in words.items()]
