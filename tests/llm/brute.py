"""Plain versions of what the operators compute, over lists."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def passage_words(texts: list[str | None], words: int = 50) -> list[int]:
    """Words of each text in passages of more words than that which another text has too."""
    size = words + 1
    split = [SPACE.findall(t or "") for t in texts]
    rows: dict[tuple[str, ...], set[int]] = {}
    for k, w in enumerate(split):
        for i in range(len(w) - size + 1):
            rows.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = []
    for w in split:
        marked = set()
        for i in range(len(w) - size + 1):
            if len(rows[tuple(w[i : i + size])]) > 1:
                marked.update(range(i, i + size))
        out.append(len(marked))
    return out


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = SPACE.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(marked)


def good(text: str | None) -> bool:
    """Whether no quality rule rejects the text."""
    n, chars, symbols, dup, repeated = measures(text)
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    if n < 20 or 100 * repeated > 30 * n:
        return False
    bullets = sum(x.lstrip(" \t")[:1] in tuple("•‣●*–-") for x in text.split("\n"))
    ellipses = sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in text.split("\n"))
    alphabetic = sum(any(unicodedata.category(c)[0] == "L" for c in x) for x in w)
    stops = set(
        "the of and to in that it is was for on with as at by from this are be or de la le les et des en un une que du est pour "
        "dans der die und das den von zu mit sich auf ist im dem nicht ein eine el los del las por con para se es al lo su".split()
    )
    top = max(Counter(zip(w, w[1:], strict=False)).values(), default=0)
    return (
        symbols * 5 <= n
        and 2 * n <= chars <= 20 * n
        and dup * 2 <= len(lines) <= n / 2
        and bullets * 10 <= len(lines) * 9
        and ellipses * 10 <= len(lines) * 3
        and alphabetic * 10 >= n * 6
        and (n < 100 or any(x.lower() in stops for x in w))
        and top * 5 <= n - 1
    )


def fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACE.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def languages(rows: list[tuple[str | None, str | None, bool]], words: int, grams: int) -> list[tuple[str, float]]:
    """(language, score) of each (text, lang, held out), learned from the rows that are not held out."""

    def letters(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    counts: dict = {}
    for text, lang, held in rows:
        if text is None or lang is None or held:
            continue
        for w in letters(text):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, 6):
                for i in range(len(w) + 2 - n + 1):
                    counts.setdefault((lang, n), Counter())[f" {w} "[i : i + n]] += 1
    langs = sorted({lang for _, lang, held in rows if lang is not None and not held})
    share: dict = {}
    for (lang, n), found in counts.items():
        top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[: grams if n else words]
        total = sum(c for _, c in top)
        for g, c in top:
            share[lang, n, g] = np.log10(c / total)
    known = {(n, g) for _, n, g in share}

    def log(lang, n, g):
        return share.get((lang, n, g), -7.0)

    def scores(w):
        if (0, w) in known:
            return [log(lang, 0, w) for lang in langs]
        for n in range(5, 0, -1):
            parts = [f" {w} "[i : i + n] for i in range(len(w) + 2 - n + 1)]
            parts = [g for g in parts if (n, g) in known]
            if parts:
                return [sum(log(lang, n, g) for g in parts) / len(parts) for lang in langs]
        return [-7.0] * len(langs)

    out = []
    for text, _, _ in rows:
        found = letters(text or "")
        if not any(any(map(str.isalpha, w)) for w in found):
            out.append(("und", 0.0))
            continue
        total = np.sum([scores(w) for w in found], axis=0)
        odds = 10.0 ** np.maximum(total - total.max(), -300)
        out.append((langs[int(total.argmax())], 1 / odds.sum()))
    return out


def components(fps: list[int], distance: int = 3) -> list[int]:
    """Component number of each fingerprint."""
    all_ = sorted(set(fps))
    parent = {f: f for f in all_}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    values = np.array(all_, np.uint64)
    for f in all_:
        for g in values[np.bitwise_count(values ^ np.uint64(f)) <= distance].tolist():
            parent[root(g)] = root(f)
    return [root(f) for f in fps]


_PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text: str | None) -> tuple[list[int], str]:
    spans = []
    for order, (kind, pattern) in enumerate(_PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(len(p) < 9 and int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), order, kind, m.end()))
    spans.sort()
    counts = [sum(s[2] == kind for s in spans) for kind in _PII]
    joined = ",".join(f"{kind}:{i}:{j}" for i, _, kind, j in spans)
    return counts, joined
