"""What the operators should give, worked out plainly on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_components(texts, num, den, k=5):
    """A component number for each text (itself where nothing is linked), through an inverted index."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in index[g])
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            index[g].append(i)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def suffix(texts, w=400):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter()
    for r in raws:
        seen.update(hashlib.blake2b(r[i : i + w], digest_size=12).digest() for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[hashlib.blake2b(r[i : i + w], digest_size=12).digest()] > 1:
                gone[i : i + w] = b"\x01" * w
        out.append((len(r), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def substring(rows, w=20):
    """(n_words, n_removed, kept) of each of ``rows`` (order, text), in ascending order of their first fields."""
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        words = WORD.findall(rows[i][1] or "")
        gone = [False] * len(words)
        for j in range(len(words) - w + 1):
            g = tuple(words[j : j + w])
            if g in seen:
                gone[j : j + w] = [True] * w
            seen.add(g)
        out[i] = (len(words), sum(gone), " ".join(x for x, g in zip(words, gone, strict=True) if not g))
    return [out[i] for i in range(len(rows))]


def contamination(texts, items, w=13):
    """(n_words, n_hit, item ids) of each text; ``items``: (id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall(lower(text))
        if item is not None and words:
            n = min(len(words), w)
            for i in range(len(words) - n + 1):
                windows[tuple(words[i : i + n])].add(str(item))
    sizes = sorted({len(x) for x in windows})
    out = []
    for t in texts:
        words = LETTERS.findall(lower(t))
        hit, found = [False] * len(words), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if got := windows.get(tuple(words[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= got
        out.append((len(words), sum(hit), sorted(found)))
    return out


def unigrams(rows):
    """{row number: (n_tokens, n_known, base_score)} and N of ``rows`` (id as text, text)."""
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    train = [i is None or zlib.crc32(i.encode()) % 5 != 1 for i, _ in rows]
    count = Counter(w for ws, own in zip(tokens, train, strict=True) if own for w in ws)
    n, v = sum(count.values()), len(count)
    p = lambda w: math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(len(ws), sum(count[w] > 0 for w in ws), sum(map(p, ws))) for ws in tokens], n


def site_lines(pages, max_share=0.1, min_pages=5):
    """Kept lines of each of ``pages`` (host, lines)."""
    total = Counter(h for h, _ in pages)
    on = Counter((h, x) for h, ls in pages for x in {x for x in ls if x.strip(" ")})
    bad = {k for k, n in on.items() if n >= min_pages and n > max_share * total[k[0]]}
    return [[x for x in ls if (h, x) not in bad] for h, ls in pages]


def top_k(rows, k=5):
    """{(query, rank): (id, score)} for ``rows`` (id, vector); queries are ids divisible by 50."""
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, qv in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
            out |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    return out
