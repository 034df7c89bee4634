"""Plain restatements of what the operators must give, for small tables."""

import hashlib
from collections import Counter

import numpy as np
import xxhash


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def repeated(docs, window=200, keep_first=False):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each document; with keep_first docs are in order."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for n, (_, t) in enumerate(texts):
        for i in range(len(t) - window + 1):
            first.setdefault(t[i : i + window], (n, i))
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for n, (d, t) in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1 and not (keep_first and first[t[i : i + window]] == (n, i)):
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, radius=3):
    fps = [simhash(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius]
    roots = components(len(fps), pairs)
    least = {}
    for r, (d, _) in zip(roots, docs):
        least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fps, roots)]
