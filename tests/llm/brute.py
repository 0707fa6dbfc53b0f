"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import zlib
from collections import defaultdict

import xxhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, radius=4):
    """rows: (doc_id, text) -> sorted (doc_id, fingerprint, component_id)."""
    fps = [(d, fingerprint(t)) for d, t in rows]
    nodes = sorted({f for _, f in fps})
    parent = {f: f for f in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for d, f in fps:
        least[root(f)].append(d)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((d, f"{f:016x}", min((x for x in least[root(f)] if x is not None), default=None)) for d, f in fps), key=key)


def tokens(rows, tokenizer):
    """rows: (doc_id, text) with distinct ids -> (doc_id, start, n_tokens, ids_crc32)."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def substrings(rows, window=13):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept words)."""
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out
