"""Plain versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import re


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def suffix_removals(docs: list[tuple[int, str]], length: int = 100) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), ids not repeated."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id] = (len(data), len(data) - len(kept), spans, sha(kept))
    return out


def word_sets(docs: list[tuple[int, str]], width: int) -> dict[int, frozenset]:
    out = {}
    for doc_id, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out[doc_id] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def components(nodes, links) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_components(docs: list[tuple[int, str]], width: int, percent: int = 80) -> dict[int, int]:
    """All pairs that share a shingle, on the full sets."""
    sets = word_sets(docs, width)
    where: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    links = []
    for d, s in sets.items():
        hits: dict[int, int] = {}
        for x in s:
            for o in where[x]:
                if o < d:
                    hits[o] = hits.get(o, 0) + 1
        links += [(d, o) for o, n in hits.items() if 100 * n >= percent * (len(s) + len(sets[o]) - n)]
    return components(sets, links)
