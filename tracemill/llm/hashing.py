"""Hashes over arrays of bytes, words and shingles."""

from __future__ import annotations

import secrets
from functools import lru_cache
from hashlib import blake2b

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def salt(n: int) -> np.uint64:
    """A 64-bit constant for each small number."""
    return np.uint64(int(BASE) * n & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_values(seed: int = 1) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) * np.uint64(2 * seed + 1) + salt(seed))


@lru_cache(maxsize=4)
def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = pow(int(BASE), -1, 1 << 64) if inverse else int(BASE)
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _room(n: int) -> int:
    return max(1 << 16, 1 << int(n).bit_length())


def prefix(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(seed)[data] * powers(_room(len(data) + 1))[: len(data)], out=out[1:])
    return out


def slices(run: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop] for each pair, from a running hash; equal bytes, equal hash."""
    return (run[stop] - run[start]) * powers(_room(len(run)), True)[start]


#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG = 256  # words of more bytes are hashed one by one


def new_key() -> int:
    """A key that no text can have been made for: one for all tasks of a run."""
    return secrets.randbits(64)


def hash_slices(data: bytes, start: np.ndarray, stop: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:stop] for each pair.

    Eight bytes at a time go through a bijection, so slices of one length up to 8 never collide. Longer ones collide with a chance of
    2^-64 a pair; as the steps can be undone by who knows them, texts can be made to collide unless a secret ``key`` is
    mixed into each step. Slices over ``LONG`` bytes take BLAKE2b, with the same key.
    """
    secret = np.uint64(key)
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    size = stop - start
    h = mix(size.astype(np.uint64) * salt(3) + salt(5) + secret)
    many = np.flatnonzero(size > LONG)
    at = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(at):
        left = size[at] - done
        chunk = eight[start[at] + done]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[at] = mix((h[at] ^ chunk) * BASE + salt(7) + secret)
        done += 8
        at = at[left > 8]
    for i in many:
        h[i] = int.from_bytes(blake2b(data[start[i] : stop[i]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return h


def words(texts: list[bytes], letters: bytes = LOWER, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word of the texts, their bytes replaced by ``letters``, split at white space."""
    data = (b"\n".join(texts) + b"\n").translate(letters)
    space = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hash_slices(data, start, stop, key), np.searchsorted(ends, start, side="right")


def shingles(texts: list[bytes], width: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct ``width``-word shingles, sorted by text and hash.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    h, doc = words(texts, key=key)
    n = np.bincount(doc, minlength=len(texts))
    full = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if len(h) >= width:
        whole = doc[width - 1 :] == doc[: len(doc) - width + 1]
        full = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            full = mix(full * BASE + h[i : len(h) - width + 1 + i] + np.uint64(i + 1))
        full, owner = full[whole], doc[: len(doc) - width + 1][whole]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        first = np.cumsum(n) - n
        short = []
        for d in few:
            x = np.zeros(1, np.uint64)
            for w in h[first[d] : first[d] + n[d]]:
                x = mix(x * BASE + w + np.uint64(77))
            short.append(x[0])
        full, owner = np.concatenate([full, np.array(short, np.uint64)]), np.concatenate([owner, few])
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    first = np.ones(len(full), bool)
    first[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    return full[first], owner[first]
