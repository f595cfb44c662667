"""Readers of public tokenizer files. Paths are parameters; nothing is copied or trained."""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np


def path(name: str) -> str:
    """Place of a file of the installed vocabulary package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Characters whose class and case no Unicode version has changed. For others the libraries' tables may differ,
#: so texts that have any go through the tokenizers library itself.
UNSETTLED = re.compile("[^\\x00-\u024f\u03b1-\u03c9\u0400-\u045f\u2010-\u2027\u20ac\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3]")


def settled(text: str) -> bool:
    return text.isascii() or not UNSETTLED.search(text)


class ByteEncoder:
    """A byte-level BPE given as a tokenizers file. Settled texts are encoded by tiktoken with the same
    ranks, which is several times faster; strings of added tokens stand for their ids in both."""

    def __init__(self, vocabulary: str):
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special.values()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.vocabulary = vocabulary

    @cached_property
    def library(self):
        """Loaded for the first unsettled text."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def encode(self, text: str) -> np.ndarray:
        if settled(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_encoder(vocabulary: str) -> ByteEncoder:
    return ByteEncoder(vocabulary)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out
