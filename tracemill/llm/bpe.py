"""BPE encoding and decoding by speculate and verify.

Words are proposed as greedy longest vocabulary matches. A sequence of tokens is what exact
merging gives if and only if every adjacent pair is: no symbol on the right edge of the left
token may merge with one on the left edge of the right token while both exist. These checks run
over arrays of all new adjacent pairs at once; only words with a failing pair are merged exactly.
Words repeat, so each worker remembers the outcome for words of up to ``memo`` letters together.

Works for vocabularies with an end-of-word suffix (tokenizers files whose pre-tokenizer removes
white space). Edge cases: null text is empty and has no tokens; strings of added tokens in a
text stand for their ids; repeated rows are encoded alike; texts of any length are encoded whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .vocabulary import byte_letters, settled

NEVER = 1 << 30


class WordBpe:
    def __init__(self, vocabulary: str, memo: int = 4_000_000):
        import regex
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.library = Tokenizer.from_file(vocabulary)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")")
        letters = byte_letters()
        self.table = [letters[b] for b in range(256)]
        self.bytes_of = {c: b for b, c in letters.items()}
        self.longest = max(map(len, self.vocab)) - len(self.suffix) + 1
        self.limit, self.held = memo, 0
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.exact_words = 0
        self._edges(merges)

    def _edges(self, merges: list[tuple[str, str]]) -> None:
        """For each token the symbols on its left and right edge from itself inwards, with the rank
        of the merge that takes each away; and the rank of each merge by its pair of ids."""
        size = len(self.vocab)
        made: dict[str, tuple[str, str, int]] = {}
        for i, (a, b) in enumerate(merges):
            made.setdefault(a + b, (a, b, i))
        sides = []
        for side in (0, 1):
            chains = []
            for token, _ in sorted(self.vocab.items(), key=lambda x: x[1]):
                chain, t, until = [], token, NEVER
                while True:
                    chain.append((self.vocab[t], until))
                    if t not in made:
                        break
                    until = made[t][2]
                    t = made[t][side]
                chains.append(chain)
            depth = max(map(len, chains))
            symbols, gone = np.full((size, depth), -1, np.int64), np.zeros((size, depth), np.int64)
            for i, chain in enumerate(chains):
                symbols[i, : len(chain)] = [c[0] for c in chain]
                gone[i, : len(chain)] = [c[1] for c in chain]
            sides.append((symbols, gone))
        self.left_edge, self.right_edge = sides
        pair = np.array([self.vocab[a] * size + self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair_keys, self.pair_ranks, self.size = pair[order], order.astype(np.int64), size
        # A token that merging its own letters does not give can't be proposed.
        self.sound = {t for t, i in self.vocab.items() if self.merge_exactly(t) == [i]}

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether exact merging keeps the border between the two tokens, for each pair."""
        ok = np.ones(len(left), bool)
        (rs, rg), (ls, lg) = self.right_edge, self.left_edge
        for i in range(rs.shape[1]):
            has = rs[left, i] >= 0
            if not has.any():
                break
            for j in range(ls.shape[1]):
                at = np.flatnonzero(has & ok & (ls[right, j] >= 0))
                if not len(at):
                    break
                a, b = left[at], right[at]
                key = rs[a, i] * self.size + ls[b, j]
                pos = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                found = self.pair_keys[pos] == key
                rank = self.pair_ranks[pos]
                # Equal ranks merge from left to right: the left token's inner pair goes first,
                # the right token's inner pair last.
                ok[at[found & (rank < rg[a, i]) & (rank <= lg[b, j])]] = False
        return ok

    def symbols(self, word: str) -> list[str]:
        """Letters of a word whose suffix, if any, is part of its last letter."""
        if word.endswith(self.suffix):
            body = word[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix] if body else [word]
        return list(word)

    def merge_exactly(self, word: str) -> list[int]:
        """Merges from the lowest rank on, the leftmost of equals first; a heap holds the pairs that may merge,
        so the time grows with n log n."""
        parts: list[str | None] = list(self.symbols(word))
        rank, n = self.rank, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, j = heappop(heap)
            # A pair counts only as it was put in: both there, neighbours, and of this rank.
            if parts[i] is None or after[i] != j or j >= n or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((parts[i], parts[after[i]]))) is not None:
                    heappush(heap, (r, i, after[i]))
            if before[i] >= 0 and (r := rank.get((parts[before[i]], parts[i]))) is not None:
                heappush(heap, (r, before[i], i))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]

    def propose(self, word: str) -> list[int] | None:
        out, at, n = [], 0, len(word)
        vocab, sound, suffix, longest = self.vocab, self.sound, self.suffix, self.longest
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                piece = word[at:end] if end < n else word[at:end] + suffix
                if piece in sound:
                    out.append(vocab[piece])
                    at = end
                    break
            else:
                return None
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words into the memo."""
        table, names = self.table, self.names
        spelled = [w if w.isascii() and w.isprintable() and " " not in w else "".join([table[b] for b in w.encode()]) for w in words]
        proposals = [self.propose(s) for s in spelled]
        sizes = np.array([len(p) if p else 0 for p in proposals])
        flat = np.array([i for p in proposals if p for i in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fits = self.compatible(pairs // self.size, pairs % self.size)[back]
            bad[owner[inner[~fits]]] = True
        for i, w in enumerate(words):
            ids = proposals[i]
            if bad[i]:
                self.exact_words += 1
                ids = self.merge_exactly(spelled[i] + self.suffix)
            self.held += len(w)
            self.memo[w] = (len(ids), " ".join(map(str, ids)), " ".join([names[t] for t in ids]))

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text; added tokens as their ids."""
        out: list[str | int] = []
        parts = self.split_added.split(text) if any(a in text for a in self.added) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part])
            elif part:
                # Most texts are in composed form already, where lower() is all that is left to do:
                # white space is dropped later.
                if settled(part) and is_normalized("NFC", part):
                    out += self.words.findall(part.lower())
                else:
                    split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    out += [bytes([self.bytes_of[c] for c in w]).decode() for w, _ in split]
        return out

    def encode_batch(self, texts: list[str], chunk: int = 1 << 21) -> Iterator[list[tuple[int, str, str]]]:
        """Per text its words' (number of ids, ids joined, tokens joined).

        The new words of about ``chunk`` letters of text are verified together.
        """
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < chunk):
                size += len(texts[stop])
                stop += 1
            memo = self.memo
            if self.held > self.limit:
                memo.clear()
                self.held = 0
            split = [self.pieces(t) for t in texts[start:stop]]
            new = {w for words in split for w in words if w not in memo and type(w) is str}
            if new:
                self.learn(list(new))
            for words in split:
                yield [memo[w] if type(w) is str else (1, str(w), self.names[w]) for w in words]
            start = stop

    def encode(self, text: str) -> list[int]:
        return [int(i) for word in next(self.encode_batch([text])) for i in word[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The files name no decoder: tokens joined by spaces, special ones included."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=1)
def word_bpe(vocabulary: str) -> WordBpe:
    """One for all tasks of a worker, with what it remembers."""
    return WordBpe(vocabulary)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for words in bpe.encode_batch(list(b["text"])):
                n, ids, tokens = zip(*words, strict=True) if words else ((), (), ())
                if 0 in n:  # a word without any known letter has no ids and leaves no gap
                    ids, tokens = filter(None, ids), filter(None, tokens)
                out.append((sum(n), sha(" ".join(ids)), sha(" ".join(tokens))))
            n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": [bpe.encode(t) for t in b["text"]]})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, ids array<int>")
