"""Token counts of every prefix of a text by dynamic programming.

The encoding of a prefix is that of a shorter prefix and one more token, which is the only one that fits: some
vocabulary string ends there, and exact merging keeps its border with the last token of the shorter prefix. So one
pass over the letters of a word gives last token and number of tokens for all its prefixes, each with and without the
end-of-word mark. A prefix of a text has the tokens of the pieces before it and those of the piece it cuts,
so the counts at all its prefixes follow from the stored counts of its pieces, and nothing is encoded again:

* :func:`token_counts` gives the count of each whole text,
* :func:`prefix_counts` stores the counts at all prefixes, in blocks of a bounded number of them,
* :func:`tokens_at` and :func:`truncations` answer from these blocks how many tokens a cut leaves, and where to
  cut for a budget. Counts don't rise steadily ("th" may be two tokens and "the" one), so the longest prefix within a budget
  is looked for in all blocks that go low enough.

Prefixes are counted in code points. Edge cases: null text is empty, which has one prefix of no tokens; strings of added tokens
stand for one token where they are complete and for ordinary letters where a prefix cuts them; words with letters that
normalisation joins or lengthens are counted by the library, prefix by prefix. Repeated rows are counted alike; in an index, a
repeated id has the blocks of each of its rows and so several answers. Null ids have counts and, as with any join, no
answers from an index. Whole texts are counted in pieces of about a megabyte, cut at spaces. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NEVER, word_bpe
from .common import text_of
from .vocabulary import settled

CHUNK = 1 << 20
BLOCK = 4096
SPACES = " \n\t\r"
CONTROLS = re.compile("[\x1c-\x1f]")  # split() drops them, the pieces have them


SHORT = (2, 1)


def _sizes(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """The sizes of tokens by their last three letters, longest first."""
    out: dict[str, set[int]] = {}
    for t in tokens:
        if len(t) > 2:
            out.setdefault(t[-3:], set()).add(len(t))
    return {end: (*sorted(sizes, reverse=True), *SHORT) for end, sizes in out.items()}


class PrefixCounter:
    def __init__(self, vocabulary: str, memo: int = 6_000_000):
        self.bpe = bpe = word_bpe(vocabulary)
        letters = bpe.table
        if any(c + end not in bpe.sound for c in letters for end in ("", bpe.suffix)):
            raise ValueError("each byte must be a token, with and without the end of a word")
        self.inner = {t: bpe.vocab[t] for t in bpe.sound if not t.endswith(bpe.suffix)}
        self.final = {t[: -len(bpe.suffix)]: bpe.vocab[t] for t in bpe.sound if t.endswith(bpe.suffix)}
        self.inner_sizes, self.final_sizes = _sizes(self.inner), _sizes(self.final)
        self.rank = dict(zip(bpe.pair_keys.tolist(), bpe.pair_ranks.tolist(), strict=True))
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.fitting: dict[int, bool] = {}
        self.limit, self.held = memo, 0
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.prefixes: dict[str, array] = {}
        self.fields: dict[str, int] = {}
        self.whole: dict[str | int, int] = dict.fromkeys(self.bpe.added.values(), 1)

    def _edge(self, token: int, right: int) -> list[tuple[int, int]]:
        found = self.edges.get((token, right))
        if found is None:
            symbols, gone = self.bpe.right_edge if right else self.bpe.left_edge
            found = [(int(s), int(g)) for s, g in zip(symbols[token], gone[token], strict=True) if s >= 0]
            self.edges[token, right] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether exact merging keeps the border between the two tokens."""
        key = left * self.bpe.size + right
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) > self.limit:
                self.fitting.clear()
            known = not any(
                (r := self.rank.get(a * self.bpe.size + b, NEVER)) < until and r <= other
                for a, until in self._edge(left, 1)
                for b, other in self._edge(right, 0)
            )
            self.fitting[key] = known
        return known

    def _last(self, letters: str, stop: int, vocabulary: dict[str, int], sizes: dict[str, tuple], last: list[int]) -> tuple[int, int]:
        """The one token that can end at ``stop``, and its start."""
        fitting, size = self.fitting, self.bpe.size
        for n in sizes.get(letters[max(0, stop - 3) : stop], SHORT):
            start = stop - n
            if start < 0:
                continue
            token = vocabulary.get(letters[start:stop])
            if token is not None:
                if start == 0:
                    return token, 0
                known = fitting.get(last[start] * size + token)
                if known or (known is None and self.fits(last[start], token)):
                    return token, start
        raise AssertionError("no token fits")

    def _grow(self, letters: str, last: list[int], count: list[int]) -> None:
        """Last token and number of tokens of all prefixes but the whole, without the end of a word."""
        for stop in range(len(last), len(letters)):
            token, start = self._last(letters, stop, self.inner, self.inner_sizes, last)
            last.append(token)
            count.append(count[start] + 1)

    def _ended(self, letters: str, stop: int, last: list[int], count: list[int]) -> int:
        """Number of tokens of a prefix as a word of its own."""
        return count[self._last(letters, stop, self.final, self.final_sizes, last)[1]] + 1

    def spell(self, word: str) -> str:
        table = self.bpe.table
        return "".join([table[b] for b in word.encode()])

    def learn_all(self, words: set[str]) -> None:
        """Counts of whole words. In sorted order, a word goes on from the prefix it shares with the one before."""
        last, count, before = [-1], [0], ""
        for letters, word in sorted((self.spell(w), w) for w in words):
            same, most = 0, min(len(letters) - 1, len(last) - 1)
            while same < most and letters[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self._grow(letters, last, count)
            self.whole[word] = self._ended(letters, len(letters), last, count)
            self.held += len(word)
            before = letters

    def learn(self, word: str) -> array:
        """Counts at all prefixes of a piece of text, in code points from 1 on, each as a text of its own."""
        found = self.prefixes.get(word)
        if found is not None:
            return found
        letters = self.spell(word)
        last, count, found, stop = [-1], [0], array("i"), 0
        self._grow(letters, last, count)
        for c in word:
            stop += len(c.encode())
            found.append(self._ended(letters, stop, last, count))
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():
            # A contraction that is cut after its second letter is two pieces.
            found[1] = found[0] + self.learn(word[1])[-1]
        self.held += len(word)
        self.prefixes[word] = found
        return found

    def _room(self) -> None:
        if self.held > self.limit:
            self._clear()

    def totals(self, texts: list[str]) -> list[int]:
        """Number of tokens of each whole text. The new words of about ``CHUNK`` letters of text are learned together."""
        out, some, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            start = 0
            while start < len(text):
                stop = len(text)
                if stop - start > CHUNK:
                    stop = start + CHUNK
                    while stop < len(text) and text[stop] not in SPACES:
                        stop += 1
                some.append((i, text[start:stop]))
                size += stop - start
                start = stop
                if size >= CHUNK:
                    self._add(some, out)
                    some, size = [], 0
        self._add(some, out)
        return out

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def _add(self, some: list[tuple[int, str]], out: list[int]) -> None:
        """Add the tokens of parts of texts to the numbers of their texts."""
        self._room()
        split = []
        for i, text in some:
            # No piece holds white space, so the pieces between spaces are counted together.
            plain = settled(text) and not CONTROLS.search(text) and is_normalized("NFC", text) and not any(a in text for a in self.bpe.added)
            split.append((i, plain, text.lower().split() if plain else self.bpe.pieces(text)))
        new = {f for _, plain, fields in split if plain for f in fields}.difference(self.fields)
        pieces = {f: [f] if f.isalpha() else self.bpe.words.findall(f) for f in new}
        self.learn_all({w for _, plain, ws in split if not plain for w in ws if w not in self.whole} | {w for ws in pieces.values() for w in ws if w not in self.whole})
        for f, ws in pieces.items():
            self.fields[f] = sum(map(self.whole.__getitem__, ws))
            self.held += len(f)
        for i, plain, parts in split:
            out[i] += sum(map((self.fields if plain else self.whole).__getitem__, parts))

    def counts(self, text: str) -> array:
        """Number of tokens of each prefix, from the empty one to the whole text."""
        out = array("i", [0])
        parts = self.bpe.split_added.split(text)
        for i in range(0, len(parts), 2):
            base, size = out[-1], len(parts[i])
            added = parts[i + 1] if i + 1 < len(parts) else ""
            # Up to its last letter, an added token is ordinary text and may go on with the piece before it.
            inside = self._plain(parts[i] + added[:-1])
            out.extend([base + n for n in inside])
            if added:
                out.append(base + (inside[size - 1] if size else 0) + 1)
        return out

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        lowered = text.lower()
        if settled(text) and is_normalized("NFC", text) and len(lowered) == len(text):
            self._spans(out, 0, len(text), [(m.start(), m.end(), m.group()) for m in self.bpe.words.finditer(lowered)])
            return out
        for field, space in _fields(text):
            base = out[-1] if out else 0
            spans = self._stable(field)
            if spans is not None:
                self._spans(out, base, len(field), spans)
            else:
                encode = self.bpe.library.encode
                out.extend(base + len(encode(field[:n], add_special_tokens=False).ids) for n in range(1, len(field) + 1))
            out.extend([out[-1] if out else 0] * space)
        return out

    def _spans(self, out: list[int], base: int, length: int, spans: list[tuple[int, int, str]]) -> None:
        at = 0
        self._room()
        for start, stop, word in spans:
            out.extend([base] * (start - at))
            out.extend([base + n for n in self.learn(word)])
            base, at = out[-1], stop
        out.extend([base] * (length - at))

    @lru_cache(maxsize=100_000)  # noqa: B019 - one counter lives as long as its worker
    def _normal(self, letter: str) -> str:
        return self.bpe.library.normalizer.normalize_str(letter)

    def _stable(self, field: str) -> list[tuple[int, int, str]] | None:
        """Pieces with their places, if normalisation takes each letter to one letter by itself."""
        normal = [self._normal(c) for c in field]
        joined = "".join(normal)
        if any(len(c) != 1 for c in normal) or joined != self.bpe.library.normalizer.normalize_str(field):
            return None
        places = self.bpe.library.pre_tokenizer.pre_tokenize_str(joined)
        return [(a, b, joined[a:b]) for _, (a, b) in places]


def _fields(text: str) -> Iterator[tuple[str, int]]:
    """Runs without spaces, each with the number of spaces after it."""
    at, n = 0, len(text)
    while at < n:
        stop = at
        while stop < n and text[stop] not in SPACES:
            stop += 1
        after = stop
        while after < n and text[after] in SPACES:
            after += 1
        yield text[at:stop], after - stop
        at = after


@lru_cache(maxsize=1)
def prefix_counter(vocabulary: str) -> PrefixCounter:
    """One for all tasks of a worker, with what it remembers."""
    return PrefixCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = prefix_counter(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": b["n_bytes"], "n_tokens": counter.totals(list(b["text"]))})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    source = source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = source.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The index: doc_id, block (number), least (smallest of its counts), last (the text's last block), counts.

    Entry i of block b is the number of tokens of the first b * ``block`` + i code points.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = prefix_counter(vocabulary)
        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                counts = counter.counts(text)
                parts = [counts[i : i + block] for i in range(0, len(counts), block)]
                for low in range(0, len(parts), 64):
                    some = parts[low : low + 64]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array([doc_id] * len(some), "Int64"),
                            "block": range(low, low + len(some)),
                            "least": [min(p) for p in some],
                            "last": low + len(some) == len(parts),
                            "counts": [p.tolist() for p in some],
                        }
                    ).assign(last=lambda x, n=len(parts): x["block"] == n - 1)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, block long, least int, last boolean, counts array<int>")


def tokens_at(index: DataFrame, cuts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row (doc_id, cut) of ``cuts``: n_tokens of the first ``cut`` code points; of the whole text if it has fewer.

    ``index`` is read once, joined on document and block; ids that it doesn't hold, null and negative cuts give null.
    """
    cuts = cuts.select("doc_id", F.col("cut").cast("long").alias("cut"))
    ask = cuts.distinct()
    inside = F.col("cut") - F.col("block") * block
    # The block that holds the cut, or the last one where the text ends before it.
    near = (F.col("block") == F.floor(F.col("cut") / block)) | (F.col("last") & (F.col("block") < F.floor(F.col("cut") / block)))
    found = (
        index.join(ask.filter("cut >= 0"), "doc_id")
        .filter(near)
        .select("doc_id", "cut", F.element_at("counts", (F.least(inside + 1, F.size("counts").cast("long"))).cast("int")).alias("n_tokens"))
    )
    return cuts.join(found, ["doc_id", "cut"], "left").select("doc_id", "cut", "n_tokens")


def truncations(index: DataFrame, budgets: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row (doc_id, budget): cut, the most code points whose tokens are within the budget, and their n_tokens.

    Null where the id isn't in the index or the budget is null or negative.
    """
    budgets = budgets.select("doc_id", F.col("budget").cast("long").alias("budget"))
    ask = budgets.distinct().withColumnRenamed("budget", "_budget")
    fitting = F.transform(
        "counts", lambda n, i: F.when(n <= F.col("_budget"), F.struct((F.col("block") * block + i).alias("cut"), n.alias("n_tokens")))
    )
    found = (
        index.join(ask, "doc_id")
        .filter("least <= _budget")
        .groupBy("doc_id", "_budget")
        .agg(F.max(F.array_max(fitting)).alias("best"))
        .select("doc_id", F.col("_budget").alias("budget"), "best.cut", "best.n_tokens")
    )
    return budgets.join(found, ["doc_id", "budget"], "left").select("doc_id", "budget", "cut", "n_tokens")
