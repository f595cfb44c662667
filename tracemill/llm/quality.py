"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in standardised text statistics. It is learned from preference
pairs (a document labelled good against one labelled bad) by logistic loss on the difference of
their features. The pass mark is the quantile of the training scores that leaves the share of
bad labels below it; the score is the logistic of the strength above the mark, so 0.5 is the mark.

Fitting takes every labelled row: the rows of the larger class are dealt into blocks of about
``BLOCK`` by a hash of their id, those of the smaller class into as many blocks as each needs for
about ``OTHERS`` of them, and all pairs of a block are compared. A block is one short row of a table
that each Newton round reads, so sums over pairs are made in tasks and only sums come to the driver. The
mark is the exact quantile of all labelled rows' strengths.

The texts are read once: their statistics are written and both fitted and scored. Edge cases: null text is empty,
the empty text has statistics 0 and gets a score too; without labels of both classes every
score is 0.5. An empty table gives an empty result. Only id and text are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch, text_of


def statistics(text: str) -> list[float]:
    """Shares and log sizes that tell prose from tables, shouting, symbol noise and repetition."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    b = np.bincount(raw, minlength=256)
    words = text.split()
    nw = max(1, len(words))
    lines = text.split("\n")
    letters = max(1, int(b[65:91].sum() + b[97:123].sum() + b[128:].sum()))
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    marks = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        b[65:91].sum() / letters,
        b[48:58].sum() / n,
        b[ord("|")] / nw,
        b[ord("!")] / nw,
        (b[35:39].sum() + b[ord("*")]) / nw,
        (b[ord(".")] + b[ord(",")]) / nw,
        marks / n,
        np.log1p(b[10]) - np.log1p(len(words)),
        (b[32] + b[10]) / n,
        b[128:].sum() / n,
        len(set(words)) / nw,
        np.log1p(len(set(words))) / np.log1p(nw),
        pairs / nw,
        repeats / nw,
        1 - len(set(lines)) / max(1, len(lines)),
        letters / n,
        np.log1p(len(raw) / nw),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Statistics, their square roots and squares."""
    return np.hstack([x, np.sqrt(np.abs(x)), x * x])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    mark: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.clip((expand(x) - self.mean) / self.scale, -8, 8) @ self.weights - self.mark
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: About how many rows of the larger and of the smaller class a block holds.
BLOCK, OTHERS = 1024, 64

MEASURED = "doc_id long, x array<double>"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "x": [np.asarray(statistics(t), float) for t in b["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, MEASURED)


def blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(good, own, x) of each block as bytes: whether a row is a good one, whether this is its first place, its statistics.

    Every row of ``rows`` (doc_id, label, x) is the first time in exactly one block."""
    larger, smaller = sorted((0, 1), key=lambda k: -counts[k])
    n = max(1, counts[larger] // BLOCK)
    places = min(n, -(-n * OTHERS // counts[smaller]))
    # Of a row of the smaller class the places are next to each other, all different.
    first = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    dealt = rows.select(
        "doc_id", "label", "x", F.explode(F.sequence(F.lit(0), F.when(F.col("label") == smaller, F.lit(places - 1)).otherwise(F.lit(0)))).alias("place")
    ).withColumn("block", F.pmod(first + F.col("place"), F.lit(n)))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        # One order of rows, so sums are the same on every run.
        b = b.assign(t=b["x"].map(tuple)).sort_values(["doc_id", "label", "t"])
        x = np.vstack(b["x"]).astype(float)
        return pd.DataFrame({"block": b["block"].iloc[:1].tolist(), "good": [(b["label"] == 1).to_numpy().tobytes()], "own": [(b["place"] == 0).to_numpy().tobytes()], "x": [x.tobytes()]})

    return dealt.groupBy("block").applyInPandas(pack, "block long, good binary, own binary, x binary")


def over_blocks(table: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums that a function of (expanded statistics, good, own) gives, over all blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, least = None, None
        for b in batches:
            for block, good, own, x in zip(b["block"], b["good"], b["own"], b["x"], strict=True):
                good = np.frombuffer(good, bool)
                found = sums(expand(np.frombuffer(x, float).reshape(len(good), -1)), good, np.frombuffer(own, bool))
                total = found if total is None else [t + f for t, f in zip(total, found, strict=True)]
                least = block if least is None else min(least, block)
        if total is not None:
            yield pd.DataFrame({"least": [least], "sums": [[np.ravel(t).astype(float) for t in total]]})

    # A task gives one short row.
    rows = sorted(table.mapInPandas(run, "least long, sums array<array<double>>").collect())
    return [np.sum([np.array(r["sums"][i]) for r in rows], axis=0) for i in range(len(rows[0]["sums"]))]


def moments(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the expanded statistics, where each class has half the weight."""
    both = over_blocks(table, lambda e, good, own: [np.stack([e[own & (good == g)].sum(axis=0) for g in (False, True)]), np.array([(own & ~good).sum(), (own & good).sum()])])
    size = both[1]
    mean = (both[0].reshape(2, -1) / size[:, None]).mean(axis=0)
    (square,) = over_blocks(table, lambda e, good, own: [np.stack([((e[own & (good == g)] - mean) ** 2).sum(axis=0) for g in (False, True)])])
    return mean, np.sqrt((square.reshape(2, -1) / size[:, None]).mean(axis=0)) + 1e-9


def fit_pairs(table: DataFrame, ridge: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights that make the logistic loss over all pairs of all blocks least, by Newton's method."""
    mean, scale = moments(table)

    def pairs(w: np.ndarray) -> Callable:
        def sums(e: np.ndarray, good: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
            z = np.clip((e - mean) / scale, -8, 8)
            a, b = z[good], z[~good]
            ahead = (a @ w)[:, None] - (b @ w)[None, :]
            p = 1 / (1 + np.exp(np.clip(ahead, -50, 50)))
            v = p * (1 - p)
            cross = a.T @ v @ b
            slope = p.sum(axis=0) @ b - p.sum(axis=1) @ a
            bend = (a.T * v.sum(axis=1)) @ a + (b.T * v.sum(axis=0)) @ b - cross - cross.T
            return [np.array([np.logaddexp(0, -ahead).sum(), p.size]), slope, bend]

        return sums

    w = step = np.zeros(len(mean))
    best = np.inf
    for _ in range(rounds):
        (loss, n), slope, bend = over_blocks(table, pairs(w + step))
        loss = loss / max(1, n) + ridge / 2 * float((w + step) @ (w + step))
        if not loss < best:
            # Too long a step.
            step = step / 2
            if np.abs(step).max() < 1e-6:
                break
            continue
        close = best - loss < 1e-7 * loss
        w, best = w + step, loss
        if close:
            break
        step = -np.linalg.solve(bend.reshape(len(w), -1) / max(1, n) + ridge * np.eye(len(w)), slope / max(1, n) + ridge * w)
    return mean, scale, w


def ranked(values: DataFrame, k: int) -> float:
    """The k-th smallest (from 0) of the doubles ``s``, exactly: 16 bits of its place in the order at a time."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = (b["s"].to_numpy(float) + 0.0).view(np.int64)
            yield pd.DataFrame({"p": np.where(raw < 0, ~raw ^ np.int64(-(1 << 63)), raw)})

    left = values.mapInPandas(places, "p long")
    head = None
    for shift in (48, 32, 16, 0):
        part = left if head is None else left.filter(F.shiftright("p", shift + 16) == head)
        # At most 65,536 short rows.
        for r in sorted(part.groupBy(F.shiftright("p", shift).alias("h")).count().collect()):
            if k < r["count"]:
                head = r["h"]
                break
            k -= r["count"]
    raw = np.array([head], np.int64)
    return float(np.where(raw < 0, ~(raw ^ np.int64(-(1 << 63))), raw).astype(np.int64).view(np.float64)[0])


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    return fit_measured(measured(docs), labels)


def fit_measured(stats: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker of all labelled rows. Rows whose label is neither 0 nor 1 are left out; of an id with several labels the largest counts."""
    given = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    per_id = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    rows = scratch(stats.join(per_id, "doc_id"), "quality-labelled")
    counts = {0: 0, 1: 0} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not all(counts.values()):
        drop_scratch(rows)
        size = len(statistics("")) * 3
        return Ranker(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    table = scratch(blocks(rows, counts), "quality-blocks")
    mean, scale, w = fit_pairs(table)

    def strengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": np.clip((expand(np.vstack(b["x"])) - mean) / scale, -8, 8) @ w if len(b) else np.zeros(0)})

    s = scratch(rows.select("x").mapInPandas(strengths, "s double"), "quality-strengths")
    total = sum(counts.values())
    low, high = ranked(s, counts[0] - 1), ranked(s, min(counts[0], total - 1))
    drop_scratch(rows, table, s)
    return Ranker(mean, scale, w, (low + high) / 2)


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    return score_measured(measured(docs, id_col, text_col), ranker)


def score_measured(stats: DataFrame, ranker: Ranker) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack(b["x"]) if len(b) else np.zeros((0, 0))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": ranker.score(x)})

    return stats.mapInPandas(run, "doc_id long, score double")
