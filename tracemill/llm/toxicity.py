"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= j) is the logistic of threshold j minus w.x: all thresholds share the weights w and
are kept in order. x holds log counts of words and word beginnings chosen on the sample. The
result has the expected severity, the likeliest grade and whether any grade above 0 is likelier
than not.

Labels say toxic or not; the grades above 0 come from the dose: how many words of a toxic
sample text are ones that clean sample texts hardly use (``doses``: 1 below 3, 2 below 8, else 3).

Fitting takes at most ``per_class`` labelled rows of each class (default 6000, smallest hashed
ids first, each text once and toxic if any of its rows is) and ``n_features`` features; scoring reads every whole text. Edge
cases: null text is empty and gets grade 0; without toxic labels everything gets severity 0;
repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, scratch, text_of
from .sampling import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)


def word_features(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


@dataclass
class Grader:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def strength(self, text: str, memo: dict[str, tuple[int, ...]]) -> float:
        seen: dict[int, int] = {}
        for w in WORD.findall(text.lower()):
            ids = memo.get(w)
            if ids is None:
                if len(memo) > 100_000:
                    memo.clear()
                # Most words have no feature and share one empty tuple.
                memo[w] = ids = tuple([self.features[f] for f in word_features(w) if f in self.features])
            for i in ids:
                seen[i] = seen.get(i, 0) + 1
        return float(sum(self.weights[i] * np.log1p(n) for i, n in seen.items()))

    def above(self, strength: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - strength[:, None], -50, 50)))


def choose_features(sample: DataFrame, n_features: int) -> DataFrame:
    """(feature, marks): the ``n_features`` features of the sample (text, label) that tell the classes
    apart best; ``marks`` tells those that clean texts hardly use. Counted on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            df = (Counter(), Counter())
            for text, label in zip(b["text"], b["label"], strict=True):
                df[label].update({f for w in set(WORD.findall(text.lower())) for f in word_features(w)})
            names = list(df[0].keys() | df[1].keys())
            yield pd.DataFrame({"feature": names, "clean": [df[0][f] for f in names], "toxic": [df[1][f] for f in names]})

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    seen = sample.select("text", "label").mapInPandas(run, "feature string, clean long, toxic long")
    seen = seen.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("toxic >= 3")
    p = (F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)
    q = (F.col("clean") + 0.5) / (sizes.get(0, 0) + 1)
    ratio = F.ln(p / q)
    marks = (ratio > 3) & (F.col("toxic") >= max(5, sizes.get(1, 0) // 500))
    scored = seen.select("feature", marks.alias("marks"), (F.abs(ratio) * F.sqrt(F.col("clean") + F.col("toxic"))).alias("score"))
    return scored.orderBy(F.desc("score"), "feature").limit(n_features)


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, weight: np.ndarray, n_features: int, rounds: int = 400, ridge: float = 1e-4):
    """Weights and ordered thresholds by weighted maximum likelihood, full-batch adaptive gradient."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], dtype=np.int64)
    val = np.array([v for r in rows for v in r.values()], dtype=np.float64)
    k = int(grades.max())
    w, theta0, gaps = np.zeros(n_features), 1.0, np.zeros(max(0, k - 1))
    acc = np.full(n_features + k, 1e-8)
    weight = weight / weight.sum()
    lo_open, hi_open = grades == 0, grades == k
    n = np.arange(len(rows))
    for _ in range(rounds):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(doc, val * w[col], minlength=len(rows))
        z = np.clip(theta[None, :] - s[:, None], -40, 40)
        cdf = 1 / (1 + np.exp(-z))
        den = cdf * (1 - cdf)
        hi = np.where(hi_open, 1.0, cdf[n, np.minimum(grades, k - 1)])
        lo = np.where(lo_open, 0.0, cdf[n, np.maximum(grades - 1, 0)])
        d_hi = np.where(hi_open, 0.0, den[n, np.minimum(grades, k - 1)])
        d_lo = np.where(lo_open, 0.0, den[n, np.maximum(grades - 1, 0)])
        p = np.maximum(hi - lo, 1e-9)
        ds = weight * (d_hi - d_lo) / p
        g_theta = np.zeros(k)
        np.add.at(g_theta, np.minimum(grades, k - 1), -weight * d_hi / p)
        np.add.at(g_theta, np.maximum(grades - 1, 0), weight * d_lo / p)
        g_w = np.bincount(col, val * ds[doc], minlength=n_features) + ridge * w
        g_gap = np.array([np.exp(gaps[i]) * g_theta[i + 1 :].sum() for i in range(k - 1)])
        grad = np.concatenate([g_w, [g_theta.sum()], g_gap])
        acc += grad * grad
        move = 0.2 * grad / np.sqrt(acc)
        w -= move[:n_features]
        theta0 -= move[n_features]
        gaps -= move[n_features + 1 :]
    return w, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def one_of_each(sample: DataFrame) -> DataFrame:
    """Each text of a labelled sample once, under its largest label; the weights keep each class's share."""
    share = {r["label"]: r["w"] for r in sample.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    texts = scratch(sample.groupBy("text").agg(F.max("label").alias("label")), "sample")
    many = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    weight = F.lit(0.0)
    for label, n in many.items():
        weight = F.when(F.col("label") == label, share[label] / n).otherwise(weight)
    return texts.withColumn("weight", weight)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, n_features: int = 3000, doses: tuple[int, ...] = (3, 8)) -> Grader:
    with only("fit"):
        return _fit(docs, labels, per_class, n_features, doses)


def _fit(docs: DataFrame, labels: DataFrame, per_class: int, n_features: int, doses: tuple[int, ...]) -> Grader:
    sample = one_of_each(scratch(labelled_sample(docs, labels, "toxic", per_class), "labelled"))
    chosen = choose_features(sample, n_features).collect()
    index = {r["feature"]: i for i, r in enumerate(chosen)}
    marks = {r["feature"] for r in chosen if r["marks"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                row: Counter = Counter()
                dose = 0
                for w, n in counts(text).items():
                    fs = word_features(w)
                    dose += n * any(f in marks for f in fs)
                    for f in fs:
                        if f in index:
                            row[index[f]] += n
                out.append((list(row), list(row.values()), dose))
            ids, n, dose = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"label": b["label"], "weight": b["weight"], "ids": ids, "n": n, "dose": dose})

    # Only the chosen features of the bounded sample come to the driver.
    got = sample.mapInPandas(run, "label int, weight double, ids array<int>, n array<int>, dose int").toPandas()
    if got["label"].nunique() < 2 or not chosen:
        return Grader({}, np.zeros(0), np.array([40.0]))
    got = got.sort_values(["label", "dose", "ids"], key=lambda c: c.map(tuple) if c.name == "ids" else c, ignore_index=True)
    matrix = [dict(zip(map(int, i), np.log1p(np.asarray(n)).tolist(), strict=True)) for i, n in zip(got["ids"], got["n"], strict=True)]
    grades = got["label"].to_numpy() * (1 + sum((got["dose"].to_numpy() >= d).astype(int) for d in doses))
    levels = np.unique(np.concatenate([[0], grades]))
    w, theta = fit_ordinal(matrix, np.searchsorted(levels, grades), got["weight"].to_numpy(), len(chosen))
    return Grader(index, w, theta)


def grade(docs: DataFrame, grader: Grader, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade, toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            above = grader.above(np.array([grader.strength(t, memo) for t in b["text"]], dtype=float))
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "severity": above.sum(axis=1),
                "grade": (above >= 0.5).sum(axis=1),
                "toxic": above[:, 0] >= 0.5,
            })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(
        run, "doc_id long, severity double, grade int, toxic boolean"
    )


def reject(docs: DataFrame, grader: Grader) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns and repeated rows; nothing is shuffled. Null and empty texts
    stay. An empty table stays empty."""

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[int, ...]] = {}
        for text in batches:
            above = grader.above(np.array([grader.strength(t, memo) for t in text], dtype=float))
            yield pd.Series(above[:, 0] >= 0.5)

    return docs.filter(~toxic(text_of("text")))
