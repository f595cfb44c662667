"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of


STEPS = 1 << 30


def hashed_part(df: DataFrame, columns: list[str], wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of the ``total`` rows, by the hash of the columns: the same rows on every run.

    A filter on the executors; nothing is sorted or gathered to choose the rows."""
    if wanted >= total:
        return df
    return df.filter(F.pmod(F.xxhash64(*columns), F.lit(STEPS)) < int(STEPS * wanted / total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label, weight for at most ``per_class`` labelled rows of each of 0 and 1.

    Rows are taken by the smallest hash of their id, so the sample is the same on every run.
    ``weight`` restores the share of each class among all labelled rows. Rows whose label is
    neither 0 nor 1 are left out; of an id with several labels the largest counts.
    """
    per_id = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in per_id.groupBy("label").count().collect()}
    total = sum(counts.values()) or 1
    parts = []
    for value in (0, 1):
        n = counts.get(value, 0)
        # A little over per_class rows go on to the exact limit.
        some = hashed_part(per_id.filter(F.col("label") == value), ["doc_id"], per_class + per_class // 4 + 1000, n)
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        weight = n / max(1, min(n, per_class)) / total
        parts.append(some.select("doc_id", F.col("label").cast("int").alias("label"), F.lit(float(weight)).alias("weight")))
    # At most 2 * per_class short rows.
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select("doc_id", text_of("text").alias("text")).join(ids, "doc_id")
