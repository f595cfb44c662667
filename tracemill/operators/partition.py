"""Chunks, samples, limits and resuming.

Position-based operators take the order column explicitly. Positions over the whole table come
from counts per range of the order column, so no task ever numbers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_len
from ..sources.shared import materialise


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Number of the row in the order of the columns, from 0.

    Rows are range-partitioned and sorted by the order and numbered within their range; a row's position
    is that number and the count of the ranges before it. The ranges come from a sample, so they are
    written once for both uses. Only one count per range is gathered. Ties are numbered in any order, so the
    order should be unique."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # The id is the number of the partition above that of the row in it.
    numbered = materialise(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = numbered.groupBy(part.alias("_part")).count()
    # One row per partition, so a window over all of them is small.
    before = counts.select("_part", F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    out = numbered.join(F.broadcast(before), part == F.col("_part"))
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + own).cast("long")).drop("_id", "_part", "_before")


def split_chunks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``chunk`` 0 to n - 1: contiguous chunks of ceil(rows / n), the last ones short or empty."""
    size = max(1, -(-df.count() // n))
    return with_position(df, order, "_pos").withColumn("chunk", F.floor(F.col("_pos") / size).cast("long")).drop("_pos")


def get_chunk(df: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """The k-th of n chunks; empty when there are fewer."""
    return split_chunks(df, order, n).filter(F.col("chunk") == k).drop("chunk")


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def single_row(df: DataFrame, order: list[str], k: int) -> DataFrame:
    return df.orderBy(*order).offset(k).limit(1)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch``: fixed-size batches in order; the last may be short."""
    return with_position(df, order, "_pos").withColumn("batch", F.floor(F.col("_pos") / size).cast("long")).drop("_pos")


def resume(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is not in ``done``."""
    return df.join(done.select(key), key, "left_anti")


def id_number(key: Column | str) -> Column:
    """The number behind the last underscore of an id."""
    c = F.col(key) if isinstance(key, str) else key
    return F.substring_index(c.cast("string"), "_", -1).try_cast("long")


def resume_after(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose id number is above the highest one done."""
    last = done.agg(F.max(id_number(key)).alias("_last"))  # one row
    return df.join(F.broadcast(last), id_number(key) > F.coalesce("_last", F.lit(-1))).drop("_last")


def test_split(df: DataFrame, key: Column, order: list[str], ratio: float) -> DataFrame:
    """``is_test``: exactly int(rows * ratio) rows with the smallest ``key`` (ties by ``order``, which should be unique).

    Only key and order are ranged and numbered; the row that cuts the table is one, so the rest stays where it is."""
    n = int(df.count() * ratio)
    names = ["_key", *order]
    place = F.struct(key.alias("_key"), *order)
    narrow = df.select(place.alias("_p")).select("_p.*")
    cut = with_position(narrow, names, "_pos").filter(F.col("_pos") == n - 1).select(*names).first() if n else None
    if cut is None:
        return df.withColumn("is_test", F.lit(False))
    last = F.struct(*[F.lit(v).cast(narrow.schema[c].dataType).alias(c) for c, v in zip(names, cut, strict=True)])
    return df.withColumn("is_test", place <= last)


def first_answers(cand: DataFrame, n: int) -> DataFrame:
    """The first n candidates with an answer, for each id."""
    w = W.partitionBy("id").orderBy("cand_idx")
    some = cand.filter(F.col("answer").isNotNull() & (F.col("answer") != ""))
    return some.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def top_k(df: DataFrame, group: list[str], by: str, position: str, k: int) -> DataFrame:
    """The k highest of each group, and their ``rank``; ties keep their position."""
    w = W.partitionBy(*group).orderBy(F.desc(by), position)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_unless_negative(df: DataFrame, group: list[str], by: str, position: str, k: int, negatives: str) -> DataFrame:
    """:func:`top_k` for groups without negatives (``negatives`` = 0); other groups stay whole."""
    w = W.partitionBy(*group).orderBy(F.desc(by), position)
    return df.withColumn("rank", F.row_number().over(w)).filter((F.col(negatives) > 0) | (F.col("rank") <= k))


def balance_classes(df: DataFrame, group: list[str], label: str, by: str, position: str, k: int) -> DataFrame:
    """Of both classes (label 1 and 0) of a group the k first by ``by`` descending; k = -1: as many
    as the smaller class has, k = 0: as the larger one has, in their own order."""
    whole = W.partitionBy(*group)
    n1 = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(whole)
    n0 = F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).over(whole)
    limit = {-1: F.least(n1, n0), 0: F.greatest(n1, n0)}.get(k, F.lit(k))
    order = [position] if k == 0 else [F.desc(by), position]
    out = df.withColumn("_limit", limit).withColumn("rank", F.row_number().over(W.partitionBy(*group, label).orderBy(*order)))
    return out.filter(F.col("rank") <= F.col("_limit")).drop("_limit")


def drop_overlong(df: DataFrame, text: str, limit: int, length=token_len) -> DataFrame:
    """Rows of at most ``limit`` tokens; ``length`` is a function of the text column."""
    return df.filter(length(F.col(text)) <= limit)
