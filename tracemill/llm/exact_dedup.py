"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every whole text once and counts how often each cell of a blocked Bloom filter
is hit; the cells hit at least twice form the filter of possible repeats. Pass 2 probes it:
a text with a cell hit only once is certainly unique and passes straight through; only the
rest is shuffled and grouped by its full digest, so a false positive costs a row and never
a wrong answer.

Edge cases: null text counts as the empty text, and empty texts are equal to one another. Of equal
texts the row with the largest id stays; null ids are smaller than all others. Rows repeated
with the same id and text count in ``group_size``; :func:`decisions` marks each of them alike,
:func:`deduplicate` returns one. An empty table gives an empty result. Other columns are
neither read nor in the way, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import drop_scratch, scratch, text_of
from .graph import join_groups


def digest(text: Column) -> Column:
    return F.sha2(text_of(text).cast("binary"), 256)


class PossibleRepeats:
    """The filter of cells that digests hit at least twice; a digest with a cell hit once is unique."""

    def __init__(self, digests: DataFrame):
        self.rows = digests.count()
        self.filter = Bloom(digests.select(F.col("text_sha256").alias("key")), self.rows, least_hits=2)

    def probe(self, df: DataFrame) -> DataFrame:
        return self.filter.probe(df, F.col("text_sha256"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return scratch(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")


def _groups(maybe: DataFrame) -> DataFrame:
    """Per digest that occurs more than once: keep_id, group_size and how many rows have keep_id."""
    ids = maybe.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    last = F.max(F.struct(F.col("doc_id"), F.col("n")))
    return (
        ids.groupBy("text_sha256")
        .agg(last.alias("last"), F.sum("n").alias("group_size"))
        .filter("group_size > 1")
        .select("text_sha256", F.col("last.doc_id").alias("keep_id"), "group_size", F.col("last.n").alias("n_keep"))
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs, id_col, text_col)
    repeats = PossibleRepeats(digests)
    probed = repeats.probe(digests)
    maybe = probed.filter("_maybe").drop("_maybe")
    single = probed.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    joined = join_groups(maybe, scratch(_groups(maybe), "groups"), ["text_sha256"], "group_size", repeats.rows)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return single.unionByName(
        joined.select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and one row for each text.

    Groups are settled on short rows of digest and id. Texts of possible repeats then meet the decision on
    their digest and id together, so copies of one text spread over all tasks.
    """
    digests = _digests(docs, id_col, text_col)
    repeats = PossibleRepeats(digests)
    maybe = repeats.probe(digests).filter("_maybe").drop("_maybe")
    ids = maybe.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = scratch(_groups(maybe), "groups")
    known = join_groups(ids, groups, ["text_sha256"], "group_size", repeats.rows).filter("group_size is not null")
    known = scratch(
        known.select(
            F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_keep"), (F.col("n") > 1).alias("_twice")
        ),
        "known",
    )
    drop_scratch(groups, digests)
    # Packed, so columns of any name are safe.
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))
    probed = repeats.probe(packed)
    found = probed.filter("_maybe").join(known, (F.col("text_sha256") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    stays = found.filter(F.coalesce("_keep", F.lit(True)))
    twice = F.coalesce("_twice", F.lit(False))
    return (
        probed.filter(~F.col("_maybe"))
        .select("row.*")
        .unionByName(stays.filter(~twice).select("row.*"))
        .unionByName(stays.filter(twice).dropDuplicates(["doc_id", "text_sha256"]).select("row.*"))
    )
