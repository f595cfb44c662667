"""Audit of how document filters interact: what each removes alone, after others, and over all orders.

Five filters fail a document: A too few words, B too few distinct words, C too many capitals, D a forbidden
character, E an exact copy of a document with a smaller id. E is found by sorting: documents are dealt in ranges of text
fingerprint and id and sorted by fingerprint, whole text and id, so copies are neighbours and each row is compared with the one
before. A group of copies may fill many ranges; a range's first group goes on from the range before if the last text there
equals its first, which is settled by a join of one row per range. Ranges are dealt by a SHA-256 fingerprint and not by the text
itself, as Spark gathers a sample of range keys on the driver.

Each document then is a mask of failed filters. The documents of a part (a language) are merged into counts for each of the 32
masks, which add up over tasks, and all orders are answered from these counts: what a filter removes in an order are the
masks that hold it and none of the filters before it.

Edge cases: null text counts as empty, null part as the empty string. Null ids are smaller than all others; rows repeated with
the same id and text are no copies of one another. Labels may be missing (neither good nor toxic) or repeated (the larger value
counts). A table of no rows has no parts and gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, text_of

FILTERS = "ABCDE"
SORTED_ROWS = "doc_id long, part string, mask int, range int, kind int, text string"
#: Kinds of rows that a sorted range gives: settled, waiting for the range before, its first text, its last text.
SETTLED, WAITING, FIRST, LAST = range(4)


def text_failures(text: Column, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> Column:
    """Mask of the filters A to D that a text fails: 1, 2, 4 and 8."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    # The words are bound once, so the text is split once.
    of_words = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < least_words, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < distinct_percent * F.size(w), 2).otherwise(0),
    )[0]
    of_letters = F.when(100 * capitals > capital_percent * F.length(text), 4).otherwise(0)
    return of_words + of_letters + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range, each compared with the row before."""
    at = TaskContext.get().partitionId()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("range", pa.int32()), ("kind", pa.int32()), ("text", pa.string())]
    )
    sha = text = lowest = None
    in_first = True

    def border(kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"range": at, "kind": kind, "text": text.as_py()}], schema)

    for b in batches:
        texts, masks, kinds = b["text"], b["mask"].to_pylist(), []
        for i, (doc_id, key) in enumerate(zip(b["doc_id"].to_pylist(), b["fingerprint"].to_pylist(), strict=True)):
            if key != sha or not texts[i].equals(text):
                in_first = sha is None
                sha, text, lowest = key, texts[i], doc_id
                if in_first:
                    yield border(FIRST)
            smallest = doc_id == lowest
            masks[i] |= 0 if smallest else 16
            kinds.append(WAITING if smallest and in_first else SETTLED)
        n = len(kinds)
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["part"], pa.array(masks, pa.int32()), pa.array([at] * n, pa.int32()), pa.array(kinds, pa.int32()), pa.nulls(n, pa.string())], schema=schema
        )
    if sha is not None:
        yield border(LAST)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, part, mask of failed filters (A 1, B 2, C 4, D 8, E 16). Runs the sort as a job."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(part_col).alias("part"), text_of(text_col).alias("text"))
    ranged = source.withColumn("fingerprint", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).repartitionByRange("fingerprint", "doc_id")
    ordered = ranged.sortWithinPartitions("fingerprint", "text", "doc_id")
    # Masks are made after the shuffle: sampling the ranges would make them a second time.
    marked = ordered.select("doc_id", "part", text_failures(F.col("text")).cast("int").alias("mask"), "fingerprint", "text")
    with only("failures") as keep:
        rows = keep(marked.mapInArrow(_compare, SORTED_ROWS))
        ends = rows.filter(F.col("kind") >= FIRST).select("range", "kind", "text")
        # Ranges without rows have no ends, so the range before is the last one that has.
        numbers = ends.filter(F.col("kind") == LAST).select("range").withColumn("next", F.lead("range").over(Window.orderBy("range")))
        last = ends.filter(F.col("kind") == LAST).join(numbers, "range").select(F.col("next").alias("range"), F.col("text").alias("before"))
        goes_on = ends.filter(F.col("kind") == FIRST).join(last, "range").filter(F.col("text") == F.col("before")).select("range", F.lit(16).alias("copy"))
        settled = rows.filter(F.col("kind") == SETTLED).select("doc_id", "part", "mask")
        waiting = rows.filter(F.col("kind") == WAITING).join(goes_on, "range", "left")
        return keep(settled.unionByName(waiting.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0))).alias("mask"))))


def counters(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per part and mask: n, good and toxic documents. Counts of tables add up."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # An id may repeat: rows that are alike are one before they meet the labels.
    alike = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    times = lambda flag: F.coalesce(F.sum(F.col("n") * F.col(flag)), F.lit(0)).alias(flag)
    return alike.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good"), times("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, from the counters: one row per part, order and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = (
        parts.withColumn("filter_order", F.explode(orders))
        .select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("at", "letter"))
        .withColumn("step", (F.col("at") + 1).cast("int"))
        .withColumn("bit", _bit(F.col("letter"), filters))
        .withColumn("before", F.aggregate(F.split(F.substr("filter_order", F.lit(1), F.col("at")), ""), F.lit(0), lambda a, c: a.bitwiseOR(_bit(c, filters))))
    )

    def total(condition, value="n") -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(condition(m["mask"]), m[value] if isinstance(value, str) else value(m)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    early = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~early(m)
    all_orders = math.factorial(len(filters))
    # By symmetry each of the k filters that a document fails is the first of them in 1/k of the orders.
    share = lambda m: m["n"] * F.floor(F.lit(all_orders) / F.bit_count(m["mask"])).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m) & ~early(m)).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & early(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def _bit(letter: Column, filters: str) -> Column:
    """1, 2, 4, ... for the letters in their natural order, 0 for an empty string."""
    at = F.instr(F.lit(filters), letter)
    return F.when(letter == "", 0).otherwise(F.pow(F.lit(2), at - 1).cast("int"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic)."""
    return interactions(counters(failures(docs), labels))
