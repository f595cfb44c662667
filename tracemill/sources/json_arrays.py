"""Large JSON documents read by many tasks.

Spark's reader gives a whole document to one task. Here a document is cut at every closing brace by the text
reader, which splits files by byte ranges. What a range means depends on whether it begins in a string and in
how many objects, so a first pass sums up each range for both cases (quotes, openings less closings); running sums over
the ranges of a file, one short row each, give the state each begins in. A second pass, with that state, cuts the
records. Records over the border of two ranges are put together from their pieces; all others stay where they were read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of a JSON string: what a backslash takes the meaning from. A backslash never stands before a closing brace.
ESCAPED = re.compile(r"\\.", re.DOTALL)


def _openings(text: str, inside: bool) -> tuple[int, bool]:
    """Opening braces outside strings, and whether the text ends in a string."""
    parts = (ESCAPED.sub("", text) if "\\" in text else text).split('"')
    return sum(p.count("{") for p in parts[inside::2]), inside ^ (len(parts) % 2 == 0)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, flips, out, within) of each range: whether it ends in a string if it does not begin in one, and the change of depth
    from outside and from within a string."""
    place, cases = None, [[0, False], [0, True]]

    def row() -> pa.RecordBatch:
        (out, flips), (within, _) = cases
        return pa.RecordBatch.from_pydict({"file": [place[0]], "block": [place[1]], "flips": pa.array([int(flips)], pa.int32()), "out": [out], "within": [within]})

    for b in batches:
        for text, *at in zip(b["value"].to_pylist(), b["file"].to_pylist(), b["block"].to_pylist(), strict=True):
            if at != place:
                if place:
                    yield row()
                place, cases = at, [[0, False], [0, True]]
            for case in cases:
                opened, case[1] = _openings(text, case[1])
                case[0] += opened - (not case[1])
    if place:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, pos, whole, opens, text): records of a range; one that began before it, or goes on after it, as a piece."""
    place, depth, inside, pos, opens, text = None, 0, False, 0, False, ""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ("file", "block", "pos", "whole", "opens", "text")
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    for b in batches:
        rows = []
        columns = (b[c].to_pylist() for c in ("file", "block", "depth", "inside", "value"))
        for file, block, first_depth, first_inside, value in zip(*columns, strict=True):
            if (file, block) != place:
                if place and depth > 0:
                    rows.append((*place, pos, False, opens, text))
                place, depth, inside, pos, opens, text = (file, block), first_depth, first_inside, 0, False, ""
            opened, inside = _openings(value, inside)
            if depth == 0 and opened:
                value, opens = value[value.index("{") :], True
            if depth + opened > 0:
                text += value + "}"
            depth += opened - (not inside)
            if depth == 0 and text:
                rows.append((*place, pos, opens, opens, text))
                pos, opens, text = pos + 1, False, ""
            depth = max(depth, 0)
        if rows:
            yield batch(rows)
    if place and depth > 0:
        yield batch([(*place, pos, False, opens, text)])


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """The objects of documents that are an array of objects, or one object, as rows of ``schema``.

    Equal to the multi-line reader, but for these: elements that are no objects give no row, objects in an array in the outer array are
    rows too, rows are in no fixed order, and a record that does not parse is a row of nulls, alone. Empty files and ``[]`` have no rows.
    One short row per byte range (``spark.sql.files.maxPartitionBytes``) is broadcast, 100 MB at about a million ranges. A record lies in one value,
    of any number of ranges. Compressed files are one range. If ranges change between the passes, the read fails rather than guess."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    begins = _beginnings(pieces).select("file", "block", "depth", "inside")
    placed = pieces.join(F.broadcast(begins), ["file", "block"], "left")
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("byte ranges changed while a document was read"))).otherwise(F.col("inside"))
    placed = placed.select("file", "block", "depth", known.cast("boolean").alias("inside"), "value")
    cut = placed.mapInArrow(_cut, "file string, block long, pos long, whole boolean, opens boolean, text string")
    order = W.partitionBy("file").orderBy("block", "pos")
    torn = cut.filter("not whole").withColumn("record", F.count_if("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    mended = torn.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "text"))).alias("p"))
    texts = cut.filter("whole").select("text").unionByName(mended.select(F.array_join("p.text", "").alias("text")))
    return texts.select(F.from_json("text", schema).alias("r")).select("r.*")


def _beginnings(pieces: DataFrame) -> DataFrame:
    """(file, block, depth, inside): the state at the beginning of each byte range that has a row."""
    summed = pieces.mapInArrow(_sum_up, "file string, block long, flips int, out long, within long")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = summed.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("within")).otherwise(F.col("out"))
    return inside.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)).cast("int"))
