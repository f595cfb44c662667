"""A blocked Bloom filter as a table of 4 KB bitmaps, probed by DataFrame functions.

It keeps rows that can't match from being shuffled: they pass straight through, and only possible
matches go on to an exact join. The filter is broadcast in slices of at most ``SLICE_BYTES``, so each
broadcast has a fixed bound, and rows of any number stay where they are while they pass one
hash join for each slice. A filter takes two bytes per key: 33 million keys a slice. Broadcast blocks
that don't fit an executor's memory are kept on its disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch

BLOCK_BITS = 32_768  # cells of one bitmap of bitmap_construct_agg
SLICE_BYTES = 64 << 20


class Bloom:
    def __init__(self, keys: DataFrame, count: int, least_hits: int = 1, bits_per_key: int = 16):
        """Of the column ``key``: the cells that at least ``least_hits`` rows hit."""
        self.blocks = 1 << (max(1, count * bits_per_key // BLOCK_BITS) - 1).bit_length()
        block, one, two = self.cells(F.col("key"))
        hits = keys.select(block.alias("block"), F.explode(F.array_distinct(F.array(one, two))).alias("cell"))
        # Rows of a hot key are counted before they are shuffled.
        cells = hits.groupBy("block", "cell").count().filter(F.col("count") >= least_hits)
        filled = cells.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bitmap"))
        self.table = scratch(filled, "bloom")
        self.slice = max(1, SLICE_BYTES // (BLOCK_BITS // 8))

    def cells(self, key: Column) -> tuple[Column, Column, Column]:
        """Block number and the two cells within the block."""
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
        return F.pmod(a, F.lit(self.blocks)), F.pmod(b, F.lit(BLOCK_BITS)), F.pmod(F.shiftright(b, 24), F.lit(BLOCK_BITS))

    @staticmethod
    def bit(bitmap: Column, cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bitmap, (F.floor(cell / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(cell, F.lit(8)))), F.lit(2)) == 1

    def probe(self, df: DataFrame, key: Column) -> DataFrame:
        """``df`` and ``_maybe``: whether the key may be in the filter. ``df`` is not shuffled."""
        block, one, two = self.cells(key)
        first = range(0, self.blocks, self.slice)
        for i, low in enumerate(first):
            part = self.table.filter((F.col("block") >= low) & (F.col("block") < low + self.slice))
            part = F.broadcast(part.select(F.col("block").alias(f"_block{i}"), F.col("bitmap").alias(f"_bitmap{i}")))
            df = df.join(part, block == F.col(f"_block{i}"), "left")
        bitmap = F.coalesce(*[F.col(f"_bitmap{i}") for i in range(len(first))])
        maybe = F.coalesce(self.bit(bitmap, one) & self.bit(bitmap, two), F.lit(False))
        return df.withColumn("_maybe", maybe).drop(*[f"{c}{i}" for i in range(len(first)) for c in ("_block", "_bitmap")])

    def matches(self, df: DataFrame, key: Column) -> DataFrame:
        return self.probe(df, key).filter("_maybe").drop("_maybe")

    def others(self, df: DataFrame, key: Column) -> DataFrame:
        return self.probe(df, key).filter("not _maybe").drop("_maybe")

    def drop(self) -> None:
        """Remove the files, when all that was probed is written."""
        drop_scratch(self.table)
