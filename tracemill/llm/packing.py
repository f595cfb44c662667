"""Harmonic packing of token sequences.

Capacity 2048 has a class for each k: bins of class k hold exactly k pieces of at most
2048 // k tokens. A document's full 2048-token runs are sequences of their own; its rest is
cut into pieces of exactly 2048 // k tokens (the smallest k that fits) until at most
``small`` tokens are left. Such small pieces are the last class, whose bins are filled one after the
other: a bin is full when the next piece does not fit.

Each worker fills the bins of all classes on its own. What its open bins hold at the end, fewer than k pieces of
class k and one bin of small ones, is packed first-fit by decreasing length; bins that come to ``full`` of
the capacity are done, and the few pieces of the others meet those of other workers in rounds of ``fan_in``.
The last round leaves nothing open.

Edge cases: null text is empty; an empty text still has its end token and so one piece.
Repeated rows and null ids are packed like others. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, worker long, class int"
SMALL = 0  # number of the last class
ROUND_BITS, WORKER_BITS = 58, 34  # sequence_id = round, worker, number within the worker


def cuts(rest: int, capacity: int, small: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a rest shorter than the capacity."""
    out = []
    while rest:
        if rest <= small:
            out.append((rest, SMALL))
            break
        k = -(-capacity // rest)
        size = capacity // k
        out.append((size, k))
        rest -= size
    return out


class Bins:
    """Open bins of one worker, one for each class; ``put`` numbers the pieces of a full one."""

    def __init__(self, first_id: int, capacity: int):
        self.next, self.capacity = first_id, capacity
        self.open: dict[int, list[list]] = {}
        self.held = 0  # tokens in the open bin of the last class

    def put(self, piece: list, k: int) -> list[list]:
        done = []
        if k == SMALL:
            if self.held + piece[2] > self.capacity:
                done, self.held = self.close(self.open.pop(SMALL)), 0
            self.held += piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            done = self.close(self.open.pop(k))
        return done

    def close(self, bin_: list[list]) -> list[list]:
        at, out = 0, []
        for p in bin_:
            out.append([*p[:5], self.next, at, p[7], p[8]])
            at += p[2]
        self.next += 1
        return out

    def first_fit(self, full: float) -> list[list]:
        """All open pieces, packed first-fit by decreasing length; those of bins under the share ``full`` stay open."""
        bins: list[list] = []
        for p in sorted((p for b in self.open.values() for p in b), key=lambda p: (-p[2], str(p[0]), p[1])):
            found = next((b for b in bins if p[2] <= b[0]), None)
            if found is None:
                found = [self.capacity, []]
                bins.append(found)
            found[0] -= p[2]
            found[1].append(p)
        self.open, self.held = {}, 0
        done = [b for room, b in bins if self.capacity - room >= full * self.capacity]
        left = [p for room, b in bins if self.capacity - room < full * self.capacity for p in b]
        return [p for b in done for p in self.close(b)] + left


def _frame(rows: list[list]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return out.astype({c: "Int64" for c in ("doc_id", "sequence_id", "offset")})


def _first_round(vocabulary: str, capacity: int, small: int, end_id: int, full: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyspark import TaskContext

        from .vocabulary import byte_encoder

        encoder = byte_encoder(vocabulary)
        worker = TaskContext.get().partitionId()
        bins = Bins(worker << WORKER_BITS, capacity)
        for batch in batches:
            rows: list[list] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                n, at = len(ids), 0
                whole = n // capacity
                for size, k in [(capacity, 1)] * whole + cuts(n - whole * capacity, capacity, small):
                    piece = [doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), n, None, None, worker, k]
                    rows += bins.put(piece, k)
                    at += size
            yield _frame(rows)
        yield _frame(bins.first_fit(full))

    return run


def _later_round(number: int, capacity: int, full: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bins, worker = Bins((number << ROUND_BITS) | (int(key[0]) << WORKER_BITS), capacity), int(key[0])
        out: list[list] = []
        for p in group.sort_values(["worker", "class", "doc_id", "start"]).itertuples(index=False):
            piece = [None if pd.isna(p[0]) else int(p[0]), *map(int, p[1:5]), None, None, worker, int(p[8])]
            out += bins.put(piece, piece[8])
        return _frame(out + bins.first_fit(full))

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    small: int = 64,
    end_id: int = 1,
    fan_in: int = 256,
    full: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = scratch(source.mapInPandas(_first_round(vocabulary, capacity, small, end_id, full), SCHEMA), "pieces")
    done = [pieces.filter("sequence_id is not null")]
    rest = pieces.filter("sequence_id is null")
    # A worker leaves the pieces of a few bins: under k pieces of each class k and one bin of small ones at the
    # very most, so a group of fan_in workers stays small.
    workers, number = (rest.agg(F.max("worker")).first()[0] or 0) + 1, 0
    while rest is not None:
        number += 1
        workers = -(-workers // fan_in)
        packed = rest.groupBy(F.floor(F.col("worker") / fan_in).alias("group")).applyInPandas(
            _later_round(number, capacity, 0.0 if workers == 1 else full), SCHEMA
        )
        packed = scratch(packed, "rests")
        done.append(packed.filter("sequence_id is not null"))
        rest = packed.filter("sequence_id is null") if workers > 1 else None
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("worker", "class")
