"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketching throws all shingles of a document into ``t`` bins round after round; a bin keeps the
smallest value of the first round that reaches it. After t rounds of random bins, round t + i sends
everything to bin i, so every coordinate is filled. Two sketches agree in a coordinate with
probability equal to the Jaccard similarity, and the mean over coordinates concentrates.
``bands`` x ``rows`` coordinates are hashed into band keys; documents that share one are candidates.

Words are hashed eight bytes at a time with a key that is drawn for each run, so shingle sets are sets of 64-bit hashes that
no text can be made to collide in; by chance two shingles do with 2^-64. Documents with equal shingle sets are one class, stood for by its smallest id. The smallest id of a
bucket is its hub, and all members of the hub's buckets are its members. Members are first
verified against their hub, on the full sets. Those not connected to it by then are verified
against all other members of the hub, in pairs of blocks of ``block`` documents: a task counts the
common shingles of its two blocks by one matrix product and gives only a spanning forest of
the links found, so neither pairs nor links are ever listed. Every pair of documents that
share a band key is so verified, or connected through others.

Edge cases: null text is empty; documents without words link with nothing; with fewer words
than a shingle the whole sequence is one. Rows repeated with one id are one document when
texts agree. Rows with a null id link with nothing: component_id is null and kept is true. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import drop_scratch, only, scratch, text_of
from .graph import components, join_groups, local_roots
from .hashing import mix, new_key, salt, shingles

CHUNK = 1 << 19  # bytes of text worked on at once


def sketch(hashes: np.ndarray, owner: np.ndarray, docs: int, t: int) -> np.ndarray:
    """docs x t coordinates; rows of documents without shingles stay at the top value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(docs * t, top, np.uint64)
    filled = np.zeros(docs * t, bool)
    h, d = hashes, owner.astype(np.int64)
    for i in range(2 * t):
        if not len(h):
            break
        value = mix(h + salt(i + 1))
        bin_ = (value >> np.uint64(32)) % np.uint64(t) if i < t else np.uint64(i - t)
        cell = d * t + np.asarray(bin_).astype(np.int64)
        value = mix(value)
        free = ~filled[cell]
        cell, value = cell[free], value[free]
        np.minimum.at(out, cell, value)
        filled[cell] = True
        if i % 4 == 3 or i > t:
            done = filled.reshape(docs, t).all(axis=1)
            left = ~done[d]
            h, d = h[left], d[left]
    return out.reshape(docs, t)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(coordinates), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(coordinates), salt(b + 1))
        for r in range(rows):
            k = mix(k + coordinates[:, b * rows + r])
        keys[:, b] = k
    return keys.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < CHUNK):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def sketches(docs: DataFrame, width: int, bands: int, rows: int, key: int = 0) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (of the set), bands (array of keys, empty without shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b["text"]]
            ids = b["doc_id"].astype("Int64")
            for i, j in _chunks(texts):
                h, owner = shingles(texts[i:j], width, key)
                n = np.bincount(owner, minlength=j - i)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(s)))]) for s in (11, 13)]
                k1, k2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                keys = band_keys(sketch(h, owner, j - i, bands * rows), bands, rows)
                yield pd.DataFrame({
                    "doc_id": ids[i:j].reset_index(drop=True), "n_shingles": n, "k1": k1, "k2": k2,
                    "bands": [keys[x] if n[x] else np.zeros(0, np.int64) for x in range(j - i)],
                })

    return docs.mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int, key: int = 0) -> DataFrame:
    """doc_id, shingles (array of long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b["text"]]
            ids = b["doc_id"]
            for i, j in _chunks(texts):
                h, owner = shingles(texts[i:j], width, key)
                sets = np.split(h.view(np.int64), np.searchsorted(owner, np.arange(1, j - i)))
                yield pd.DataFrame({"doc_id": ids[i:j].reset_index(drop=True), "shingles": sets})

    return docs.mapInPandas(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    An ``a`` with many partners is dealt to several tasks, about ``block`` partners each.
    """
    many = scratch(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many")), "partners")
    parts = F.ceil(F.col("many") / block).cast("int")
    dealt = join_groups(pairs, many, ["a"], "many", pairs.count()).withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("many")
    left = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = many.join(right, "a").select("a", "sa", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return dealt.join(left, "b").join(right, ["a", "part"]).filter(both * 100 >= union * percent).select("a", "b")


def _compare(percent: int):
    """Links between the two sides of a block, as (node, smallest node reached within the block)."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g["side"] == 0], g[g["side"] == 1]
        none = pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        if left.empty or right.empty:
            return none
        sides = []
        for part in (left, right):
            size = part["shingles"].map(len).to_numpy()
            sides.append((np.concatenate(part["shingles"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(part)), size), size))
        (lh, lo, ln), (rh, ro, rn) = sides
        words = np.intersect1d(lh, rh)
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ones = []
            for h, o, n in ((lh, lo, len(left)), (rh, ro, len(right))):
                pos = np.minimum(np.searchsorted(some, h), len(some) - 1)
                hit = some[pos] == h
                m = np.zeros((n, len(some)), np.float32)
                m[o[hit], pos[hit]] = 1
                ones.append(m)
            both += ones[0] @ ones[1].T
        linked = both * 100 >= (ln[:, None] + rn[None, :] - both) * percent
        i, j = np.nonzero(linked)
        a, b = left["rep"].to_numpy()[i], right["rep"].to_numpy()[j]
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        if not len(nodes):
            return none
        root = nodes[local_roots(len(nodes), index[: len(a)], index[len(a) :])]
        return pd.DataFrame({"a": nodes, "b": root})[nodes != root]

    return run


def _blocks(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The members (hub, rep, apart) of each hub as pairs of blocks: those apart against all."""
    sized = members.groupBy("hub").agg(F.count(F.lit(1)).alias("many"), F.ceil(F.count(F.when(F.col("apart"), 1)) / block).cast("int").alias("rows"))
    sized = scratch(sized.withColumn("cols", F.ceil(F.col("many") / block).cast("int")), "sized")
    dealt = join_groups(members, sized, ["hub"], "many", members.count()).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    number = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("apart").select("hub", number("rows").alias("i"), every("cols").alias("j"), F.lit(0).alias("side"), "rep", "shingles")
    right = dealt.select("hub", every("rows").alias("i"), number("cols").alias("j"), F.lit(1).alias("side"), "rep", "shingles")
    return left.unionByName(right)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 28, rows: int = 5, block: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    secret = new_key()
    rows_ = scratch(sketches(source, width, bands, rows, secret), "sketches")
    known = rows_.filter("doc_id is not null and n_shingles > 0")
    classes = scratch(
        known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.min_by("bands", "doc_id").alias("bands")),
        "classes",
    )
    entry = classes.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = entry.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rep", "n")).alias("h")).filter("m > 1")
    shared = scratch(shared.select("key", "m", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n")), "shared")
    # Each bucket is known by its hub from here on: the pairs of a bucket are pairs of its hub's members.
    met = join_groups(entry, shared, ["key"], "m", classes.count() * bands).filter("hub is not null")
    members = scratch(met.select("hub", "hub_n", "rep", "n").distinct(), "members")
    # Texts of the few documents with candidates; the others are told by the filter and not moved.
    involved = scratch(members.select(F.col("rep").alias("doc_id")).distinct(), "involved")
    known_ids = Bloom(involved.select(F.col("doc_id").alias("key")), involved.count())
    some = known_ids.matches(source, F.col("doc_id")).join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = scratch(shingle_sets(some, width, secret), "sets")

    # Every member against its hub.
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    to_hub = members.filter(fits & (F.col("rep") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = scratch(verified(to_hub, sets, percent, block), "links")
    label = scratch(components(links), "components")

    # Members still apart from their hub against all its members.
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    now = members.join(of("rep"), "rep", "left").join(of("hub"), "hub", "left")
    apart = F.coalesce("rep_c", "rep") != F.coalesce("hub_c", "hub")
    now = scratch(now.select("hub", "rep", apart.alias("apart")), "apart")
    open_ = now.filter("apart").select("hub").distinct()
    blocks = _blocks(now.join(open_, "hub", "left_semi"), sets, block)
    more = scratch(blocks.groupBy("hub", "i", "j").applyInPandas(_compare(percent), "a long, b long"), "links")
    first, label = label, scratch(components(links.unionByName(more)), "components")
    found = classes.select("k1", "k2", "n_shingles", "rep", "members").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = scratch(found.select("k1", "k2", "n_shingles", "members", F.coalesce("component", "rep").alias("component_id")), "found")
    drop_scratch(classes, shared, members, involved, sets, links, first, now, more, label)
    known_ids.drop()
    out = join_groups(rows_.select("doc_id", "n_shingles", "k1", "k2"), found, ["k1", "k2", "n_shingles"], "members", rows_.count())
    # Without shingles or without an id a row stands alone.
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicates, all columns. Rows with a null id, a null text or
    no words stay; rows repeated with one id stay or go together. An empty table stays empty."""
    with only("lost") as keep:
        lost = keep(near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_lost")).distinct())
    gone = Bloom(lost.select(F.col("_lost").alias("key")), lost.count())
    # Packed, so columns of any name are safe.
    packed, key = docs.select(F.struct("*").alias("_row")), F.col("_row.doc_id").cast("long")
    stays = gone.matches(packed, key).join(lost, key == F.col("_lost"), "left_anti")
    return gone.others(packed, key).unionByName(stays).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
