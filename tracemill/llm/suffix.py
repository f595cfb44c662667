"""Removal of repeated long byte strings by a distributed, sampled suffix sort.

A byte goes when some ``length``-byte string (default 100) that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one. Sorting every suffix would move
``length`` bytes per byte of text, so the suffixes are sampled by content: of the ``gram``-byte grams
inside a string the one with the least hash is its anchor. Equal strings have equal anchors at equal
places, so it is enough to compare the strings of each anchor, and strings of one anchor overlap.

1. Anchors. The suffix at each anchor is sorted by its first eight bytes, then by three words that stand
   for the rest: a hash of its gram and 128 bits of XXH3 of the whole run of strings that have this anchor, then
   by its place. Sampled splitters range-partition the anchors by this key, leading bytes first. Each bucket is sorted by
   multikey quicksort on the words; it shows for each run whether the same run stands earlier (then
   all its strings are repeats) and whether other runs share its gram. The last row of a bucket is
   compared with the first of the next, so a gram that a third of all documents have fills many buckets
   and not one.
2. Chunks. First runs that share a gram with others are split into chunks of ``CHUNK`` neighbouring
   strings, sorted the same way by the bytes common to the chunk's strings.
3. Strings. What still shares its core with others is sorted as suffixes of ``length`` bytes in full:
   splitters sampled by Spark range-partition them, each bucket is sorted by multikey quicksort on
   8-byte words, equal neighbours are repeats, again across the borders of buckets.

Only steps 2 and 3 read bytes again, for first runs alone. That two runs are the same is told by 128 bits of
a hash that no structure of a text makes collide, that two strings are by their bytes; the hash of a gram only tells what is worth a
closer look.

Buckets are made for ``BUCKET_ROWS`` rows, and a task holds one at a time. Splitters, their sample and the borders
grow with the number of buckets, so there are at most ``MAX_BUCKETS`` at once: larger inputs are first
written by ranges of leading bytes, cut between grams, that are done one after the other.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing; matches never cross
documents. Rows repeated with one id and text are the same place and get the same result. Rows
with a null id are neither compared nor cut. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .bloom import Bloom
from .common import drop_scratch, only, scratch, text_of
from .hashing import mix, prefix, slices
from .sampling import hashed_part

CHUNK = 4
BUCKET_ROWS = 200_000  # rows a bucket is made for; one bucket at a time is sorted in memory
MAX_BUCKETS = 32_768  # at once
BUCKET_STRINGS = 100_000
BATCH = 1 << 18  # bytes of text worked on at once


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first of equals) in each window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place, span = values, np.arange(len(values)), 1
    while span * 2 <= width:
        later = best[span:] < best[:-span]
        place = np.where(later, place[span:], place[:-span])
        best = np.where(later, best[span:], best[:-span])
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(b < a, place[width - span : width - span + n], place[:n])


def digests(data: bytes, start: np.ndarray, stop: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """128 bits of XXH3 of data[start:stop] and two small numbers, as rows of two int64."""
    slices_ = map(data.__getitem__, map(slice, start.tolist(), stop.tolist()))
    seeds = (near.astype(np.int64) << 20 | far.astype(np.int64)).tolist()
    return np.frombuffer(b"".join(map(xxh3_128_digest, slices_, seeds)), ">i8").reshape(-1, 2).astype(np.int64)


def leading(data: bytes, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as int64 in the order of the bytes; zeros behind the end."""
    words = np.ndarray(len(data), ">u8", data + bytes(7), strides=(1,))
    return (words[at].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def runs(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors' runs of strings: text number, start of the first string, how many, anchor minus
    start, the leading bytes of the anchor, and the hashes of the gram and the run."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    if len(data) < length:
        return {c: np.zeros(0, np.int64) for c in ("text", "start", "many", "lead", "head", "gram", "one", "two")}
    ends = np.cumsum(sizes)
    at = np.arange(len(data) - gram + 1)
    hashes = mix(slices(prefix(data), at, at + gram))
    anchor = least(hashes, length - gram + 1)
    string = np.arange(len(anchor))
    text = np.searchsorted(ends, string, side="right")
    inside = string + length <= ends[text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stops = np.flatnonzero(np.concatenate([~inside | new, [True]]))
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    lead, many = anchor[first] - first, last - first + 1
    whole = digests(joined, first, last + length, lead, many)
    return {
        "text": text[first],
        "start": first - (ends - sizes)[text[first]],
        "many": many,
        "lead": lead,
        "head": leading(joined, anchor[first]),
        "gram": hashes[anchor[first]].view(np.int64),
        "one": whole[:, 0],
        "two": whole[:, 1],
    }


def _batches(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
    ids = b["doc_id"].to_numpy(np.int64)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < BATCH):
            size += len(texts[stop])
            stop += 1
        yield ids[start:stop], texts[start:stop]
        start = stop


#: Leading bytes, hash of the gram, hash of the run, place.
WORDS = ["head", "gram", "one", "two"]
KEY = [*WORDS, "doc_id", "start"]
RUN = ", ".join(f"{c} long" for c in KEY[:5]) + ", start int, many int, lead int"
#: Columns of packed rows: their bytes follow one another in a blob.
PACKED = [*((c, "<i8") for c in KEY[:5]), ("start", "<i4"), ("many", "<u2"), ("lead", "<i4")]
ROW_BYTES = 50


def pack_rows(rows: dict[str, np.ndarray], bucket: np.ndarray) -> pd.DataFrame:
    """One blob for each bucket: Spark moves a few blobs where it would move thousands of rows."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    numbers, blobs = [], []
    for at in np.split(order, cuts) if len(order) else []:
        numbers.append(int(bucket[at[0]]))
        blobs.append(b"".join(rows[c][at].astype(t).tobytes() for c, t in PACKED))
    return pd.DataFrame({"bucket": pd.Series(numbers, dtype="int32"), "rows": pd.Series(blobs, dtype=object)})


def unpack_rows(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in PACKED}
    for blob in blobs:
        n, at = len(blob) // ROW_BYTES, 0
        for c, t in PACKED:
            parts[c].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(x) for c, x in parts.items()}


def _runs(length: int, gram: int, splitters: np.ndarray | None):
    """The runs of documents: as rows, or packed by bucket when there are splitters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, texts in _batches(b):
                r = runs(texts, length, gram)
                yield _given({**{c: r[c] for c in WORDS}, "doc_id": ids[r["text"]], "start": r["start"], "many": r["many"], "lead": r["lead"]}, splitters)

    return run


def _given(rows: dict[str, np.ndarray], splitters: np.ndarray | None) -> pd.DataFrame:
    if splitters is not None:
        return pack_rows(rows, bucket_of(rows, splitters))
    return pd.DataFrame(rows).astype({c: np.int32 for c in ("start", "many", "lead")})


def bucket_of(rows: dict[str, np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters are at or below the row's key; splitters may have less columns than the key."""
    out = np.zeros(len(rows["head"]), np.int32)
    todo = [(np.arange(len(out)), 0, len(splitters), 0)]
    while todo:
        at, lo, hi, column = todo.pop()
        values, cut = rows[KEY[column]][at], splitters[lo:hi, column]
        low, high = lo + np.searchsorted(cut, values, side="left"), lo + np.searchsorted(cut, values, side="right")
        out[at] = high
        if column + 1 < splitters.shape[1]:
            # Ties with splitters are told by the next column.
            tied = np.flatnonzero(low < high)
            order = tied[np.argsort(low[tied], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(low[order])) + 1) if len(order) else []:
                todo.append((at[part], int(low[part[0]]), int(high[part[0]]), column + 1))
    return out


def _quantiles(rows: DataFrame, columns: list[str], parts: int, total: int, per_part: int = 20) -> np.ndarray:
    """Splitters into ``parts`` by a sample of ``per_part`` rows for each."""
    got = hashed_part(rows.select(*columns), columns, parts * per_part, total).toPandas()
    keys = got.to_numpy(np.int64).reshape(-1, len(columns))
    keys = keys[np.lexsort(keys.T[::-1])]
    step = max(1, len(keys) // parts)
    return keys[step::step][: parts - 1]


def _rebucket(splitters: np.ndarray | None):
    """Packed rows of a range as rows, or packed by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["rows"]:
                yield _given(unpack_rows([blob]), splitters)

    return run


PACKED_SCHEMA = "bucket int, rows binary"


def distinct_runs(source: DataFrame, some: DataFrame, share: int, make, least_buckets: int) -> DataFrame:
    """:func:`first_runs` of the rows that ``make(splitters)`` finds in ``source``; ``some`` is one in ``share`` of it."""
    sample = scratch(some.mapInPandas(make(None), RUN), "sample")
    held = sample.count()
    buckets = max(least_buckets, held * share // BUCKET_ROWS)
    if buckets <= MAX_BUCKETS:
        out = first_runs(source.mapInPandas(make(_quantiles(sample, KEY, buckets, held)), PACKED_SCHEMA), buckets)
        drop_scratch(sample)
        return out
    # Cut between grams, so that nothing is compared across ranges.
    ranges = 2 * -(-buckets // MAX_BUCKETS)
    cuts = np.unique(_quantiles(sample, ["head", "gram"], ranges, held), axis=0)
    parts = scratch(source.mapInPandas(make(cuts), PACKED_SCHEMA), "ranges", by="bucket")
    out = None
    for r in range(len(cuts) + 1):
        part = parts.filter(F.col("bucket") == r)
        rows = part.agg(F.sum(F.octet_length("rows"))).first()[0] or 0
        n = max(1, rows // ROW_BYTES // BUCKET_ROWS)
        few = part.mapInPandas(_rebucket(None), RUN)
        found = first_runs(part.mapInPandas(_rebucket(_quantiles(few, KEY, n, max(1, rows // ROW_BYTES))), PACKED_SCHEMA), n)
        out = found if out is None else out.unionByName(found)
    drop_scratch(sample)
    return out


FLAGGED = RUN + ", repeat boolean, shared boolean, open boolean, edge int, bucket int"


def flag_bucket(rows: dict[str, np.ndarray], bucket: int) -> pd.DataFrame:
    """Sorts a bucket by key and gives the rows that repeat an earlier place of their run or are first
    runs sharing their gram. ``open`` marks the few that other buckets decide: the first place of the bucket's first run,
    and the first or last gram's run if it is the only one. ``edge`` 1 marks the bucket's first row and 2 its last."""
    by_place = np.lexsort([rows["start"], rows["doc_id"]])
    words = np.stack([rows[c].view(np.uint64) for c in WORDS], axis=1)
    words[:, 0] ^= np.uint64(1 << 63)
    order = multikey_quicksort(words, by_place, small=256)
    rows = {c: v[order] for c, v in rows.items()}
    head, gram, one, two, doc, start = (rows[c] for c in KEY)
    n = len(head)
    new_gram, new_run, new_place = np.ones(n, bool), np.ones(n, bool), np.ones(n, bool)
    new_gram[1:] = (head[1:] != head[:-1]) | (gram[1:] != gram[:-1])
    new_run[1:] = new_gram[1:] | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    new_place[1:] = new_run[1:] | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    group, run_no, place = np.cumsum(new_gram) - 1, np.cumsum(new_run) - 1, np.cumsum(new_place)
    repeat = place != place[np.flatnonzero(new_run)][run_no]
    shared = (np.bincount(group, new_run) > 1)[group]
    open_ = ~repeat & ((run_no == 0) | (~shared & ((group == 0) | (group == group[-1]))))
    edge = np.zeros(n, np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    keep = repeat | shared | open_ | (edge > 0)
    out = pd.DataFrame({c: v[keep].astype(np.int64 if v.dtype.itemsize == 8 else np.int32) for c, v in rows.items()})
    return out.assign(repeat=repeat[keep], shared=shared[keep], open=open_[keep], edge=edge[keep], bucket=np.int32(bucket))


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets come one after the other; one at a time is held."""

    def close(number: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        flagged = flag_bucket(unpack_rows(blobs), number)
        for at in range(0, len(flagged), 100_000):
            yield flagged.iloc[at : at + 100_000]

    now, held = -1, []
    for b in batches:
        for number, blob in zip(b["bucket"], b["rows"], strict=True):
            if number != now:
                if held:
                    yield from close(now, held)
                now, held = int(number), []
            held.append(blob)
    if held:
        yield from close(now, held)


def _neighbours(edges: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of each bucket with the last one of the bucket before (``b_`` columns): two rows for each
    of at most MAX_BUCKETS buckets, so their order is found in one task."""
    by = W.orderBy("bucket")
    first = edges.filter(F.col("edge").bitwiseAND(1) > 0).select("bucket", *columns, F.row_number().over(by).alias("k"))
    last = edges.filter(F.col("edge").bitwiseAND(2) > 0).select(*[F.col(c).alias(f"b_{c}") for c in columns], (F.row_number().over(by) + 1).alias("k"))
    return first.join(last, "k").drop("k")


def first_runs(packed: DataFrame, buckets: int) -> DataFrame:
    """Runs (packed by bucket) that repeat an earlier one, or are first but share their gram
    (repeat false); resolved across the borders of buckets."""
    flagged = scratch(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(_flag, FLAGGED), "flagged")
    edges = flagged.filter("edge > 0")
    borders = scratch(_neighbours(edges, KEY), "borders")
    same = lambda cs: reduce(and_, [F.col(c) == F.col(f"b_{c}") for c in cs])
    # The run goes on in this bucket: what stands here repeats it, unless it is that very place (a repeated row).
    again = borders.filter(same(WORDS) & ~same(["doc_id", "start"])).select("bucket", *WORDS, F.lit(True).alias("again"))
    more = borders.filter(same(WORDS[:2]) & ~same(WORDS[2:])).select(*WORDS[:2]).unionByName(edges.filter("shared").select(*WORDS[:2])).distinct()
    # At most two rows for each bucket meet the few open ones.
    outer = flagged.filter("open").join(F.broadcast(again), ["bucket", *WORDS], "left").join(F.broadcast(more.withColumn("more", F.lit(True))), WORDS[:2], "left")
    repeat, shared = F.col("repeat") | F.coalesce("again", F.lit(False)), F.col("shared") | F.coalesce("more", F.lit(False))
    names = ["doc_id", "start", "many", "lead"]
    outer = outer.select(*names, repeat.alias("repeat"), shared.alias("shared")).filter("repeat or shared")
    return flagged.filter("not open and (repeat or shared)").select(*names, "repeat", "shared").unionByName(outer)


def _bytes_of(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, wanted in zip(b["doc_id"], b["text"], b["runs"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for r in wanted:
                    s, n = r["start"], r["many"]
                    out.append((doc, s, n, r["lead"], data[s : s + n - 1 + length]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "many", "lead", "bytes"])

    return run


def _chunks(length: int, splitters: np.ndarray | None):
    """Chunks of the runs: strings whose distance to the anchor has the same quotient by CHUNK.
    ``lead`` is the start of the run they are from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lead, many = b["lead"].to_numpy(np.int64), b["many"].to_numpy(np.int64)
            size = np.array([len(x) for x in b["bytes"]], np.int64)
            base = np.cumsum(size) - size
            joined = b"".join(b["bytes"])
            run_ = prefix(np.frombuffer(joined, np.uint8))
            # Distances of a run: lead (its first string) down to lead - many + 1.
            top, low = lead // CHUNK, (lead - many + 1) // CHUNK
            n = top - low + 1
            row = np.repeat(np.arange(len(b)), n)
            c = top[row] - (np.arange(len(row)) - (np.cumsum(n) - n)[row])
            far, near = np.minimum(lead[row], c * CHUNK + CHUNK - 1), np.maximum(lead[row] - many[row] + 1, c * CHUNK)
            anchor = base[row] + lead[row]
            core = slices(run_, anchor - c * CHUNK, anchor - (c * CHUNK + CHUNK - 1) + length)
            whole = digests(joined, anchor - far, anchor - near + length, far, near)
            yield _given({
                "head": leading(joined, anchor - c * CHUNK),
                "gram": mix(core + c.astype(np.uint64)).view(np.int64),
                "one": whole[:, 0],
                "two": whole[:, 1],
                "doc_id": b["doc_id"].to_numpy(np.int64)[row],
                "start": b["start"].to_numpy(np.int64)[row] + lead[row] - far,
                "many": far - near + 1,
                "lead": b["start"].to_numpy(np.int64)[row],
            }, splitters)

    return run


def multikey_quicksort(words: np.ndarray, rows: np.ndarray, depth: int = 0, small: int = 32) -> np.ndarray:
    """``rows`` in the order of their word sequences; equal sequences keep their order."""
    stack, out = [(rows, depth)], []
    while stack:
        part, d = stack.pop()
        if len(part) < 2 or d == words.shape[1]:
            out.append(part)
            continue
        w = words[part, d]
        if len(part) <= small:
            out.append(part[np.lexsort(words[part][:, ::-1].T)])
            continue
        pivot = np.partition(w, len(w) // 2)[len(w) // 2]
        # Three ways; only equals move on to the next word. Last pushed comes out first.
        stack.append((part[w > pivot], d))
        stack.append((part[w == pivot], d + 1))
        stack.append((part[w < pivot], d))
    return np.concatenate(out) if out else rows


STRING = "doc_id long, start int, repeat boolean, edge int, bucket int, bytes binary"


def _sorted_repeats(length: int):
    """Repeats in a bucket of strings; ``edge`` 1 and 2 mark its first and last string with bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        b = pd.concat(parts, ignore_index=True)
        b = b.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        wide = -(-length // 8) * 8
        raw = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in b["bytes"]), ">u8").reshape(len(b), wide // 8).astype(np.uint64)
        order = multikey_quicksort(raw, np.arange(len(b)))
        raw = raw[order]
        b = b.iloc[order].reset_index(drop=True)
        same = np.zeros(len(b), bool)
        same[1:] = (raw[1:] == raw[:-1]).all(axis=1)
        doc, start = b["doc_id"].to_numpy(), b["start"].to_numpy()
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        repeat = same & ((doc != doc[head]) | (start != start[head]))
        edge = np.zeros(len(b), np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        out = pd.DataFrame({"doc_id": doc, "start": start, "repeat": repeat, "edge": edge, "bucket": np.int32(TaskContext.get().partitionId()), "bytes": None})
        # The strings equal to the first may all turn out to be repeats; only the first can change.
        out.loc[edge > 0, "bytes"] = b["bytes"][edge > 0]
        yield out[repeat | (edge > 0)]

    return run


def _repeated_strings(strings: DataFrame, length: int, least_buckets: int) -> DataFrame:
    """(doc_id, start) of the strings (doc_id, start, bytes) that also stand earlier."""
    buckets = min(MAX_BUCKETS, max(least_buckets, strings.count() // BUCKET_STRINGS))
    ranged = strings.repartitionByRange(buckets, "bytes", "doc_id", "start")
    found = scratch(ranged.mapInPandas(_sorted_repeats(length), STRING), "strings")
    borders = _neighbours(found.filter("edge > 0"), ["bytes", "doc_id", "start"])
    place = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("start") == F.col("b_start"))
    extra = borders.filter((F.col("bytes") == F.col("b_bytes")) & ~place).select("doc_id", "start")
    return found.filter("repeat").select("doc_id", "start").unionByName(extra)


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, spans (array of start, stop in bytes, unordered and overlapping) of ``docs``
    (doc_id not null, text)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    # A sample of documents, a bounded number for each bucket, places the splitters.
    share = max(1, rows // (20 * buckets))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    anchors = distinct_runs(docs, some, share, lambda splitters: _runs(length, gram, splitters), buckets)

    place = F.struct("start", "many", "lead")
    wanted = anchors.filter("not repeat").groupBy("doc_id").agg(F.collect_list(place).alias("runs"))
    wanted = scratch(wanted, "wanted")
    holders = Bloom(wanted.select(F.col("doc_id").alias("key")), wanted.count())
    texts = holders.matches(docs, F.col("doc_id")).join(wanted, "doc_id")
    data = scratch(texts.mapInPandas(_bytes_of(length), "doc_id long, start int, many int, lead int, bytes binary"), "runs")

    share = max(1, data.count() // (20 * buckets))
    some = data.filter(F.pmod(F.xxhash64("doc_id", "start"), F.lit(share)) == 0)
    chunks = distinct_runs(data, some, share, lambda splitters: _chunks(length, splitters), buckets)
    open_ = chunks.filter("not repeat").select("doc_id", F.col("lead").alias("run"), "start", "many")
    strings = open_.join(data.select("doc_id", F.col("start").alias("run"), "bytes").distinct(), ["doc_id", "run"])
    strings = strings.select("doc_id", "run", F.explode(F.expr("sequence(start, start + many - 1)")).alias("start"), "bytes")
    strings = scratch(strings.select("doc_id", "start", F.expr(f"substring(bytes, start - run + 1, {length})").alias("bytes")), "windows")
    single = _repeated_strings(strings, length, buckets)

    span = lambda df, many: df.select("doc_id", "start", (F.col("start") + many - 1 + length).alias("stop"))
    spans = (
        span(anchors.filter("repeat"), F.col("many"))
        .unionByName(span(chunks.filter("repeat"), F.col("many")))
        .unionByName(span(single, F.lit(1)))
    )
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def union_of(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["stop"]) for r in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_out(text: str, spans) -> tuple[bytes, list[tuple[int, int]], int]:
    data = text.encode("utf-8", "surrogatepass")
    gone = union_of(spans) if spans is not None else []
    at, kept = 0, []
    for s, e in gone:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return b"".join(kept), gone, len(data)


def _with_spans(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with only("spans") as keep:
        spans = keep(repeated_spans(source.filter("doc_id is not null"), length, gram))
    return _join_spans(source, spans, F.col("doc_id"))


def _join_spans(docs: DataFrame, spans: DataFrame, key: Column) -> DataFrame:
    """``docs`` and their spans (null without any); only documents that may have spans are moved."""
    cut = Bloom(spans.select(F.col("doc_id").alias("key")), spans.count())
    spans = spans.withColumnRenamed("doc_id", "_id")
    found = cut.matches(docs, key).join(spans, key == F.col("_id"), "left").drop("_id")
    return cut.others(docs, key).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).unionByName(found)


def removals(docs: DataFrame, length: int = 100, gram: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                kept, gone, n = cut_out(text, spans)
                out.append((n, n - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            part = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            part.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield part

    return _with_spans(docs, length, gram, id_col, text_col).mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100, gram: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes cut from text (characters cut through go whole); n_chars follows."""
    with only("spans") as keep:
        spans = keep(repeated_spans(docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).filter("doc_id is not null"), length, gram))

    @F.pandas_udf("string")
    def keep(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([cut_out(t, s)[0].decode("utf-8", "ignore") for t, s in zip(text, found, strict=True)])

    # Packed, so columns of any name are safe.
    packed = docs.select(F.struct("*").alias("_row"))
    cut = _join_spans(packed, spans, F.col("_row.doc_id").cast("long"))
    text = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(keep(text_of("_row.text"), F.col("spans")))
    cut = cut.select("_row", text.alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text_of("_text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
