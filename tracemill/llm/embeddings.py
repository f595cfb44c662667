"""Near-duplicate vectors: exact lists for dense areas, a pivot-permutation index for the rest.

Dense areas. A bounded sample (about ``sample`` distinct vectors) is grouped around leaders: a vector
within a cosine of ``dense`` of a leader belongs to it, any other becomes a leader. The mean directions of
groups of ``near`` or more are centres, each with a reach: the largest angle between it and a vector of the sample
within ``dense`` of it. The home of a vector is its nearest centre, if within its reach. With t the angle of the threshold, a
partner whose own home is not nearer lies within t of the reach, and within d + t if d is its angle to its own home, so each vector
also visits the centres within the smaller of these. Every list of a centre is verified in
full, those at home against all, so no link of a vector with a home is missed.
A centre is kept only if, in the sample, at least ``linked`` of the pairs that its list would verify are links. So the work on
lists follows the links that there are: vectors that merely share a direction, as text embeddings often do, get no
centres at all, however near one another they lie, and go to the index of pivots with the rest.

The rest, vectors without a home. Pivots are vectors of the sample that have no home; there are fewer
than ``near`` of them in a group that is not dense, so they do not crowd one another out. Each vector is
described by its ``near`` or more nearest pivots in order, and stands in the inverted lists of those.
Vectors of one list that share at least ``shared`` pivots are candidates: the list is split by the other pivots
its vectors have, and only vectors that share one of those are multiplied and verified by their
cosine in double precision. A pair met in several lists counts in the list of its smallest shared
pivot alone. There are ``4 * sqrt(n)`` pivots (64 at least), so lists grow
with the square root of the input. Links between two vectors of the rest can be missed; how many is measured on the sample before
the index is made, and ``near`` is raised step by step until ``recall`` of the sample's own links are found (of partners made at the
threshold, where the sample has fewer than 100).

Lists over ``block`` vectors are dealt out as pairs of blocks. A task gives each vector's number of links
and its root within the task, never the pairs themselves, so its output is as long as its input.

Equal vectors are one class, stood for by its smallest id; links count all members.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (component_id is their own id). Vectors of different length never link. Repeated rows with one id are separate
vectors. Rows with a null id count as partners of others but their component_id is that of their
class. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch
from .graph import components, join_groups, local_roots
from .sampling import hashed_part


def unit(vectors) -> np.ndarray:
    x = np.vstack([np.asarray(v, np.float64) for v in vectors])
    # Scaled by the largest part first, so squares neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots: evenly spaced rows of the sample, which is in the order of a hash."""
    return x[np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(int))]


def _groups(x: np.ndarray, dense: float, least: int) -> np.ndarray:
    """Mean directions of the groups of ``least`` or more rows within ``dense`` of a leader."""
    leaders, sums, many = np.zeros_like(x), np.zeros_like(x), np.zeros(len(x), np.int64)
    n = 0
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        best, at = np.full(len(part), -2.0), np.zeros(len(part), np.int64)
        if n:
            close = part @ leaders[:n].T
            at = close.argmax(axis=1)
            best = close[np.arange(len(part)), at]
        inside = part @ part.T
        for i in range(len(part)):
            if best[i] < dense:
                leaders[n], best[i], at[i] = part[i], 1.0, n
                later = np.arange(i + 1, len(part))
                nearer = later[inside[i, later] > best[later]]
                best[nearer], at[nearer] = inside[i, nearer], n
                n += 1
        np.add.at(sums, at, part)
        many += np.bincount(at, minlength=len(x))
    c = sums[many >= least]
    return c / np.sqrt((c * c).sum(axis=1, keepdims=True))


class Centres:
    """Directions of dense areas and how far each reaches."""

    def __init__(self, directions: np.ndarray, angles: np.ndarray):
        self.directions, self.angles = directions, angles

    def place(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: its home (-1 for none), the cosine to it, and the centres it is listed at; ``reach`` is the angle of the threshold."""
        if not len(self.directions):
            return np.full(len(x), -1), np.full(len(x), -2.0), np.zeros((len(x), 0), bool)
        close = x @ self.directions.T
        angle = np.arccos(np.clip(close, -1, 1))
        inside = np.where(angle <= self.angles + 1e-9, close, -2.0)
        home = inside.argmax(axis=1)
        best = inside.max(axis=1)
        at = np.arange(len(x))
        own = np.where(best > -2, angle[at, home], math.inf)
        listed = angle <= np.minimum(own[:, None], self.angles[None, :]) + reach
        listed[at[best > -2], home[best > -2]] = True
        return np.where(best > -2, home, -1), best, listed


def centres(x: np.ndarray, threshold: float, dense: float, least: int, linked: float) -> Centres:
    """The centres of a sample whose lists are worth verifying: at least ``linked`` of the pairs are links."""
    reach = _angle(threshold)
    c = _groups(x, dense, least)
    angles = np.zeros(len(c))
    for lo in range(0, len(x), 1024):
        close = np.clip(x[lo : lo + 1024] @ c.T, -1, 1)
        np.maximum(angles, np.where(close >= dense, np.arccos(close), 0).max(axis=0, initial=0), out=angles)
    while True:
        found = Centres(c, angles)
        parts = [found.place(x[lo : lo + 1024], reach) for lo in range(0, len(x), 1024)]
        home = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
        listed = [np.concatenate([lo * 1024 + np.flatnonzero(p[2][:, k]) for lo, p in enumerate(parts)]) for k in range(len(c))]
        keep = np.zeros(len(c), bool)
        for k, rows in enumerate(listed):
            own = np.flatnonzero(home == k)
            links = sum(int((x[own[lo : lo + 512]] @ x[rows].T >= threshold).sum()) for lo in range(0, len(own), 512)) - len(own)
            keep[k] = len(own) >= least and links >= linked * len(own) * (len(rows) - 1)
        if keep.all():
            return found
        # Those at home at a centre that goes may have another.
        c, angles = c[keep], angles[keep]


def _nearest(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` nearest pivots of each row, nearest first."""
    k = min(near, len(pivots))
    out = np.zeros((len(x), k), np.int32)
    for lo in range(0, len(x), 1024):
        close = x[lo : lo + 1024] @ pivots.T
        top = np.argpartition(-close, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
        out[lo : lo + 1024] = np.take_along_axis(top, order, 1)
    return out


def enough_pivots(x: np.ndarray, pivots: np.ndarray, threshold: float, near: int, shared: int, recall: float) -> int:
    """How many nearest pivots must describe a vector, ``near`` at least, for the index to find ``recall`` of the links between rows of ``x``."""
    left, right, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lo in range(0, len(x), 1024):
        i, j = np.nonzero((x[lo : lo + 1024] @ x.T >= threshold) & (np.arange(len(x)) > np.arange(lo, min(lo + 1024, len(x)))[:, None]))
        step = max(1, len(i) // 16_384)
        left.append(lo + i[::step])
        right.append(j[::step])
        kept += len(left[-1])
    a, b = x[np.concatenate(left)], x[np.concatenate(right)]
    if kept < 100:
        some = x[:1024]
        aside = np.random.default_rng(0).normal(size=some.shape)
        aside -= (aside * some).sum(axis=1, keepdims=True) * some
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
        cosine = threshold + (1 - threshold) / 8
        a, b = some, cosine * some + math.sqrt(1 - cosine * cosine) * aside
    for k in range(near, 4 * near + 1, max(1, near // 4)):
        both = _nearest(a, pivots, k)[:, :, None] == _nearest(b, pivots, k)[:, None, :]
        if (both.sum(axis=(1, 2)) >= min(shared, len(pivots))).mean() >= recall:
            break
    return k


def _angle(cosine: float) -> float:
    """Of a cosine, with room for rounding."""
    return math.acos(max(-1.0, min(1.0, cosine))) + 1e-6


def _describe(centre: dict[int, Centres], pivots: dict[int, np.ndarray], near: dict[int, int], threshold: float):
    """Adds to each vector ``home`` (-1 - its centre, 0 for none), ``close`` (the cosine to it), ``pivots``
    (of those without a home) and ``lists``: its pivots and, as -1 - number, the centres it visits."""
    reach = _angle(threshold)

    def run(batches):
        for b in batches:
            homes, closes = np.zeros(len(b), np.int32), np.full(len(b), -2.0)
            perms: list = [np.zeros(0, np.int32)] * len(b)
            visits: list = [np.zeros(0, np.int32)] * len(b)
            sizes = b["vector"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                c, p = centre.get(int(size)), pivots.get(int(size))
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    x = unit(b["vector"].iloc[part])
                    if c is not None:
                        home, best, listed = c.place(x, reach)
                        homes[part], closes[part] = np.where(home >= 0, -1 - home, 0), best
                        for i, row in zip(part, listed, strict=True):
                            visits[i] = (-1 - np.flatnonzero(row)).astype(np.int32)
                        part, x = part[home < 0], x[home < 0]
                    if p is None or not len(part):
                        for i in part:
                            perms[i] = np.zeros(1, np.int32)
                        continue
                    for i, row in zip(part, _nearest(x, p, near[int(size)]), strict=True):
                        perms[i] = row
            lists = [np.concatenate(x) for x in zip(perms, visits, strict=True)]
            yield pd.DataFrame({"rep": b["rep"], "members": b["members"], "vector": b["vector"], "size": sizes, "home": homes, "close": closes, "pivots": perms, "lists": lists})

    return run


def _of_centre(x: np.ndarray, at_home: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows at home with all that come after them."""
    rows, cols = [], []
    home = np.flatnonzero(at_home)
    for lo in range(0, len(home), 512):
        part = home[lo : lo + 512]
        r, c = np.nonzero((x[part] @ x.T >= threshold) & (np.arange(len(x))[None, :] > part[:, None]))
        rows.append(part[r])
        cols.append(c)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(rows or none), np.concatenate(cols or none)


def _of_pivot(x: np.ndarray, lists: list[np.ndarray], number: int, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows that share ``shared`` pivots, of which ``number`` is the smallest."""
    owner = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    flat = np.concatenate(lists)
    if min(shared, min(map(len, lists))) < 2:
        parts = [np.arange(len(lists))]  # there is no second pivot to share
    else:
        order = np.argsort(flat, kind="stable")
        cut = np.flatnonzero(np.diff(flat[order])) + 1
        parts = [owner[p] for p in np.split(order, cut) if flat[p[0]] != number and len(p) > 1]
    codes = []
    for part in parts:
        for lo in range(0, len(part), 512):
            r, c = np.nonzero(x[part[lo : lo + 512]] @ x[part].T >= threshold)
            a, b = part[lo + r], part[c]
            codes.append((a * len(x) + b)[a < b])
    i, j = np.divmod(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), len(x))
    # How many pivots, and whether a smaller one, the linked rows share.
    used, place = np.unique(flat, return_inverse=True)
    member = np.zeros((len(lists), len(used)), bool)
    member[owner, place] = True
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        both = member[i[lo : lo + 4096]] & member[j[lo : lo + 4096]]
        enough = both.sum(axis=1) >= min(shared, min(map(len, lists)))
        keep[lo : lo + 4096] = enough & ~both[:, used < number].any(axis=1)
    return i[keep], j[keep]


def _link(threshold: float, shared: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        number, left, right = int(key[1]), int(key[2]), int(key[3])
        # The nearer to its home comes first: a pair counts in the home of the first of the two.
        g = g.sort_values(["close", "rep"], ascending=[False, True], ignore_index=True)
        x = unit(g["vector"])
        at_home = (g["home"] == number).to_numpy()
        block = g["block"].to_numpy()
        if number >= 0:
            i, j = _of_pivot(x, [np.asarray(p) for p in g["pivots"]], number, threshold, shared)
        else:
            i, j = _of_centre(x, at_home, threshold)
        if left != right:
            apart = block[i] != block[j]
            i, j = i[apart], j[apart]
        members = g["members"].to_numpy()
        n = np.bincount(i, members[j], minlength=len(g)) + np.bincount(j, members[i], minlength=len(g))
        root = g["rep"].to_numpy()[local_roots(len(g), i, j)]
        out = pd.DataFrame({"rep": g["rep"], "root": root, "n": n.astype(np.int64)})
        return out[out["n"] > 0]

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    near: int = 8,
    shared: int = 2,
    sample: int = 16_384,
    block: int = 2048,
    dense: float = 0.75,
    linked: float = 0.02,
    recall: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, v).alias("vector"))
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64("vector", F.lit(1)).alias("k2")]
    rows = scratch(rows.select("vec_id", "vector", *keys), "vectors")
    classes = (
        rows.filter("vector is not null")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("members"), F.first("vector").alias("vector"))
        # A class of null ids alone is told by a number no id has.
        .select("k1", "k2", "members", "vector", "first_id", F.coalesce("first_id", F.col("k1")).alias("rep"))
    )
    classes = scratch(classes, "classes")
    total = classes.count()
    n_pivots = int(max(64, 4 * math.sqrt(total)))
    some = hashed_part(classes.select("k1", "vector"), ["k1"], max(sample, 2 * n_pivots), total).toPandas().sort_values("k1")["vector"]
    by_size: dict[int, list] = {}
    for x in some:
        by_size.setdefault(len(x), []).append(x)
    samples = {n: unit(xs) for n, xs in by_size.items()}
    centre = {n: centres(x[:: max(1, len(x) // sample)], threshold, dense, near, linked) for n, x in samples.items()}
    rest = {n: x[centre[n].place(x, _angle(threshold))[0] < 0] for n, x in samples.items()}
    pivots = {n: spread(x, n_pivots) for n, x in rest.items() if len(x)}
    depth = {n: enough_pivots(rest[n][:sample], p, threshold, near, shared, recall) for n, p in pivots.items()}

    described = classes.select("rep", "members", "vector").mapInPandas(
        _describe(centre, pivots, depth, threshold),
        "rep long, members long, vector array<double>, size int, home int, close double, pivots array<int>, lists array<int>",
    )
    described = scratch(described, "described")
    lists = described.select("*", F.explode("lists").alias("list")).drop("lists")
    lists = lists.withColumn("own", (F.col("list") >= 0) | (F.col("list") == F.col("home")))
    # One short row per list: 4 * sqrt(n) and sample / near at most for each vector length.
    blocks_of = lambda which: F.ceil(F.count_if(which) / block).cast("int")
    sizes = lists.groupBy("size", "list").agg(blocks_of(F.col("own")).alias("own_blocks"), blocks_of(~F.col("own")).alias("other_blocks"))
    # Visitors have blocks after those of the vectors at home, and meet only the latter.
    hashed = F.xxhash64("rep")
    placed = lists.join(F.broadcast(sizes), ["size", "list"]).withColumn(
        "block",
        F.when(F.col("own"), F.pmod(hashed, F.col("own_blocks"))).otherwise(F.col("own_blocks") + F.pmod(hashed, F.col("other_blocks"))).cast("int"),
    )
    last = F.col("own_blocks") + F.when(F.col("own"), F.col("other_blocks")).otherwise(0) - 1
    placed = placed.filter("own_blocks > 0").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.select("rep", "members", "vector", "size", "home", "close", "pivots", "list", "block", "other")
    placed = placed.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    links = placed.groupBy("size", "list", "left", "right").applyInPandas(_link(threshold, shared), "rep long, root long, n long")
    links = scratch(links, "links")

    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    found = (
        classes.select("k1", "k2", "members", "rep", "first_id")
        .join(counts, "rep", "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "k1", "k2", "members",
            (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "first_id").alias("component_id"),
        )
    )
    found = scratch(found, "found")
    drop_scratch(classes, described, links)
    out = join_groups(rows.filter("vector is not null").drop("vector"), found, ["k1", "k2"], "members", rows.count())
    out = out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.filter("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return out.unionByName(alone)
