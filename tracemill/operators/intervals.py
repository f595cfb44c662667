"""Trees of any size as intervals: nothing gathers a tree, a path or a subtree into one row or task.

A walk around a tree enters and leaves each node once. Its 2n events are a linked list (into the first child or out again; on
to the next child or out of the parent), and each event's distance to the end of the walk comes from pointer doubling:
in each round every event that has not reached the end adds the distance of the one it points to and takes over its pointer, so the
rounds are the logarithm of the tree's size, whatever its shape. ``entry`` and ``exit`` are these distances with their sign
changed: a node is above another if its interval holds the other's, a subtree is a range, its size half the range.

Sums over subtrees are differences of running sums along the walk. The number of distinct values in a subtree is such a sum too:
one for each node, less one at the lowest common ancestor of each two nodes in a row with the same value. Paths to the root are
folded by doubling as well: no row per node and level is made.

Where rows follow one another (children of one parent, nodes of one value, the walk), they are dealt into buckets of ``ROWS``
neighbouring numbers, and only one row per bucket meets those of the other buckets. Input is ``node(tree_id, nid, pid, ...)`` with whole numbers
as nid, unique in a tree; the root has a null pid. Each round writes a table in the shared folder, so calls run jobs. An empty
table gives an empty result; nodes that no root is above are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise

ROWS = 1 << 16


def previous(df: DataFrame, keys: list[str], order: Column, value: Column, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_before``: the value of the row before in the order of a whole number, among rows of equal keys. Values aren't null."""
    own = df.withColumns({"_order": order, "_bucket": F.floor(order / rows), "_value": value})
    inside = F.lag("_value").over(W.partitionBy(*keys, "_bucket").orderBy("_order"))
    last = own.groupBy(*keys, "_bucket").agg(F.max_by("_value", "_order").alias("_last"))
    across = last.select(*keys, "_bucket", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_across"))
    joined = own.withColumn("_inside", inside).join(across.filter("_across is not null"), [*keys, "_bucket"], "left")
    return joined.withColumn("_before", F.coalesce("_inside", "_across")).drop("_order", "_bucket", "_value", "_inside", "_across")


def running_sum(df: DataFrame, keys: list[str], order: Column, value: Column, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_sum``: the sum of the values up to and with this row, in the order of a whole number."""
    own = df.withColumns({"_order": order, "_bucket": F.floor(order / rows), "_value": value})
    inside = F.sum("_value").over(W.partitionBy(*keys, "_bucket").orderBy("_order"))
    totals = own.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    joined = own.withColumn("_inside", inside).join(totals.select(*keys, "_bucket", before.alias("_across")), [*keys, "_bucket"])
    return joined.withColumn("_sum", F.col("_inside") + F.coalesce("_across", F.lit(0))).drop("_order", "_bucket", "_value", "_inside", "_across")


def doubled(links: DataFrame, at: str, step: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``links`` (tree_id, ``at``, next, values) with all values folded up to the end of the links.

    ``step`` gives for each value a function of the own one and that of the row ahead (null if no row is there)."""
    state, before = materialise(links, "links"), None
    # Some row comes to the end in each round, but for those whose links run in a circle.
    while (left := state.filter("next is not null").count()) not in (0, before):
        before = left
        ahead = state.select("tree_id", F.col(at).alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in step])
        going = state.filter("next is not null").join(ahead, ["tree_id", "next"], "left")
        moved = going.select("tree_id", at, F.col("_next").alias("next"), *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in step.items()])
        # Rows at the end stay where they are: only the others are joined.
        new = materialise(state.filter("next is null").unionByName(moved), "links")
        discard(state)
        state = new
    return state.filter("next is null")


def intervals(node: DataFrame, rows: int = ROWS) -> DataFrame:
    """(tree_id, nid, entry, exit) of each node below a root, children in the order of their numbers."""
    own = materialise(node.select("tree_id", F.col("nid").cast("long").alias("nid"), F.col("pid").cast("long").alias("pid")), "tree")
    kids = own.filter("pid is not null")
    first = kids.groupBy("tree_id", F.col("pid").alias("nid")).agg(F.min("nid").alias("first"))
    into = own.join(first, ["tree_id", "nid"], "left").select("tree_id", (F.col("nid") * 2).alias("event"), F.coalesce(F.col("first") * 2, F.col("nid") * 2 + 1).alias("next"))
    # In falling order, the row before is the next sibling.
    out = previous(kids, ["tree_id", "pid"], -F.col("nid"), F.col("nid"), rows).select(
        "tree_id", (F.col("nid") * 2 + 1).alias("event"), F.coalesce(F.col("_before") * 2, F.col("pid") * 2 + 1).alias("next")
    )
    end = own.filter("pid is null").select("tree_id", (F.col("nid") * 2 + 1).alias("event"), F.lit(None).cast("long").alias("next"))
    links = into.unionByName(out).unionByName(end).withColumn("far", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long"))
    # Links that end nowhere lose their distance: no root is above them.
    ranked = doubled(links, "event", {"far": lambda mine, ahead: mine + ahead})
    place = lambda odd: F.max(F.when(F.pmod("event", F.lit(2)) == odd, -F.col("far")))
    out = ranked.filter("far is not null").groupBy("tree_id", F.floor(F.col("event") / 2).alias("nid")).agg(place(0).alias("entry"), place(1).alias("exit"))
    out = materialise(out, "intervals")
    discard(own, ranked)
    return out


def above(upper: str, lower: str) -> Column:
    """Whether the node of one interval (columns ``<name>.entry`` and ``.exit``) is that of another or above it."""
    return (F.col(f"{upper}.entry") <= F.col(f"{lower}.entry")) & (F.col(f"{lower}.exit") <= F.col(f"{upper}.exit"))


def size() -> Column:
    """Nodes of the subtree of an interval, itself included."""
    return ((F.col("exit") - F.col("entry") + 1) / 2).cast("long")


def subtree_sums(spans: DataFrame, weights: DataFrame, rows: int = ROWS) -> DataFrame:
    """(tree_id, nid, value): sums of weights (tree_id, nid, w) over each subtree of ``spans``."""
    weighted = spans.join(weights.groupBy("tree_id", "nid").agg(F.sum("w").alias("w")), ["tree_id", "nid"], "left")
    w = F.coalesce("w", F.lit(0))
    events = weighted.select(
        "tree_id", "nid", F.explode(F.array(F.struct(F.col("entry").alias("at"), w.alias("w"), F.lit(False).alias("out")), F.struct(F.col("exit").alias("at"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("out")))).alias("e")
    ).select("tree_id", "nid", "e.*")
    summed = running_sum(events, ["tree_id"], F.col("at"), F.col("w"), rows)
    # The running sum on leaving, less what was there before entering.
    signed = F.when(F.col("out"), F.col("_sum")).otherwise(F.col("w") - F.col("_sum"))
    return summed.groupBy("tree_id", "nid").agg(F.sum(signed).alias("value"))


def _jumps(node: DataFrame, spans: DataFrame) -> list[DataFrame]:
    """Tables of (tree_id, nid, up, up_exit): the ancestors 1, 2, 4, ... links up, for the nodes that have one."""
    exits = spans.select("tree_id", F.col("nid").alias("up"), F.col("exit").alias("up_exit"))
    out = [materialise(node.filter("pid is not null").select("tree_id", "nid", F.col("pid").alias("up")).join(exits, ["tree_id", "up"]).select("tree_id", "nid", "up", "up_exit"), "jumps")]
    while out[-1].take(1):
        ahead = out[-1].select("tree_id", F.col("nid").alias("up"), F.col("up").alias("_up"), F.col("up_exit").alias("_exit"))
        out.append(materialise(out[-1].join(ahead, ["tree_id", "up"]).select("tree_id", "nid", F.col("_up").alias("up"), F.col("_exit").alias("up_exit")), "jumps"))
    discard(out.pop())
    return out


def common_ancestors(node: DataFrame, spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, nid): for each pair (tree_id, a, a_exit, b_exit), of nodes entered in this order, its lowest common ancestor.

    From a, the longest jumps that stay below b's end are taken first; the parent of where that ends is the ancestor."""
    jumps = _jumps(node, spans)
    held = F.col("a_exit") >= F.col("b_exit")
    same = pairs.filter(held).select("tree_id", F.col("a").alias("nid"))
    at = materialise(pairs.filter(~held).select("tree_id", F.col("a").alias("nid"), "b_exit"), "climb")
    for table in reversed(jumps):
        far = at.join(table, ["tree_id", "nid"], "left")
        new = materialise(far.select("tree_id", F.when(F.col("up_exit") < F.col("b_exit"), F.col("up")).otherwise(F.col("nid")).alias("nid"), "b_exit"), "climb")
        discard(at)
        at = new
    found = materialise(same.unionByName(at.join(jumps[0], ["tree_id", "nid"]).select("tree_id", F.col("up").alias("nid"))) if jumps else same, "common")
    discard(at, *jumps)
    return found


def diversity(node: DataFrame, trace: str = "trace", rows: int = ROWS) -> DataFrame:
    """(tree_id, nid, value): distinct traces in the subtree, the node's own included; null traces don't count."""
    spans = intervals(node, rows)
    own = node.select("tree_id", F.col("nid").cast("long").alias("nid"), F.col("pid").cast("long").alias("pid"), F.col(trace).alias("_t"))
    valued = own.filter("_t is not null").join(spans, ["tree_id", "nid"])
    rows_ = previous(valued, ["tree_id", "_t"], F.col("entry"), F.struct("nid", "exit"), rows)
    pairs = rows_.filter("_before is not null").select("tree_id", F.col("_before.nid").alias("a"), F.col("_before.exit").alias("a_exit"), F.col("exit").alias("b_exit"))
    common = common_ancestors(own, spans, pairs)
    weights = valued.select("tree_id", "nid", F.lit(1).cast("long").alias("w")).unionByName(common.select("tree_id", "nid", F.lit(-1).cast("long").alias("w")))
    return subtree_sums(spans, weights, rows)


def path_min(node: DataFrame, value: str = "v") -> DataFrame:
    """(tree_id, nid, value): smallest value on the path without the root; the root has null."""
    mine = F.when(F.col("pid").isNotNull(), F.col(value))
    links = node.select("tree_id", F.col("nid").cast("long").alias("nid"), F.col("pid").cast("long").alias("next"), mine.alias("value"))
    return doubled(links, "nid", {"value": lambda own, ahead: F.least(own, ahead)}).select("tree_id", "nid", "value")


def depths(node: DataFrame) -> DataFrame:
    """(tree_id, nid, depth): links up to the root, for tables that don't hold it."""
    far = F.when(F.col("pid").isNotNull(), 1).otherwise(0).cast("long")
    links = node.select("tree_id", F.col("nid").cast("long").alias("nid"), F.col("pid").cast("long").alias("next"), far.alias("depth"))
    return doubled(links, "nid", {"depth": lambda own, ahead: own + ahead}).filter("depth is not null").select("tree_id", "nid", "depth")
