"""Analytics over search trees held as an adjacency table.

``node(tree_id, nid, pid, child_idx, depth, type, step, v, n, sim, completed, ...)``: the root has a
null pid. All joins carry tree_id, so trees spread over tasks and each join is an equi-join. Walks
gather each tree (its node budget bounds it) into one row and fold over its nodes, parents first: one grouping
by tree, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREE = ["tree_id"]


def tree_size(node: DataFrame) -> DataFrame:
    """(tree_id, depth, nodes): deepest level and number of nodes."""
    return node.groupBy("tree_id").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("nodes"))


def leaves(node: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = node.select("tree_id", F.col("pid").alias("nid")).filter("nid is not null").distinct()
    return node.join(parents, ["tree_id", "nid"], "left_anti")


def packed(node: DataFrame, columns: list[str]) -> DataFrame:
    """(tree_id, nodes, up): each tree's structs of nid and ``columns``, parents before children, and
    for each the position of its parent (-1 for roots)."""
    row = F.struct("depth", "nid", "pid", *[F.col(c).alias(f"c_{c}") for c in columns])
    trees = node.groupBy("tree_id").agg(F.array_sort(F.collect_list(row)).alias("nodes"))
    nids = F.col("nodes.nid")
    up = F.transform("nodes", lambda x: F.coalesce(F.array_position(nids, x["pid"]).cast("int") - 1, F.lit(-1)))
    # A value of its own, so what reads it does not compute it anew for each node.
    return trees.select("tree_id", F.explode(F.array(F.struct("nodes", up.alias("up")))).alias("t")).select("tree_id", "t.nodes", "t.up")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` and a column computed once per row."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("_o")).withColumn(name, F.col("_o.v")).drop("_o")


def lineages(node: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`packed` with ``lines``: for each node the positions from the root down to itself."""
    empty = F.array().cast("array<array<int>>")
    add = lambda done, i: F.concat(done, F.array(F.concat(F.coalesce(F.get(done, F.get("up", i)), F.array().cast("array<int>")), F.array(i))))
    return _once(packed(node, columns), "lines", F.aggregate(F.sequence(F.lit(0), F.size("nodes") - 1), empty, add))


def ancestors(node: DataFrame, columns: list[str]) -> DataFrame:
    """(tree_id, nid, anc, up, columns of the ancestor): every node with itself (up 0) and all nodes
    above it."""
    every = lineages(node, columns).select("tree_id", "nodes", F.posexplode("lines").alias("at", "line"))
    pairs = every.select("tree_id", "nodes", "at", F.size("line").alias("_n"), F.posexplode("line").alias("k", "p"))
    above = F.get("nodes", F.col("p"))
    return pairs.select(
        "tree_id", F.get("nodes", F.col("at"))["nid"].alias("nid"), above["nid"].alias("anc"), (F.col("_n") - 1 - F.col("k")).alias("up"), *[above[f"c_{c}"].alias(c) for c in columns]
    )


def paths(node: DataFrame, columns: list[str]) -> DataFrame:
    """(tree_id, nid, path): the root-first array of structs of ``columns`` for each node."""
    every = lineages(node, columns).select("tree_id", "nodes", F.posexplode("lines").alias("at", "line"))
    step = lambda p: F.struct(*[F.get("nodes", p)[f"c_{c}"].alias(c) for c in columns])
    return every.select("tree_id", F.get("nodes", F.col("at"))["nid"].alias("nid"), F.transform("line", step).alias("path"))


def path_min(node: DataFrame) -> DataFrame:
    """(tree_id, nid, value): smallest value on the path without the root; the root has null."""
    values = paths(node, ["v"])
    return values.select("tree_id", "nid", F.array_min(F.slice("path.v", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).alias("value"))


def walked(node: DataFrame, text: str = "step") -> DataFrame:
    """(tree_id, nid, parent_path, first, under_first, value): nodes with equal path texts are one in a walk by
    levels. ``first`` marks a node whose path and all beginnings of it are met for the first time there,
    ``under_first`` a child of such a node; ``value`` is the smallest v of the path without the root."""
    trees = lineages(node, [text, "v"])
    key = lambda line: F.to_json(F.transform(line, lambda p: F.get("nodes", p)[f"c_{text}"]))
    trees = _once(trees, "keys", F.transform("lines", key))
    trees = _once(trees, "own", F.transform("keys", lambda k, i: F.array_position("keys", k).cast("int") - 1 == i))
    trees = _once(trees, "first", F.transform("lines", lambda line: F.forall(line, lambda p: F.get("own", p))))
    every = trees.select("tree_id", "nodes", "up", "keys", "lines", "first", F.posexplode("first").alias("at", "_f"))
    above = F.get("up", F.col("at"))
    line = F.get("lines", F.col("at"))
    low = F.array_min(F.transform(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda p: F.get("nodes", p)["c_v"]))
    return every.select(
        "tree_id", F.get("nodes", F.col("at"))["nid"].alias("nid"), F.get("keys", above).alias("parent_path"), F.col("_f").alias("first"),
        F.coalesce(F.get("first", above), F.lit(False)).alias("under_first"), low.alias("value"),
    )


def diversity(node: DataFrame, trace: str = "trace") -> DataFrame:
    """(tree_id, nid, value): distinct traces in the subtree, the node's own included."""
    every = lineages(node, [trace]).select("tree_id", "nodes", F.posexplode("lines").alias("at", "line"))
    under = every.select("tree_id", F.get("nodes", F.col("at"))[f"c_{trace}"].alias("_t"), F.explode("line").alias("p"), "nodes")
    return under.groupBy("tree_id", F.get("nodes", F.col("p"))["nid"].alias("nid")).agg(F.countDistinct("_t").alias("value"))


def uncertainty(visits: Column, simulations: Column) -> Column:
    """1 / visits (0 unvisited), and the population variance of more than one simulation."""
    n = F.size(simulations)
    mean = F.aggregate(simulations, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    var = F.aggregate(simulations, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(n, F.lit(0)) - mean * mean
    return F.when(visits > 0, 1.0 / visits).otherwise(0.0) + F.when(n > 1, var).otherwise(0.0)


def node_scores(node: DataFrame, alpha: float = 0.5, trace: str = "trace") -> DataFrame:
    """(tree_id, nid, score): alpha * diversity + (1 - alpha) * uncertainty."""
    spread = diversity(node, trace).withColumnRenamed("value", "_d")
    unsure = F.when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(0.0) if "simulations" not in node.columns else uncertainty(F.col("n"), F.col("simulations"))
    return node.join(spread, ["tree_id", "nid"]).select("tree_id", "nid", (F.col("_d") * alpha + unsure * (1 - alpha)).alias("score"))


def inner_nodes(node: DataFrame) -> DataFrame:
    """Nodes with children, without roots."""
    parents = node.select("tree_id", F.col("pid").alias("nid")).filter("nid is not null").distinct()
    return node.filter("pid is not null").join(parents, ["tree_id", "nid"], "left_semi")


def representative(node: DataFrame, alpha: float = 0.5, trace: str = "trace") -> DataFrame:
    """The better-scored half (rounded down) of each tree's inner nodes; each node by its own score."""
    scores = inner_nodes(node).select("tree_id", "nid").join(node_scores(node, alpha, trace), ["tree_id", "nid"])
    by = W.partitionBy("tree_id").orderBy(F.desc("score"), "nid")
    ranked = scores.withColumns({"_k": F.row_number().over(by), "_n": F.count(F.lit(1)).over(W.partitionBy("tree_id"))})
    return ranked.filter(F.col("_k") <= F.floor(F.col("_n") / 2)).drop("_k", "_n")


def intermediate(node: DataFrame) -> DataFrame:
    """Inner nodes, and visited leaves that are not finished."""
    return inner_nodes(node).unionByName(leaves(node).filter((F.col("n") > 0) & (F.col("type") != "Finish")))


def answers(node: DataFrame, correct: bool, path: str = "path") -> DataFrame:
    """Leaves that are correct, or finished and wrong; one of those with equal path text."""
    end = leaves(node)
    end = end.filter("correct") if correct else end.filter(~F.col("correct") & (F.col("type") == "Finish"))
    return end.dropDuplicates(["tree_id", path])


def ucb(value: Column, visits: Column, parent_visits: Column, constant: float, unvisited: float) -> Column:
    return F.when(visits > 0, value + constant * F.sqrt(F.ln(parent_visits) / visits)).otherwise(F.lit(unvisited))


def select_child(node: DataFrame, constant: float = 1.4, unvisited: float = float("inf"), low_gate: float = 0.3) -> DataFrame:
    """(tree_id, nid, child, ucb): the child to walk to from each parent.

    Correct finished children, and completed ones, are never chosen; a finished child under
    ``low_gate`` with refinements left stays open. The first of equals wins."""
    parent = node.select("tree_id", F.col("nid").alias("pid"), F.col("n").alias("_pn"))
    score = ucb(F.col("v"), F.col("n"), F.col("_pn"), constant, unvisited)
    finish = F.col("type") == "Finish"
    refine = finish & (F.col("v") < low_gate) & (F.col("refine_cnt") < F.col("refine_limit"))
    closed = (finish & F.coalesce("correct", F.lit(False))) | (F.coalesce("completed", F.lit(False)) & ~refine)
    open_ = node.join(parent, ["tree_id", "pid"]).withColumn("_u", score).filter(~closed & (F.col("_u") > -1))
    best = F.max(F.struct(F.col("_u"), -F.col("nid"))).alias("b")
    return open_.groupBy("tree_id", F.col("pid").alias("nid")).agg(best).select("tree_id", "nid", (-F.col("b.col2")).alias("child"), F.col("b._u").alias("ucb"))


def back_propagate(node: DataFrame, rule: str = "default") -> DataFrame:
    """(tree_id, nid, value): inner values from the leaves up, as visit-weighted means of the children;
    rule ``comp`` takes the mean of that and the node's own."""
    own = node.select("tree_id", "nid", "pid", "depth", "n", F.col("v").cast("double").alias("v"))
    trees = packed(own, ["n", "v"])
    places = F.sequence(F.lit(0), F.size("nodes") - 1)
    trees = _once(trees, "kids", F.transform(places, lambda i: F.filter(places, lambda j: F.get("up", j) == i)))
    last = F.size("nodes") - 1

    def add(done: Column, i: Column) -> Column:
        """Values from the last node on: children come before their parents."""
        at = last - i
        kids = F.get("kids", at)
        visits = lambda j: F.get("nodes", j)["c_n"].cast("double")
        total = F.aggregate(kids, F.lit(0.0), lambda a, j: a + visits(j))
        mean = F.aggregate(kids, F.lit(0.0), lambda a, j: a + F.get(done, last - j) * visits(j)) / F.nullif(total, F.lit(0.0))
        mine = F.get("nodes", at)["c_v"]
        new = F.when(F.size(kids) == 0, mine).when(mean.isNull(), mine).otherwise((mine + mean) / 2 if rule == "comp" else mean)
        return F.concat(done, F.array(new))

    trees = _once(trees, "values", F.reverse(F.aggregate(places, F.array().cast("array<double>"), add)))
    pairs = trees.select("tree_id", F.explode(F.arrays_zip(F.col("nodes.nid").alias("nid"), F.col("values").alias("value"))).alias("x"))
    return pairs.select("tree_id", "x.nid", "x.value")


def termination(node: DataFrame, max_nodes: int, correct_nodes: int, max_depth: int, rule: str = "count") -> DataFrame:
    """(tree_id, done): all leaves finished and completed, or enough correct leaves, or the tree's
    budget (nodes for rule ``count``, depth for ``depth``) is spent."""
    ends = leaves(node).groupBy("tree_id").agg(
        F.bool_and((F.col("type") == "Finish") & F.col("completed")).alias("closed"), F.count_if("correct").alias("hits")
    )
    spent = F.col("nodes") >= max_nodes if rule == "count" else F.col("depth") >= max_depth
    return tree_size(node).join(ends, "tree_id").select("tree_id", (F.col("closed") | (F.col("hits") >= correct_nodes) | spent).alias("done"))


def complete_paths(node: DataFrame) -> DataFrame:
    """Paths to leaves whose value is exactly 0 or 1."""
    ends = leaves(node).filter(F.col("v").isin(0.0, 1.0)).select("tree_id", "nid")
    return paths(node, ["step", "v"]).join(ends, ["tree_id", "nid"], "left_semi")


def reflecting(node: DataFrame) -> DataFrame:
    """Nodes below the first level whose value is less than their parent's."""
    parent = node.select("tree_id", F.col("nid").alias("pid"), F.col("v").alias("_pv"))
    return node.join(parent, ["tree_id", "pid"]).filter((F.col("v") < F.col("_pv")) & (F.col("depth") > 1)).drop("_pv")


def finish_children(node: DataFrame, answer: Column) -> DataFrame:
    """A finished child with the answer for each unfinished leaf; its place in the tree, text and type."""
    ends = leaves(node).filter(F.col("type") != "Finish")
    return ends.select("tree_id", F.col("nid").alias("pid"), (F.col("depth") + 1).alias("depth"), F.lit("Finish").alias("type"), answer.alias("step"))


def simulation_accuracy(samples: DataFrame, simulations: int = 20) -> DataFrame:
    """(tree_id, nid, sim) of rollouts (tree_id, nid, depth, k, correct): the mean over the first
    max(simulations // (depth + 1), 5)."""
    quota = F.greatest(F.floor(F.lit(simulations) / (F.col("depth") + 1)), F.lit(5))
    return samples.filter(F.col("k") < quota).groupBy("tree_id", "nid").agg(F.avg(F.col("correct").cast("double")).alias("sim"))


def records(node: DataFrame) -> DataFrame:
    """(tree_id, pos, neg): the chains (step, value, sim) of correct and of finished wrong leaves."""
    chain = paths(node, ["step", "v", "sim"])
    ends = leaves(node).filter(F.col("correct") | (F.col("type") == "Finish")).select("tree_id", "nid", "correct", "v", "sim")
    links = F.transform("path", lambda x: F.struct(x["step"].alias("step"), x["v"].alias("value"), x["sim"].alias("sim")))
    term = F.struct(links.alias("chain"), F.col("v").alias("value"), "sim")
    rows = ends.join(chain, ["tree_id", "nid"]).dropDuplicates(["tree_id", "path"])
    pick = lambda c: F.collect_list(F.when(c, term))
    return rows.groupBy("tree_id").agg(pick(F.col("correct")).alias("pos"), pick(~F.col("correct")).alias("neg"))


def from_chains(records_: DataFrame) -> DataFrame:
    """The inverse of :func:`records`: chains merged by common beginnings into nodes
    (tree_id, key, parent_key, depth, step, v, sim); ``key`` is the path text."""
    terms = records_.select("tree_id", F.explode(F.concat("pos", "neg")).alias("t")).select("tree_id", F.posexplode("t.chain").alias("depth", "x"), F.col("t.chain.step").alias("steps"))
    key = F.to_json(F.slice("steps", F.lit(1), F.col("depth") + 1))
    parent = F.when(F.col("depth") > 0, F.to_json(F.slice("steps", F.lit(1), F.col("depth"))))
    rows = terms.select("tree_id", key.alias("key"), parent.alias("parent_key"), "depth", "x.step", F.col("x.value").alias("v"), "x.sim")
    return rows.dropDuplicates(["tree_id", "key"])


def nested(rows: list[dict]) -> dict:
    """One tree's node rows (a budget bounds their number) as a nested document: step, value, parent text, type, children."""
    made = {r["nid"]: {"step": r["step"], "value": r["v"], "parent": None, "type": r["type"], "children": []} for r in rows}
    root: dict = {}
    for r in sorted(rows, key=lambda r: r["nid"]):
        if r["pid"] is None:
            root = made[r["nid"]]
        else:
            made[r["nid"]]["parent"] = made[r["pid"]]["step"]
            made[r["pid"]]["children"].append(made[r["nid"]])
    return root
