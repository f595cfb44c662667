"""Trees as intervals, and pairs of far values."""

from __future__ import annotations

import random

import pytest

from tracemill.operators import datasets, intervals

SCHEMA = "tree_id long, nid long, pid long, trace string, v double"


def forest(rng: random.Random) -> list[tuple]:
    rows: list[tuple] = []
    for tree, (n, shape) in enumerate([(1, "any"), (150, "any"), (100, "chain"), (90, "star"), (100, "deep")]):
        nids = rng.sample(range(5000), n)
        for i, nid in enumerate(nids):
            up = {"any": lambda i: rng.randrange(i), "chain": lambda i: i - 1, "star": lambda i: 0, "deep": lambda i: max(0, i - rng.randint(1, 4))}[shape]
            rows.append((tree, nid, None if i == 0 else nids[up(i)], rng.choice(["a", "a", "a", "b", "c", None, f"t{i}"]), rng.random()))
    return rows


@pytest.fixture(scope="module")
def trees(spark):
    rows = forest(random.Random(4))
    # A circle, and a node whose parent is missing.
    more = [(50, 1, 2, "x", 0.1), (50, 2, 1, "x", 0.2), (50, 3, None, "x", 0.3), (51, 1, None, "x", 0.1), (51, 2, 77, "x", 0.2)]
    rng = random.Random(5)
    table = rows + more
    rng.shuffle(table)
    return rows, spark.createDataFrame(table, SCHEMA).repartition(5)


def lines(rows):
    up = {(t, n): (t, p) if p is not None else None for t, n, p, _, _ in rows}
    out = {}
    for key in up:
        line, at = [], key
        while at is not None:
            line.append(at)
            at = up[at]
        out[key] = line
    return out


@pytest.mark.parametrize("rows_per_bucket", [16, intervals.ROWS])
def test_intervals(trees, rows_per_bucket):
    rows, df = trees
    above = lines(rows)
    got = {(r["tree_id"], r["nid"]): (r["entry"], r["exit"], r["n"]) for r in intervals.intervals(df, rows_per_bucket).withColumn("n", intervals.size()).collect()}
    assert set(got) == set(above) | {(50, 3), (51, 1)}
    under = {k: 0 for k in above}
    for line in above.values():
        for a in line:
            under[a] += 1
    assert {k: got[k][2] for k in above} == under
    keys = random.Random(1).sample(sorted(above), 120)
    for a in keys:
        for b in keys:
            if a[0] == b[0]:
                assert (got[a][0] <= got[b][0] and got[b][1] <= got[a][1]) == (a in above[b])


def test_interval_join(trees, spark):
    _, df = trees
    spans = intervals.intervals(df).filter("tree_id = 1")
    joined = spans.alias("u").join(spans.alias("l"), "tree_id").filter(intervals.above("u", "l"))
    assert joined.count() == sum(len(line) for key, line in lines(trees[0]).items() if key[0] == 1)


@pytest.mark.parametrize("rows_per_bucket", [16, intervals.ROWS])
def test_diversity_of_subtrees(trees, rows_per_bucket):
    rows, df = trees
    trace = {(t, n): x for t, n, _, x, _ in rows}
    under: dict = {}
    for key, line in lines(rows).items():
        for a in line:
            under.setdefault(a, set()).add(trace[key])
    got = {(r["tree_id"], r["nid"]): r["value"] for r in intervals.diversity(df, rows=rows_per_bucket).collect()}
    assert {k: got[k] for k in under} == {k: len(v - {None}) for k, v in under.items()}


def test_paths_by_doubling(trees):
    rows, df = trees
    above, value = lines(rows), {(t, n): v for t, n, _, _, v in rows}
    depth = {(r["tree_id"], r["nid"]): r["depth"] for r in intervals.depths(df).collect()}
    assert {k: depth[k] for k in above} == {k: len(line) - 1 for k, line in above.items()}
    assert (50, 1) not in depth and (51, 2) not in depth
    low = {(r["tree_id"], r["nid"]): r["value"] for r in intervals.path_min(df).collect()}
    assert {k: low[k] for k in above} == {k: min((value[a] for a in line[:-1]), default=None) for k, line in above.items()}


def test_empty_trees(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert intervals.intervals(df).count() == 0 and intervals.diversity(df).count() == 0 and intervals.path_min(df).count() == 0


@pytest.mark.parametrize("gap", [0.8, 0.1, 3.0])
def test_far_apart(spark, gap):
    rng = random.Random(int(gap * 10))
    value = lambda: rng.choice([rng.random(), rng.uniform(-50, 50), rng.randint(0, 10) / 10, 1e9 * rng.random(), -1e9, gap, 0.0, None, float("nan")])
    a = [(rng.randrange(3), i, value()) for i in range(250)]
    b = [(rng.randrange(3), i, value()) for i in range(250)]
    got = datasets.far_apart(spark.createDataFrame(a, "k int, i int, x double"), spark.createDataFrame(b, "k int, j int, y double"), ["k"], "x", "y", gap).collect()
    real = lambda v: v is not None and v == v
    want = {(i, j) for k, i, x in a for m, j, y in b if k == m and real(x) and real(y) and x - y > gap}
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want


def test_few_pairs_are_made_for_nothing(spark):
    rng = random.Random(8)
    rows = [(0, i, rng.random()) for i in range(2000)]
    high, low = spark.createDataFrame(rows, "k int, i int, x double"), spark.createDataFrame(rows, "k int, j int, y double")
    made = []
    listener = datasets.far_apart(high, low, ["k"], "x", "y", 0.8)
    found = listener.collect()
    plan = listener._jdf.queryExecution().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if "Join" in node.nodeName() and "_node" in node.simpleString(100):
            made.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        if inner is not None:
            stack.append(inner)
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    want = sum(1 for _, _, x in rows for _, _, y in rows if x - y > 0.8)
    assert len(found) == want
    assert made and max(made) <= 2 * want
