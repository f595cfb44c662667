"""Hand-made cases of the functions: ties, nulls, empty lists, odd texts."""

from __future__ import annotations

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from tracemill.functions import metrics as M
from tracemill.functions import python_functions as P
from tracemill.functions import text as T
from tracemill.operators import datasets as D
from tracemill.operators import partition, search, tree, voting


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("the answer is A. The answer is B.", "A. The answer is B"),
        ("x\nThe answer is A\nfoo", None),
        ("The answer is A\n", "A"),
        ("The answer is 10.5 mg. ok", "10.5 mg. ok"),
        ("The answer is ", ""),
        ("no", None),
        ("", None),
        (None, None),
        ("The anſwer is K.", "K"),
    ],
)
def test_extract_template(spark, text, said):
    assert one(spark, text, T.extract_template) == said


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("Here is x\n\nbody\n\nI hope y", "Here is x\n\nbody"),
        ("Here is x\n\nbody", "body"),
        ("I'm glad\n\nbody\n\nmore", "body\n\nmore"),
        ("body", "body"),
        ("", ""),
        (None, None),
    ],
)
def test_drop_chatter(spark, text, kept):
    assert one(spark, text, T.drop_chatter) == kept


def test_answer_of_a_response(spark):
    f = T.extract_answer
    assert one(spark, "<think>a</think>b\nAnswer: C\nThe answer is D", f) == "C"
    assert one(spark, "Final Answer: **B**\nmore", f) == "B"
    assert one(spark, "The answer is *: A", f) == ": A"
    assert one(spark, "line\nlast", f) == "last."
    assert one(spark, "", f) == "."


def test_strings(spark):
    assert one(spark, "1234567.891", T.thousands) == "1,234,567.891"
    assert one(spark, "-1234", T.thousands) == "-1,234"
    assert one(spark, "007.2500", T.trim_zeros) == "7.25"
    assert one(spark, "3.00", T.trim_zeros) == "3"
    assert one(spark, "abc", T.trim_zeros) == "abc"
    assert one(spark, "\\dfrac12", T.latex) == "\\frac{1}{2}"
    assert one(spark, "1/2", T.latex) == "\\frac{1}{2}"
    assert one(spark, "k = .5", T.latex) == "0.5" or one(spark, "k = .5", T.latex) == ".5"
    assert one(spark, "\\sqrt3", T.latex) == "\\sqrt{3}"
    assert one(spark, "  a.. ", T.step_text) == "a."
    assert one(spark, ["r", "s"], T.path_text, "array<string>") == "Step 0: r\n\nStep 1: s"


@pytest.mark.parametrize(("gold", "said", "acc"), [("A", "'a'", 1), ("low", "Low dose", 1), ("A", "", 0), ("A", None, None), ("A", "BA", 0)])
def test_choice(spark, gold, said, acc):
    assert one(spark, said, lambda x: M.choice_or_substring(F.lit(gold), x)) == acc


@pytest.mark.parametrize(("n", "c", "k", "p"), [(4, 1, 1, 0.25), (4, 1, 2, 0.5), (1, 0, 2, 0), (2, 2, 1, 1), (5, 2, 2, 0.7)])
def test_pass_at_k(spark, n, c, k, p):
    assert spark.range(1).select(M.pass_at_k(F.lit(n), F.lit(c), k)).first()[0] == pytest.approx(p)


def test_votes(spark):
    rows = [(1, 0, "a", 1.0), (1, 1, "b", 1.0), (2, 0, "a", 3.0), (2, 1, "a", 3.0), (2, 2, "b", 5.0), (3, 0, "", 9.0), (3, 1, None, 9.0), (3, 2, "c", float("nan")), (3, 3, "d", 1.0)]
    cand = spark.createDataFrame(rows, "id int, cand_idx int, answer string, score double")
    won = lambda m: {r["id"]: r["answer"] for r in voting.vote(cand, m).collect()}
    assert won("vote-sum") == {1: "a", 2: "a", 3: "d"}
    assert won("vote-mean") == {1: "a", 2: "b", 3: "d"}
    assert won("max")[2] == "b"
    assert {r["id"]: r["answer"] for r in voting.vote(cand.repartition(5), "vote-sum").collect()} == won("vote-sum")
    with pytest.raises(ValueError, match="unknown"):
        voting.parse_method("prm-what")


@pytest.mark.parametrize(
    ("values", "soft", "labels"),
    [([1, 0.5, 0.4, 0.8], False, [1, 0.5, 0.3, 1.3]), ([1, 0.8, 0.2, 0.6, 0.9], True, [1, 0.8, 0.0, 1.2, 0.9]), ([1.0], False, [1.0]), ([1.0, 0.2], True, [1.0, 0.2]), ([], False, [])],
)
def test_reward_labels(spark, values, soft, labels):
    got = one(spark, [float(v) for v in values], lambda x: D.reward_labels(x, soft=soft), "array<double>")
    assert got == pytest.approx(labels)


def test_chunks(spark):
    df = spark.range(5)
    assert sorted(r["chunk"] for r in partition.split_chunks(df, ["id"], 4).collect()) == [0, 0, 1, 1, 2]
    assert partition.get_chunk(df, ["id"], 4, 3).count() == 0
    assert partition.split_chunks(df.filter("id < 0"), ["id"], 4).count() == 0


def test_positions_over_many_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.lit("x").alias("wide")).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted((r["k"], r["pos"]) for r in partition.with_position(df, ["k"]).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [p for _, p in got] == list(range(20_000))


def test_ucb_and_back_propagation(spark):
    columns = "tree_id int, nid int, pid int, depth int, type string, v double, n int, correct boolean, completed boolean, refine_cnt int, refine_limit int"
    rows = [(1, 0, None, 0, "Root", 0.5, 4, False, False, 0, 0), (1, 1, 0, 1, "Reason", 1.0, 1, False, False, 0, 0), (1, 2, 0, 1, "Reason", 0.0, 3, False, False, 0, 0), (1, 3, 0, 1, "Finish", 1.0, 0, True, True, 0, 0)]
    node = spark.createDataFrame(rows, columns)
    assert tree.select_child(node, unvisited=9.0).first()["child"] == 1
    got = {r["nid"]: r["value"] for r in tree.back_propagate(node).collect()}
    assert got[0] == pytest.approx(0.25)
    assert {r["nid"]: r["value"] for r in tree.back_propagate(node, "comp").collect()}[0] == pytest.approx(0.375)


def chain_tree(spark, depth):
    """A chain with a leaf beside each node."""
    rows = [(1, 0, None, 0, 0.0, 1, "r")]
    for k in range(depth):
        rows += [(1, 2 * k + 1, 2 * k - 1 if k else 0, k + 1, 0.5, 1, f"s{k}"), (1, 2 * k + 2, 2 * k - 1 if k else 0, k + 1, 1.0, 1, f"t{k}")]
    return spark.createDataFrame(rows, "tree_id int, nid int, pid int, depth int, v double, n int, step string")


@pytest.mark.parametrize("depth", [1, 3, 8, 60])
def test_walks_of_deep_trees(spark, depth):
    node = chain_tree(spark, depth)
    values = {0: None}
    for k in range(depth - 1, -1, -1):
        below = values.get(2 * k + 1, 0.5)
        values[2 * k - 1 if k else 0] = (below + 1.0) / 2
    got = {r["nid"]: r["value"] for r in tree.back_propagate(node).collect()}
    assert got[0] == pytest.approx(values[0]) and len(got) == 2 * depth + 1
    lines = {r["nid"]: [x["step"] for x in r["path"]] for r in tree.paths(node, ["step"]).collect()}
    assert lines[2 * depth] == ["r", *[f"s{k}" for k in range(depth - 1)], f"t{depth - 1}"]
    assert tree.ancestors(node, ["v"]).filter(f"nid = {2 * depth}").count() == depth + 1
    text = tree.back_propagate(node)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("LocalRelation") == 1 and "Join" not in text


def test_trees_with_odd_nodes(spark):
    columns = "tree_id int, nid int, pid int, depth int, v double, n int, step string"
    rows = [(1, 0, None, 0, 0.2, 0, "r"), (1, 1, 0, 1, None, None, None), (1, 2, 0, 1, 1.0, 0, "a"), (2, 5, 9, 1, 0.4, 1, "lost")]
    node = spark.createDataFrame(rows, columns)
    assert {(r["tree_id"], r["nid"]): r["value"] for r in tree.back_propagate(node).collect()} == {(1, 0): 0.2, (1, 1): None, (1, 2): 1.0, (2, 5): 0.4}
    assert tree.ancestors(node, []).count() == 6
    assert tree.back_propagate(node.filter("nid < 0")).count() == 0 and tree.paths(node.filter("nid < 0"), ["v"]).count() == 0


def test_nodes_of_one_text_are_one(spark):
    """A repeated sibling is not walked into; a finished child of a walked node counts even if repeated."""
    columns = "tree_id int, nid int, pid int, depth int, type string, v double, n int, step string"
    rows = [
        (1, 0, None, 0, "Root", 0.5, 1, "r"), (1, 1, 0, 1, "Reason", 0.9, 1, "a"), (1, 2, 0, 1, "Reason", 0.1, 1, "a"), (1, 3, 0, 1, "Reason", 0.5, 1, "b"),
        (1, 4, 1, 2, "Finish", 1.0, 1, "x"), (1, 5, 1, 2, "Finish", 1.0, 1, "x"), (1, 6, 2, 2, "Finish", 0.0, 1, "y"), (1, 7, 3, 2, "Finish", 0.0, 1, "z"), (1, 8, 3, 2, "Reason", 1.0, 1, "w"),
    ]
    node = spark.createDataFrame(rows, columns)
    first = {r["nid"] for r in tree.walked(node).filter("first").collect()}
    assert first == {0, 1, 3, 4, 7, 8}
    level = {(r["chosen"], r["rejected"]) for r in D.level_pairs(node, 0.8).collect()}
    assert level == {(4, 7)}
    assert {(r["chosen"], r["rejected"]) for r in D.finish_pairs(node, 0.8).collect()} == {(5, 7)}


def test_search_properties():
    config = search.Config(max_nodes=30)
    found = search.Search("p", "A", search.HashModel(), config).run()
    nodes = list(found.root.walk())
    assert len(nodes) == found.count
    assert found.root.visits >= len(found.root.children)
    assert all(0 <= n.value <= 1 for n in nodes)
    assert all(n.children or n.kind == "Finish" for n in nodes)
    again = search.Search("p", "A", search.HashModel(), config).run()
    assert [n.text for n in again.root.walk()] == [n.text for n in nodes]
    assert search.Search("w " * 9000, "A", search.HashModel(), search.Config()).run() is None


def grown(problem="B x slow", **changes):
    return search.Search(problem, "B", search.ScriptModel(), dataclasses.replace(search.PIPELINE, **changes))


def talk(s, f, *args):
    return search.alone(f(*args), s.model)


def test_answers_of_several_steps_become_nodes():
    s = grown()
    s.root.visits, s.root.value = 1, 0.25
    last = talk(s, s.answer_nodes, s.root, "First. Step 1: Second. Step 2: Third. The answer is B. The answer is C.")
    assert [n.text for n in s.root.walk()][1:] == ["First.", "Second.", "Third. The answer is B."]
    assert [n.kind for n in s.root.walk()][1:] == ["Reason", "Reason", "Finish"]
    assert (last.correct, last.completed, s.budget) == (True, True, 62)
    other = talk(s, s.answer_nodes, s.root, "Step 1: no end. Step 2: none")
    assert (other.kind, other.text) == ("Reason", "")


def test_what_becomes_of_steps():
    s = grown(actions=("Reason", "Finish", "Reflect"))
    low = s.add(s.root, "Finish", "The answer is C.")
    talk(s, s.score, low)
    assert (low.kind, low.value, low.completed) == ("Reason", 0.0, False)  # low finished nodes are opened again
    said = grown("B x sure")
    said.model = type("Telling", (search.ScriptModel,), {"generate": lambda *a: ["So. The answer is B."] * a[-1]})()
    talk(said, said.expand, said.root)
    assert {n.kind for n in said.root.children} == {"Finish"}  # a step that answers is finished


def test_a_search_without_gold_answers():
    s = search.Search("B x long", "", search.HashModel(), dataclasses.replace(search.PIPELINE, value_model=True, training=False, correct_nodes=None)).run()
    nodes = list(s.root.walk())
    assert not any(n.correct for n in nodes) and all(n.sim is None for n in nodes)
    a, b = s.root.children[:2]
    a.trajectory, a.completed, b.completed = [0.5, 0.5], False, False
    a.kind = b.kind = "Reason"
    assert s.priority(a, s.root) == pytest.approx(0.25 + 2 * math.sqrt(math.log(s.root.visits) / a.visits))
    changing = dataclasses.replace(s.config, constant=lambda parent, child: 0.0)
    s.config = changing
    assert s.priority(a, s.root) == pytest.approx(0.25)


def test_leaves_are_closed():
    assert all(n.kind == "Finish" for n in grown().run().leaves())
    some = grown("B x long").run()
    assert sum(n.kind != "Finish" for n in some.leaves()) == 1  # six right answers, the rest stays open
    every = grown("B x long", finish_uncompleted=True).run()
    assert all(n.kind == "Finish" for n in every.leaves())


def test_search_table_equals_searches_alone(spark):
    problems = [(str(i), f"B {i} {k}", "B") for i, k in enumerate(("sure", "lost", "long", "slow", "drawn", ""))]
    df = spark.createDataFrame(problems, "id string, question string, answer string")
    for model in (search.ScriptModel(), search.HashModel()):
        got = sorted(tuple(r) for r in search.tree_search(df, model).collect())
        assert got == sorted(r for p in problems for r in search.rows_of(*p, model, search.PIPELINE))


@pytest.mark.parametrize("change", [{}, {"value_model": True, "training": False}, {"actions": ("Reason", "Finish", "Reflect"), "finish_uncompleted": True}, {"rule": "depth", "max_depth": 3}, {"max_children": 2, "max_nodes": 90, "correct_nodes": None, "low_gate": 0.7}])
@pytest.mark.parametrize("model", [search.ScriptModel(), search.HashModel()])
def test_trees_grown_as_columns_are_the_trees_alone(model, change, monkeypatch):
    config = dataclasses.replace(search.PIPELINE, **change)
    kinds = ("sure", "lost", "long", "slow", "drawn", "")
    problems = [(str(i), f"{'ABCD'[i % 4]} {i} {kinds[i % 6]}", ("ABCD"[i % 4], "none", "", "d")[i // 7 % 4]) for i in range(90)] + [("over", "w " * 9000, "A")]
    monkeypatch.setattr(search, "TOGETHER", 40)
    assert search.as_columns(model, config, "mcts")
    for retries in (0, 2):
        batches = search.grown_as_columns(iter(problems), model, config, retries, list(search.TYPES))
        found = sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
        assert repr(found) == repr(sorted(r for p in problems for r in search.rows_of(*p, model, config, retries=retries)))
    part = next(search.grown_as_columns(iter(problems[:1]), model, config, 0, ["id", "type"]))
    assert part.schema.names == ["id", "type"]


def test_only_what_columns_are_written_for_is_grown_as_columns():
    other = type("Saying", (search.HashModel,), {"generate": lambda *a: ["The answer is B."] * a[-1]})()
    assert not search.as_columns(other, search.PIPELINE, "mcts")
    assert not search.as_columns(search.HashModel(), dataclasses.replace(search.PIPELINE, constant=lambda parent, child: 1.0), "mcts")


def test_rows_of_grown_columns_are_few_microseconds_each():
    import time

    problems = [(str(i), f"{'ABCD'[i % 4]} {i} {('sure', 'lost', 'long', 'slow')[i % 4]}", "ABCD"[i % 4]) for i in range(4000)]
    began = time.process_time()
    rows = sum(b.num_rows for b in search.grown_as_columns(iter(problems), search.ScriptModel(), search.PIPELINE, 0, list(search.TYPES)))
    # One by one it takes about 30 microseconds a node.
    assert rows == 147_000 and (time.process_time() - began) / rows < 15e-6


class Counting:
    """A model for batches that counts its calls."""

    def __init__(self, model):
        self.model, self.calls, self.asked = model, 0, 0

    def answer_many(self, method, args):
        self.calls += 1
        self.asked += len(args)
        return [getattr(self.model, method)(*a) for a in args]


@pytest.mark.parametrize("most", [1, 7, 64])
def test_trees_together_are_the_trees_alone(most):
    problems = [(str(i), f"B {i} {('sure', 'lost', 'long', 'slow', 'drawn')[i % 5]}", "B") for i in range(60)]
    config = search.Config(max_nodes=25, correct_nodes=4, actions=("Reason", "Finish", "Reflect"))
    for plain in (search.ScriptModel(), search.HashModel()):
        one, many = Counting(plain), Counting(plain)
        alone = [search.rows_of(*p, one, config) for p in problems]
        found = list(search.together((search.tree_rows(*p, config) for p in problems), many, most))
        assert sorted(found) == sorted(alone)
        assert (one.asked, one.calls) == (many.asked, one.asked)
        # As many trees are open, so many times fewer calls, but for the last ones and the kinds of questions.
        assert many.calls <= one.calls if most == 1 else many.calls < one.calls / min(most, 10) * 3


def test_a_talk_that_asks_nothing():
    assert list(search.together(iter([]), search.HashModel())) == []
    over = [search.tree_rows(str(i), "w " * 9000, "A", search.Config()) for i in range(5)]
    assert list(search.together(iter(over), search.HashModel(), 2)) == [[]] * 5


def test_models_of_batches_in_a_table(spark):
    problems = [(str(i), f"B {i} slow", "B") for i in range(40)]
    df = spark.createDataFrame(problems, "id string, question string, answer string")
    model = Batch(search.ScriptModel())
    got = sorted(tuple(r) for r in search.tree_search(df, model, open_trees=5).collect())
    assert got == sorted(r for p in problems for r in search.rows_of(*p, search.ScriptModel(), search.PIPELINE))


@dataclasses.dataclass(frozen=True)
class Batch:
    model: search.ScriptModel

    def answer_many(self, method, args):
        return [getattr(self.model, method)(*a) for a in args]


def test_a_value_model(spark):
    problems = [(str(i), f"B {i} drawn", "B") for i in range(6)]
    df = spark.createDataFrame(problems, "id string, question string, answer string")
    config = dataclasses.replace(search.PIPELINE, value_model=True, max_nodes=30)
    rows = search.tree_search(df, search.HashModel(), config).collect()
    paths = {(r["id"], r["nid"]): r for r in rows}

    def steps(r):
        return [*(steps(paths[r["id"], r["pid"]]) if r["pid"] is not None else []), r["step"]]

    scored = [r for r in rows if r["pid"] is not None and r["value_trajectory"] and not any(x["pid"] == r["nid"] and x["id"] == r["id"] for x in rows)]
    assert len(scored) > 20
    for r in scored:
        said = search.HashModel().value(f"B {r['id']} drawn", steps(r))
        assert r["value_trajectory"][-1] == pytest.approx(said)


def test_actions():
    model = type("Saying", (search.ScriptModel,), {"generate": lambda *a: ["x\n\nPlan 1: 1. a\n\nStep 3: b"] * a[-1]})()
    known = {n: f for kind in search.ACTIONS.values() for n, f in kind.items()}
    assert set(known) == {"Reason", "Finish", "Reflect", "Think", "Refine", "Simulation", "Decompose"}
    assert search.alone(known["Reflect"]("p", [], 2), model) == ["But wait, x\n\nPlan 1: 1. a"] * 2
    assert search.alone(known["Decompose"]("p", [], 2), model) == [T.PLAN_LEAD + "1. a"]


def test_python_functions():
    assert P.boxed_all("\\boxed{a{b}c} \\boxed{d") == ["a{b}c"]
    assert P.boxed_last("boxed 5$ x") == "5"
    assert P.arithmetic("round(2 * (3 + 4) / 5, 1)") == 2.8
    for bad in ("__import__('os')", "9**9**9**9", "a", "(1).__class__"):
        with pytest.raises((ValueError, SyntaxError, OverflowError)):
            P.arithmetic(bad)
    assert P.number("50%") == 0.5
    assert P.number("x") is None
    assert P.calculator_answer("str(sqrt(16) * 2)", 2) == "8.0"
    assert P.calculator_answer("1, 2, 3", 4) == "3"
    assert P.calculator_answer("nothing", 4) == "N/A"
    assert P.calculator_answer("5", 999) is None
    assert P.calculator_correct("5", "x", 2, "4", "6") == 1
    assert P.calculator_correct("N/A", "x", 2, "4", "6") == 0
    assert P.lcs_recall("a b c", "a c d") == pytest.approx(2 / 3)
    assert P.lcs_recall("", "a") == 0
    assert P.raw_answer("theoremqa", ("The answer is",), "The answer is x = 1/4.") == "0.25"
    assert P.raw_answer("numglue", ("The answer is",), "The answer is 3/4 or 1.50") == "0.75"
    assert [P.trimmed(n) for n in ("007", "-0", "2.50", "1/8", "12/", "1000000000000000.0")] == ["7", "0", "2.5", "0.125", "12/", "1000000000000000"]
    with pytest.raises(ValueError, match="unknown data set"):
        P.readers_of("what")
    assert P.calculator_answer("str(round(2 * (3 + 4)", 2) == "14"
    assert P.calculator_answer("str(3 * 2) # why", 2) == "6"
    assert P.calculator_answer("53.1%", 2) == "0.531"
    assert P.calculator_answer("['5 weeks', '3 days']", 69) == "(5, 3)"
    assert P.calculator_answer("1/2/2024", 13) == "01/02/2024"
    with pytest.raises(NotImplementedError):
        M.program_correct("print(1)")


@pytest.mark.parametrize(
    ("name", "said", "answer"),
    [
        ("math", "The answer is \\boxed{7}.", "7"),
        ("math", "The answer is \\boxed{\\dfrac12}.", "\\frac{1}{2}"),
        ("math", "The answer is x = 3 cm", "3"),
        ("math", "one 2 or .5", "0.5"),
        ("gsm8k", "The answer is 007.", "7"),
        ("gsm8k", "3 and 4", "4"),
        ("mmlu", "The answer is (C) or (D).", "C"),
        ("mmlu", "maybe c or D", "D"),
        ("gpqa_diamond", "The answer is E", "E"),
        ("bbh_x", "The answer is so/", "so"),
        ("math", None, None),
    ],
)
def test_clean_answer(spark, name, said, answer):
    assert one(spark, said, lambda c: P.clean_answer(c, name)) == answer


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("a\n\nb. The answer is C.", "But wait, a\n\nb. The answer is C."),
        ("a\n\nStep 4: b", "But wait, a"),
        ("a\nStep 4\n\n<step>c\n\n<problem>d", "But wait, a\nStep 4"),
        (None, None),
    ],
)
def test_reflection(spark, text, kept):
    assert one(spark, text, T.reflection) == kept


def test_plans(spark):
    lead = T.PLAN_LEAD
    assert one(spark, "x\n\nPlan 1: 1. a\n2. b\n\nPlan 12: 1. c\n\n1. d\n\nPlan 3: none", T.plans) == [lead + "1. a\n2. b", lead + "1. d"]
    assert one(spark, None, T.plans) is None


def test_units(spark):
    for text, plain in (("3\\pi", "3*3.14"), ("\\pi r", "3.14 r"), ("\\sqrt{2}π", "\\sqrt{2}π"), ("$5%", "5/100"), ("20° C", "20"), ("3ππ", "3*3.143.14")):
        assert one(spark, text, T.clean_units) == plain
        assert P.without_signs(text) == plain


def test_softmax(spark):
    assert one(spark, [0.0, 0.0], D.step_probability, "array<double>") == 0.5
    assert one(spark, [1000.0, 0.0], D.step_probability, "array<double>") == pytest.approx(0.0)
    assert math.isclose(one(spark, 0.0, D.sigmoid, "double"), 0.5)


def test_stream_resumes(spark, tmp_path):
    from tracemill.streaming.resume import arriving_records, process_once

    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k, ids in enumerate(([1, 2], [2, 3])):
        (folder / f"{k}.jsonl").write_text("".join(f'{{"id": "{i}", "v": {i}}}\n' for i in ids))
        q = process_once(arriving_records(spark, str(folder), "id string, v int"), lambda df: df.withColumn("w", F.col("v") * 2), target, str(tmp_path / "state"))
        q.awaitTermination()
    assert sorted((r["id"], r["w"]) for r in spark.read.parquet(target).collect()) == [("1", 2), ("2", 4), ("3", 6)]
