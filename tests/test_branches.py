"""Branches of operators that the registered queries do not reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.functions import metrics as M
from tracemill.functions import text as T
from tracemill.operators import datasets as D
from tracemill.operators import partition, tree, voting
from tracemill.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text("id,v,name\n1,2.5,a\n2,3.5,b\n")
    inferred = files.read_table(spark, str(tmp_path / "q.csv"))
    assert dict(inferred.dtypes) == {"id": "int", "v": "double", "name": "string"}
    out = str(tmp_path / "log.txt")
    for k in range(2):
        files.write_text(spark.createDataFrame([(f"line {k}",)], "value string"), out, mode="overwrite" if k == 0 else "append")
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["line 0", "line 1"]
    for name, i in (("part_1", 1), ("part_2", 2), ("part_x", 3), ("old", 9)):
        files.write_json(spark.createDataFrame([(i,)], "i int"), str(tmp_path / f"{name}.json"))
    found = files.combine_prefixed(spark, str(tmp_path), "part", numbered_only=True, existing=str(tmp_path / "old.json"))
    assert sorted(r["i"] for r in found.collect()) == [1, 2, 9]
    with pytest.raises(KeyError):
        files.read_any(spark, "x.bin")


def test_texts(spark):
    assert one(spark, ["Here is x\n\nbody", "plain"], T.drop_chatter_all, "array<string>") == ["body", "plain"]
    assert one(spark, "no phrase in this text", T.cut_trace) == "no phrase in t" + "."
    assert one(spark, "-1234567.5", T.thousands) == "-1,234,567.5"
    assert one(spark, "#Created Prompt#: new :", T.drop_markers) == "new"
    for name in ("gsm8k", "unknown"):
        assert one(spark, name, T.task_suffix) == T.TASK_SUFFIXES.get(name, "")
    assert len(T.TASK_SUFFIXES) == 17


@pytest.mark.parametrize(
    ("said", "accepted"),
    [("B", True), ("A", False), ("B. something else", True), ("A. Twowords", False), ("words and two", True), ("wo word", True), ("B}}", True), ("none", False)],
)
def test_acceptance_rules(spark, said, accepted):
    out = one(spark, f"Why.\n\nThe final answer is {said}.", lambda c: T.accept_response(c, F.lit("B"), F.lit("two words")))
    assert out == ("Why.\n\nThe answer is B." if accepted else None)


def test_acceptance_without_a_sentence(spark):
    assert one(spark, "no sentence", lambda c: T.accept_response(c, F.lit("B"), F.lit("two"))) is None
    assert one(spark, None, lambda c: T.accept_response(c, F.lit("B"), F.lit("two"))) is None


def test_metrics(spark):
    assert one(spark, "The diagnosis result is flu.\nmore", lambda c: M.medical_text(c, F.lit("Flu"))) == 1
    assert one(spark, "The answer is 1,234.", lambda c: M.number_substring(c, F.lit("so #### 1,234"), marked=True)) == 1
    assert one(spark, "So. The answer is 1, 2.", lambda c: M.math_correct(c, F.lit("(1,2)"))) == 1
    assert one(spark, "So. The answer is 5 p.m", lambda c: M.math_correct(c, F.lit("5p.m."))) == 1
    both = lambda name: one(spark, name, lambda c: M.metric_by_name(c, F.lit("The answer is A."), F.lit("A")))
    assert [both(n) for n in ("medexpert", "rds", "rdc", "medcalc", "what")] == [1, 1, 1, None, None]


def test_balanced_classes(spark):
    rows = [(1, 1, 0.1, 0), (1, 1, 0.9, 1), (1, 1, 0.5, 2), (1, 0, 0.3, 3), (2, 0, 0.3, 4)]
    df = spark.createDataFrame(rows, "item int, label int, var double, pos int")
    got = lambda k: {(r["item"], r["pos"]) for r in partition.balance_classes(df, ["item"], "label", "var", "pos", k).collect()}
    assert got(-1) == {(1, 1), (1, 3)}
    assert got(0) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 4)}
    assert got(2) == {(1, 1), (1, 2), (1, 3), (2, 4)}


def test_split_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(10)], "id int, k int")
    for ratio, n in ((0.0, 0), (0.3, 3), (0.65, 6), (1.0, 10)):
        out = partition.test_split(df, F.col("k"), ["id"], ratio)
        assert out.filter("is_test").count() == n and out.count() == 10
    assert {r["id"] for r in partition.test_split(df, F.col("k"), ["id"], 0.3).filter("is_test").collect()} == {3, 0, 2}


def test_uncertainty_of_simulations(spark):
    columns = "tree_id int, nid int, pid int, depth int, n int, trace string, simulations array<double>"
    node = spark.createDataFrame([(1, 0, None, 0, 2, "a", [1.0, 0.0]), (1, 1, 0, 1, 0, "b", [1.0])], columns)
    got = {r["nid"]: r["score"] for r in tree.node_scores(node).collect()}
    assert got == {0: pytest.approx(0.5 * 2 + 0.5 * (0.5 + 0.25)), 1: pytest.approx(0.5)}


@pytest.mark.parametrize(("method", "idx"), [("prm-min-vote-sum", 0), ("prm-max", 2), ("prm-prod-vote-mean", 2), ("vote-sum", 0), ("max", 2)])
def test_best_outputs(spark, method, idx):
    rows = [(1, 0, "a", 0.6, [0.0, 0.6, 0.6]), (1, 1, "a", 0.5, [0.0, 0.5, 0.5]), (1, 2, "b", 0.9, [0.0, 0.8, 0.9])]
    cand = spark.createDataFrame(rows, "id int, cand_idx int, answer string, score double, steps array<double>")
    assert voting.select_output(cand, method).first()["cand_idx"] == idx


def test_votes_over_sentences(spark):
    rows = [(1, 0, "so the answer is 'B'.", 1.0), (1, 1, "b", 0.5), (1, 2, "c", 1.2), (2, 0, None, 1.0)]
    cand = spark.createDataFrame(rows, "id int, cand_idx int, answer string, score double")
    gold = spark.createDataFrame([(1, "b of it"), (1, "B"), (2, "x")], "id int, gold string")
    got = sorted((r["id"], r["gold"], r["pred"], r["acc"]) for r in voting.vote_override(gold, cand, "vote-sum").collect())
    assert got == [(1, "B", "b", 1.0), (1, "b of it", "b", 0.0), (2, "x", None, None)]


def test_hard_labels(spark):
    assert one(spark, [0.5, 0.2, 0.4], lambda v: D.hard_labels(v, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.1)), 0.45, hrm=True), "array<double>") == [1, 0, 1]


def test_json_documents_of_many_tasks(spark, tmp_path):
    import json
    from pathlib import Path

    rows = [(i, None if i % 5 == 0 else f'"é\n{i}') for i in range(50)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    for name, options, most in (("many", {}, 4), ("one", {"single": True}, 1), ("wide", {"indent": 2}, 4)):
        out = str(tmp_path / f"{name}.json")
        files.write_json(df, out, **options)
        parts = [json.loads(p.read_text()) for p in Path(out).glob("part-*")]
        assert len(parts) == most and sum(map(len, parts)) == 50
        assert sorted(tuple(r) for r in files.read_any(spark, out).select("i", "t").collect()) == sorted(rows)
    files.write_json(df.filter("i < 0"), str(tmp_path / "none.json"))
    assert files.read_json(spark, str(tmp_path / "none.json"), "i int, t string").count() == 0
