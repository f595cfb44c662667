"""Scores kept over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import kept_scores
from tracemill.sources import files


def rule(text, gold):
    return (F.coalesce(text, F.lit("")) == F.coalesce(gold, F.lit(""))).cast("int")


def test_only_new_rows_are_scored(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = [(1, "a", "a"), (2, "b", "a"), (3, "a", "a"), (4, None, "a"), (5, "a", None), (6, None, None), (7, "", "a")]

    def run(rows, version="1"):
        df = spark.createDataFrame(rows, "id int, text string, gold string")
        return {r["id"]: (r["score"], r["fresh"]) for r in kept_scores.score(df, path, "same", version, rule).collect()}

    first = run(rows)
    assert first == {1: (1.0, True), 2: (0.0, True), 3: (1.0, True), 4: (0.0, True), 5: (0.0, True), 6: (1.0, True), 7: (0.0, True)}
    # Another order, another id, one changed text, one new row.
    second = run([(9, "a", "a"), (2, "a a", "a"), *rows[3:], (8, "new", "new")])
    assert {i for i, (_, fresh) in second.items() if fresh} == {2, 8}
    assert second[9] == (1.0, False) and second[8] == (1.0, True)
    assert all(fresh for _, fresh in run(rows, "2").values())  # another version of the rule
    before = kept_scores.load(spark, path).count()
    assert kept_scores.compact(spark, path) == before == 14
    assert len(files.list_names(spark, path)) == 1
    assert not any(fresh for _, fresh in run(rows).values())


def test_parts_of_an_address_are_kept_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a:1", "b"), (None, "-"), ("-", None)], "t string, g string")
    assert df.select(kept_scores.address("t", "g", "m", "1")).distinct().count() == 5


def test_an_empty_cache(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert kept_scores.load(spark, path).count() == 0 and kept_scores.compact(spark, path) == 0
    df = spark.createDataFrame([], "id int, text string, gold string")
    assert kept_scores.score(df, path, "m", "1", rule).count() == 0
