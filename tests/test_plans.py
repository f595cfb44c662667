"""The plans Spark makes: what is read, joined and run outside the JVM."""

from __future__ import annotations

import re

import pytest

from tracemill.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"

#: Functions that built-in expressions can't give, and the search and sampling loops.
PYTHON = {
    "boxed", "medcalc_extract", "medcalc_correct", "number_of", "lcs_recall", "clean_answer", "svamp", "math_correct", "calculation", "rouge", "rouge_summary", "tree_search", "tree_search_hash", "tree_search_valued", "metric_by_name", "sample_outputs", "token_f1", "symbolic_equal", "value_votes", "text_labels", "json_array",
}
#: Joins with a table of one row, and ranges of a column.
ONE_ROW = {"method_accuracy", "resume_watermark"}


def plan(spark, name: str) -> str:
    df = QUERIES[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_joins_and_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    if name not in ONE_ROW:
        assert "BroadcastNestedLoopJoin" not in text
    found = bool(re.search("ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups|BatchEvalPython", text))
    assert found == (name in PYTHON)
    assert "BatchEvalPython" not in text  # no function is called row by row


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("vote_sum", "event_id:bigint,user_id:bigint,event_type:string,value:double"),
        ("resume_anti", "o_custkey:bigint,o_orderstatus:string"),
        ("first_n", "event_id:bigint,user_id:bigint,event_type:string"),
        ("leaves", "p_partkey:bigint,p_size:int"),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderstatus,P)" in plan(spark, "resume_anti")


def test_votes_are_combined_before_the_shuffle(spark):
    assert plan(spark, "vote_sum").count("partial_") >= 2


def test_pairs_are_joined_by_tree_and_level(spark):
    assert re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[tree_id#\d+L?, depth#\d+, _bit#\d+, _node#\d+\]", plan(spark, "dpo_level"))


def test_all_methods_share_one_scan(spark):
    assert plan(spark, "vote_many").count("FileScan") == 1
