"""Voting and best-of-n selection over sampled answers.

Input is ``cand(id, cand_idx, answer, score)`` or ``(..., steps)`` with the step scores, root
first. Ties go to the answer, or candidate, met first (the smallest cand_idx). Null and
empty answers don't vote. Sums are taken over decimals of twelve places, so they do not depend on
the order of rows, and are combined before the shuffle: a question with very many candidates
costs no task more than its distinct answers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..functions.symbolic import value_key

OPS = ("mean", "prod", "gmean", "min", "sum", "last", "max")
RULES = ("vote-sum", "vote-mean", "vote-count", "max")


def steps_score(op: str, steps: Column | str = "steps") -> Column:
    """One score of the step scores; the root step counts only as the last."""
    s = F.col(steps) if isinstance(steps, str) else steps
    inner = F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
    n = F.size(inner)
    total = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x)
    logs = F.aggregate(inner, F.lit(0.0), lambda a, x: a + F.when(x > 0, F.ln(x)).otherwise(0.0))
    return {
        "mean": F.when(n > 0, total / n),
        "prod": F.aggregate(inner, F.lit(1.0), lambda a, x: a * x),
        "gmean": F.when(n > 0, F.when(F.exists(inner, lambda x: x == 0), 0.0).otherwise(F.exp(logs / n))),
        "min": F.coalesce(F.array_min(inner), F.lit(0.0)),
        "sum": total,
        "last": F.try_element_at(s, F.lit(-1)),
        "max": F.array_max(inner),
    }[op]


#: The named methods: score of a candidate's steps (null: its scalar score) and group rule.
METHODS: dict[str, tuple[str | None, str]] = {
    "vote-sc": (None, "vote-count"),
    "max": (None, "max"),
    "vote-sum": (None, "vote-sum"),
    "vote-mean": (None, "vote-mean"),
    "sc": (None, "vote-count"),
    "prm-mean-vote-sum": ("mean", "vote-sum"),
    "prm-prod-vote-sum": ("prod", "vote-sum"),
    "prm-gmean-vote-sum": ("gmean", "vote-sum"),
    "prm-gmean-vote-mean": ("gmean", "vote-mean"),
    "prm-min-vote-sum": ("min", "vote-sum"),
    "prm-sum-vote-sum": ("sum", "vote-sum"),
    "prm-sum-vote-mean": ("sum", "vote-mean"),
    "prm-vote-sum": ("last", "vote-sum"),
    "prm-meanmax": ("mean", "max"),
    "prm-minmax": ("min", "max"),
    "prm-prodmax": ("prod", "max"),
    "prm-max": ("last", "max"),
    "prm-gmeanmax": ("gmean", "max"),
}


def parse_method(method: str) -> tuple[str | None, str]:
    """(score of steps, group rule) of a named method or of the grammar
    ``[prm-]{min|mean|gmean|prod|sum|vote}-{vote-sum|vote-mean|max}``."""
    if method in METHODS:
        return METHODS[method]
    m = re.fullmatch(r"(prm-)?(min|mean|gmean|prod|sum|vote)-(vote-sum|vote-mean|max)", method)
    if not m:
        raise ValueError(f"unknown method {method}")
    op = "last" if m[2] == "vote" else m[2]
    return (op if m[1] else None), m[3]


def scored(cand: DataFrame, op: str | None) -> DataFrame:
    """cand(id, cand_idx, answer, g): candidates that vote. NaN scores are left out."""
    g = F.col("score").cast("double") if op is None else steps_score(op)
    out = cand.filter(F.col("answer").isNotNull() & (F.col("answer") != "")).select("id", "cand_idx", "answer", g.alias("g"))
    return out.filter(~F.isnan(F.coalesce("g", F.lit(0.0))))


def exact_sum(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.try_cast("decimal(30,12)")).cast("double")


def _weight(rule: str) -> Column:
    return {
        "vote-count": F.count(F.lit(1)).cast("double"),
        "vote-sum": exact_sum("g"),
        "vote-mean": exact_sum("g") / F.count("g"),
        "max": F.max("g"),
    }[rule]


def answer_weights(cand: DataFrame, method: str) -> DataFrame:
    """(id, answer, weight, first_idx): the weight of every distinct answer."""
    op, rule = parse_method(method)
    return scored(cand, op).groupBy("id", "answer").agg(_weight(rule).alias("weight"), F.min("cand_idx").alias("first_idx"))


def vote(cand: DataFrame, method: str = "vote-sum") -> DataFrame:
    """(id, answer, weight): the winner of each question."""
    op, rule = parse_method(method)
    if rule == "max":
        best = F.max(F.struct("g", -F.col("cand_idx"), "answer")).alias("w")
        return scored(cand, op).groupBy("id").agg(best).select("id", "w.answer", F.col("w.g").alias("weight"))
    best = F.max(F.struct("weight", -F.col("first_idx"), "answer")).alias("w")
    return answer_weights(cand, method).groupBy("id").agg(best).select("id", "w.answer", "w.weight")


def vote_by_value(cand: DataFrame, method: str = "sc") -> DataFrame:
    """(id, answer, weight): :func:`vote` where answers of equal value vote together, in the spelling given first.

    Values are keys of a grouping like any answer, combined before the shuffle."""
    op, rule = parse_method(method)
    if rule == "max":
        return vote(cand, method)
    first = F.min(F.struct("cand_idx", "answer")).alias("first")
    weights = scored(cand, op).withColumn("_value", value_key("answer")).groupBy("id", "_value").agg(_weight(rule).alias("weight"), first)
    best = F.max(F.struct("weight", (-F.col("first.cand_idx")).alias("o"), "first.answer")).alias("w")
    return weights.groupBy("id").agg(best).select("id", "w.answer", "w.weight")


def vote_many(cand: DataFrame, methods: list[str]) -> DataFrame:
    """(method, id, answer, weight) of several methods from one grouping by question and answer."""
    parsed = {m: parse_method(m) for m in methods}
    ops = list(dict.fromkeys(op for op, _ in parsed.values()))
    names = {op: f"g_{op}" for op in ops}
    score = lambda op: F.col("score").cast("double") if op is None else steps_score(op)
    rows = cand.filter(F.col("answer").isNotNull() & (F.col("answer") != "")).select("id", "cand_idx", "answer", *[score(op).alias(n) for op, n in names.items()])
    aggregates: list[Column] = [F.min("cand_idx").alias("first_idx"), F.count(F.lit(1)).cast("double").alias("count")]
    for n in names.values():
        aggregates += [exact_sum(n).alias(f"sum_{n}"), F.max(F.struct(F.col(n), -F.col("cand_idx"))).alias(f"max_{n}")]
    per_answer = rows.groupBy("id", "answer").agg(*aggregates)
    winners = []
    for m, (op, rule) in parsed.items():
        n = names[op]
        if rule == "max":
            key = F.struct(F.col(f"max_{n}")[n].alias("weight"), F.col(f"max_{n}")["col2"].alias("o"), F.col("answer"))
        else:
            w = {"vote-count": F.col("count"), "vote-sum": F.col(f"sum_{n}"), "vote-mean": F.col(f"sum_{n}") / F.col("count")}[rule]
            key = F.struct(w.alias("weight"), (-F.col("first_idx")).alias("o"), F.col("answer"))
        winners.append(F.max(key).alias(m))
    best = per_answer.groupBy("id").agg(*winners)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"`{m}`.answer").alias("answer"), F.col(f"`{m}`.weight").alias("weight")) for m in parsed]))
    return best.select("id", pairs.alias("x")).select("x.method", "id", "x.answer", "x.weight")


def method_accuracy(winners: DataFrame, gold: DataFrame) -> DataFrame:
    """(method, acc): share of questions whose gold answer is a substring of the winner, any case.
    Questions without a winner count as wrong."""
    hit = F.coalesce(F.lower("answer").contains(F.lower("gold")), F.lit(False)).cast("double")
    total = gold.agg(F.count(F.lit(1)).alias("n"))
    hits = winners.join(gold.select("id", F.col("answer").alias("gold")), "id").groupBy("method").agg(F.sum(hit).alias("hits"))
    return hits.join(F.broadcast(total)).select("method", (F.col("hits") / F.col("n")).alias("acc"))


def compare_methods(cand: DataFrame, gold: DataFrame, methods: list[str]) -> DataFrame:
    return method_accuracy(vote_many(cand, methods), gold)


def comparison_table(results: DataFrame, datasets: list[str]) -> DataFrame:
    """(method, one column per data set in percent, Mean): data sets without a result are null."""
    wide = results.groupBy("method").pivot("dataset", datasets).agg(F.avg(F.col("acc") * 100))
    present = F.filter(F.array(*[F.col(f"`{d}`") for d in datasets]), lambda x: x.isNotNull())
    return wide.withColumn("Mean", F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)))


def select_output(cand: DataFrame, method: str = "prm-mean-vote-sum") -> DataFrame:
    """(id, cand_idx, answer, g): the best-scored candidate among those with the winning answer."""
    op, _ = parse_method(method)
    winners = vote(cand, method).select("id", "answer")
    best = F.max(F.struct("g", -F.col("cand_idx"))).alias("w")
    return (
        scored(cand, op)
        .join(winners, ["id", "answer"])
        .groupBy("id", "answer")
        .agg(best)
        .select("id", (-F.col("w.col2")).alias("cand_idx"), "answer", F.col("w.g").alias("g"))
    )


def self_consistency(outputs: DataFrame) -> DataFrame:
    """(id, answer, text, n) of outputs (id, cand_idx, text): the answer most outputs give, in lower
    case without quotes, and the first output that gives it."""
    answer = F.lower(T.lit(T.lit(T.extract_answer("text"), "'", ""), '"', ""))
    votes = outputs.withColumn("answer", answer).groupBy("id", "answer").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("cand_idx", "text")).alias("first")
    )
    best = F.max(F.struct("n", -F.col("first.cand_idx"), "answer", F.col("first.text").alias("text"))).alias("w")
    return votes.groupBy("id").agg(best).select("id", "w.answer", "w.text", "w.n")


def rescore(outputs: DataFrame, score, method: str = "prm-max") -> DataFrame:
    """:func:`select_output` on stored outputs (id, cand_idx, text), scored anew: ``score`` maps the
    column of outputs to their step scores (a column expression or an Arrow UDF of a model)."""
    cand = outputs.select("id", "cand_idx", T.extract_answer("text").alias("answer"), score(F.col("text")).alias("steps"))
    cand = cand.withColumn("score", F.try_element_at("steps", F.lit(-1)))
    return select_output(cand, method)


def score_rows(rows: DataFrame, metric: Column) -> DataFrame:
    """``rows`` and their metric as ``acc``."""
    return rows.withColumn("acc", metric.cast("double"))


def score_summary(scored_rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of acc (nulls stay out) and number of rows for each group."""
    return scored_rows.groupBy(*by).agg(F.avg("acc").alias("acc"), F.count(F.lit(1)).alias("n"))


def wrong_rows(scored_rows: DataFrame) -> DataFrame:
    return scored_rows.filter("acc = 0")


def score_cache(rows: DataFrame, metric: Column, prediction: Column, gold: Column, candidates: Column | None = None) -> DataFrame:
    """``id, acc, pred, ground_truth, text_answer, pass_at_k, all_acc`` of rows (id, text): a metric, what
    it judged, and pass@1 and pass@2 over candidate outputs (an array column) where there are any."""
    hits = F.array().cast("array<int>") if candidates is None else M.candidate_correct(candidates, gold)
    passes = F.array().cast("array<double>") if candidates is None else M.pass_at(candidates, gold)
    return rows.select(
        "id", metric.cast("double").alias("acc"), prediction.alias("pred"), gold.alias("ground_truth"),
        F.col("text").alias("text_answer"), passes.alias("pass_at_k"), hits.alias("all_acc"),
    )


def vote_override(rows: DataFrame, cand: DataFrame, method: str) -> DataFrame:
    """``rows`` (id, gold) scored by the winner of a vote over their candidates (id, cand_idx, answer, score or steps)
    in place of their own text: ``pred`` and ``acc``. An answer sentence counts as what it says, in lower case without
    quotes; other answers as they are."""
    raw = F.col("answer")
    told = M.unquote(F.lower(T.extract_template(raw)))
    said = F.when(F.lower(raw).contains("the answer is"), told).otherwise(raw)
    winners = vote(cand.withColumn("answer", said), method).select("id", F.col("answer").alias("pred"))
    return rows.join(winners, "id", "left").withColumn("acc", M.choice_or_substring("gold", "pred").cast("double"))


def rouge_summary(rows: DataFrame, rouge: Column, by: list[str]) -> DataFrame:
    """The means of the three recalls of :func:`..functions.metrics.rouge` for each group."""
    names = ("rouge_1", "rouge_2", "rouge_l")
    return rows.select(*by, rouge.alias("_r")).groupBy(*by).agg(*[F.avg(F.col("_r")[n]).alias(n) for n in names])


def result_row(cache: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean acc and mean pass@k, position by position, of a score cache; a row without candidates
    empties pass_at_k, as positions are zipped to the shortest."""
    shortest = F.min(F.size("pass_at_k")).alias("_n")
    means = [F.avg(F.get("pass_at_k", F.lit(i))).alias(f"_p{i}") for i in range(2)]
    out = cache.groupBy(*(by or [])).agg(F.avg("acc").alias("acc"), shortest, *means)
    return out.select(*(by or []), "acc", F.slice(F.array("_p0", "_p1"), F.lit(1), F.greatest("_n", F.lit(0))).alias("pass_at_k"))
