"""The registered queries: each operator over the driver's tables, with SQL that checks it."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import python_functions as P
from ..functions import symbolic as S
from ..functions import text as T
from ..operators import datasets as D
from ..operators import partition as part
from ..operators import intervals, kept_scores, search, tree, voting
from ..sources import files
from ..sources.json_arrays import read_json_array
from ..sources.shared import shared_folder
from ..streaming.votes import last_votes, vote_arriving
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            with_ = ", ".join(V.SQL[v] for v in views.split())
            body = sql.strip()
            recursive = "RECURSIVE " if "RECURSIVE" in body else ""
            body = body.replace("RECURSIVE ", "")
            if with_:
                body = f"WITH {recursive}{with_}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
            ORACLE_SQL[name] = body
        return f

    return put


def rounded(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# Voting --------------------------------------------------------------------------------------

_G = {
    None: "CAST(score AS DOUBLE)",
    "mean": "list_avg(steps[2:])",
    "prod": "list_aggregate(steps[2:], 'product')",
    "gmean": "CASE WHEN list_contains(steps[2:], 0) THEN 0 ELSE exp(list_avg(list_transform(steps[2:], lambda x: CASE WHEN x > 0 THEN ln(x) ELSE 0 END))) END",
    "min": "list_min(steps[2:])",
    "sum": "list_sum(steps[2:])",
    "last": "steps[-1]",
}
_EXACT = "CAST(sum(CAST(g AS DECIMAL(30,12))) AS DOUBLE)"
_W = {"vote-count": "CAST(count(*) AS DOUBLE)", "vote-sum": _EXACT, "vote-mean": f"{_EXACT} / count(g)"}


def vote_sql(method: str) -> str:
    op, rule = voting.parse_method(method)
    scored = f"scored AS (SELECT id, cand_idx, answer, {_G[op]} AS g FROM cand WHERE answer IS NOT NULL AND answer <> '')"
    if rule == "max":
        return f"WITH {scored} SELECT id, arg_max(answer, row(g, -cand_idx)) AS answer, round(max(g), 6) AS weight FROM scored GROUP BY id"
    return f"""WITH {scored}, w AS (SELECT id, answer, {_W[rule]} AS weight, min(cand_idx) AS p FROM scored GROUP BY id, answer)
        SELECT id, arg_max(answer, row(weight, -p)) AS answer, round(max(weight), 6) AS weight FROM w GROUP BY id"""


def _register_votes() -> None:
    names = {"vote-sc": "vote_sc", "max": "vote_max", "vote-sum": "vote_sum", "vote-mean": "vote_mean", "sc": "sc"}
    for method, (op, _) in voting.METHODS.items():
        view, source = ("cand", V.cand) if op is None else ("cand_steps", V.cand_steps)

        def run(spark: SparkSession, d: str, method: str = method, source=source) -> DataFrame:
            return voting.vote(source(spark, d), method).select("id", "answer", rounded("weight"))

        query(names.get(method, method.replace("-", "_")), vote_sql(method), view)(run)


_register_votes()
SCALAR = ["vote-sc", "max", "vote-sum", "vote-mean"]


def _winners_sql() -> str:
    parts = []
    for m in SCALAR:
        op, rule = voting.parse_method(m)
        if rule == "max":
            parts.append(f"SELECT '{m}' AS method, id, arg_max(answer, row(CAST(score AS DOUBLE), -cand_idx)) AS answer FROM cand GROUP BY id")
        else:
            w = _W[rule].replace("(g", "(score")
            parts.append(f"SELECT '{m}' AS method, id, arg_max(answer, row(w, -p)) AS answer FROM (SELECT id, answer, {w} AS w, min(cand_idx) AS p FROM cand GROUP BY id, answer) GROUP BY id")
    return "winners AS (" + " UNION ALL ".join(parts) + ")"


_HIT = "CASE WHEN contains(lower(w.answer), lower(g.answer)) THEN 1.0::DOUBLE ELSE 0 END"


@query("vote_many", f"WITH {_winners_sql()} SELECT method, id, answer FROM winners", "cand")
def vote_many(spark, d):
    return voting.vote_many(V.cand(spark, d), SCALAR).select("method", "id", "answer")


@query("method_accuracy", f"WITH {_winners_sql()} SELECT method, round(avg({_HIT}), 6) AS acc FROM gold g JOIN winners w USING (id) GROUP BY method", "cand gold")
def method_accuracy(spark, d):
    return voting.compare_methods(V.cand(spark, d), V.gold(spark, d), SCALAR).select("method", rounded("acc"))


@query(
    "method_comparison",
    f"""WITH {_winners_sql()}, r AS (SELECT method, id % 3 AS k, {_HIT} AS hit FROM gold g JOIN winners w USING (id)),
        s AS (SELECT method, 100 * avg(hit) FILTER (k = 0) AS d0, 100 * avg(hit) FILTER (k = 1) AS d1, 100 * avg(hit) FILTER (k = 2) AS d2 FROM r GROUP BY method)
        SELECT method, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2, round((d0 + d1 + d2) / 3, 6) AS "Mean" FROM s""",
    "cand gold",
)
def method_comparison(spark, d):
    won = voting.vote_many(V.cand(spark, d), SCALAR).join(V.gold(spark, d).withColumnRenamed("answer", "gold"), "id")
    hit = F.lower("answer").contains(F.lower("gold")).cast("double")
    results = won.groupBy("method", F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dataset")).agg(F.avg(hit).alias("acc"))
    wide = voting.comparison_table(results, ["d0", "d1", "d2"])
    return wide.select("method", *[rounded(c) for c in ("d0", "d1", "d2", "Mean")])


@query(
    "select_best_output",
    """WITH scored AS (SELECT id, cand_idx, answer, list_avg(steps[2:]) AS g FROM cand WHERE answer <> ''),
        w AS (SELECT id, answer, CAST(sum(CAST(g AS DECIMAL(30,12))) AS DOUBLE) AS weight, min(cand_idx) AS p FROM scored GROUP BY id, answer),
        best AS (SELECT id, arg_max(answer, row(weight, -p)) AS answer FROM w GROUP BY id)
        SELECT s.id, arg_max(s.cand_idx, row(s.g, -s.cand_idx)) AS cand_idx, any_value(s.answer) AS answer, round(max(s.g), 6) AS g FROM scored s JOIN best b ON s.id = b.id AND s.answer = b.answer GROUP BY s.id""",
    "cand_steps",
)
def select_best_output(spark, d):
    return voting.select_output(V.cand_steps(spark, d), "prm-mean-vote-sum").select("id", "cand_idx", "answer", rounded("g"))


@query(
    "self_consistency",
    """WITH o AS (SELECT doc_id // 10 AS id, doc_id AS cand_idx, lower(chr(CAST(65 + doc_id % 5 AS INTEGER))) AS answer FROM documents),
        v AS (SELECT id, answer, count(*) AS n, min(cand_idx) AS p FROM o GROUP BY id, answer)
        SELECT id, arg_max(answer, row(n, -p)) AS answer, max(n) AS n FROM v GROUP BY id""",
)
def self_consistency(spark, d):
    outputs = V.qa(spark, d).select(F.expr("doc_id div 10").alias("id"), F.col("doc_id").alias("cand_idx"), "text")
    return voting.self_consistency(outputs).select("id", "answer", "n")


@query(
    "rescore",
    """WITH o AS (SELECT doc_id // 10 AS id, doc_id AS cand_idx, chr(CAST(65 + doc_id % 5 AS INTEGER)) AS answer, CAST(strlen(text) % 101 AS DOUBLE) AS g FROM qa)
        SELECT id, arg_max(cand_idx, row(g, -cand_idx)) AS cand_idx, arg_max(answer, row(g, -cand_idx)) AS answer FROM o GROUP BY id""",
    "qa",
)
def rescore(spark, d):
    outputs = V.qa(spark, d).select(F.expr("doc_id div 10").alias("id"), F.col("doc_id").alias("cand_idx"), "text")
    stub = lambda t: F.array(F.lit(1.0), (F.octet_length(t) % 101).cast("double"))
    return voting.rescore(outputs, stub, "prm-max").select("id", "cand_idx", "answer")


@query(
    "pass_at_k",
    """WITH c AS (SELECT c.id, count(*) AS n, count(*) FILTER (c.answer = g.answer) AS k FROM cand c JOIN gold g USING (id) GROUP BY c.id)
        SELECT id, round(CAST(k AS DOUBLE) / n, 6) AS pass1, CASE WHEN n < 2 THEN 0.0 WHEN n - k < 2 THEN 1.0 ELSE round(1 - CAST(n - k AS DOUBLE) * (n - k - 1) / (CAST(n AS DOUBLE) * (n - 1)), 6) END AS pass2 FROM c""",
    "cand gold",
)
def pass_at_k(spark, d):
    hit = F.count_if(F.col("answer") == F.col("gold"))
    c = V.cand(spark, d).join(V.gold(spark, d).withColumnRenamed("answer", "gold"), "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), hit.alias("k"))
    return c.select("id", F.round(M.pass_at_k("n", "k", 1), 6).alias("pass1"), F.round(M.pass_at_k("n", "k", 2), 6).alias("pass2"))


# Text ----------------------------------------------------------------------------------------

_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_TEMPLATE = "trim(" + _TRIM.format(x=r"regexp_extract_all(text, '(?i)The answer is(.*)(?:\.|\n?$)', 1)[-1]") + ", '.')"


@query("extract_template", f"SELECT doc_id, {_TEMPLATE} AS answer FROM qa", "qa")
def extract_template(spark, d):
    return V.qa(spark, d).select("doc_id", T.extract_template("text").alias("answer"))


@query("extract_sentence", "SELECT doc_id, chr(CAST(65 + doc_id % 5 AS INTEGER)) || ' or ' || source AS answer FROM documents")
def extract_sentence(spark, d):
    said = F.concat(F.regexp_replace("text", r"\.\z", ""), F.lit(" or "), F.col("source"))
    return V.qa(spark, d).select("doc_id", T.extract_sentence(said).alias("answer"))


@query(
    "extract_answer_bench",
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(CAST(65 + doc_id % 5 AS INTEGER)) WHEN 1 THEN string_split(text, chr(10))[-1] || CASE WHEN text LIKE '%.' THEN '' ELSE '.' END ELSE source || '.' END AS answer FROM documents""",
)
def extract_answer_bench(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source", "text")
    k = F.col("doc_id") % 3
    thought = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\nso\nAnswer: "), F.col("source"))
    said = F.concat(F.col("text"), F.lit("\nThe answer is "), F.char(F.lit(65) + F.col("doc_id") % 5), F.lit("."))
    return docs.select("doc_id", T.extract_answer(F.when(k == 0, said).when(k == 1, F.col("text")).otherwise(thought)).alias("answer"))


@query("extract_answer_tag", "SELECT doc_id, source AS answer FROM documents")
def extract_answer_tag(spark, d):
    tagged = F.concat(F.lit("<answer>no</answer>"), F.col("text"), F.lit("<answer id=1> "), F.col("source"), F.lit("\n</answer>"))
    return V.table(spark, d, "documents").select("doc_id", T.extract_tagged(tagged).alias("answer"))


@query("first_char_of_answer", f"SELECT doc_id, substring({_TEMPLATE}, 1, 1) AS answer FROM qa", "qa")
def first_char_of_answer(spark, d):
    return V.qa(spark, d).select("doc_id", T.first_char_of_answer("text").alias("answer"))


@query("fenced_blocks", "SELECT doc_id, [trim(text, chr(10)), lang] AS blocks FROM documents")
def fenced_blocks(spark, d):
    text = F.concat(F.lit("see ```\n"), F.col("text"), F.lit("\n``` or ```"), F.col("lang"), F.lit("``` end"))
    return V.table(spark, d, "documents").select("doc_id", T.fenced_blocks(text).alias("blocks"))


@query("cut_calculation", "SELECT doc_id, string_split(string_split(text, 'However')[1], '(')[1] AS answer FROM (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN lang || ' (x) ' || text ELSE source || 'However (' || text END AS text FROM documents)")
def cut_calculation(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(" (x) "), "text")).otherwise(F.concat("source", F.lit("However ("), "text"))
    return V.table(spark, d, "documents").select("doc_id", T.cut_calculation(text).alias("answer"))


@query(
    "plain_answer",
    r"""WITH c AS (SELECT doc_id, regexp_replace(string_split(string_split(string_split(text, chr(10))[1], '.')[1], ',')[1], '[^\p{L}\p{M}\p{N}_\s]', '', 'g') AS x FROM documents)
        SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(x, '\s+', ' ', 'g'), ' '), lambda w: w <> '' AND lower(w) NOT IN ('a', 'an', 'the')), ' ') AS answer FROM c""",
)
def plain_answer(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.plain_answer("text").alias("answer"))


@query("thousands", "SELECT o_orderkey, format('{:,}', (o_orderkey - 5000) * 1234567) AS text FROM orders")
def thousands(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", T.thousands(((F.col("o_orderkey") - 5000) * 1234567).cast("string")).alias("text"))


@query("trim_zeros", "SELECT o_orderkey, CAST(o_orderkey // 10 AS VARCHAR) || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '.' || o_orderkey % 10 END AS text FROM orders")
def trim_zeros(spark, d):
    n = F.concat(F.expr("o_orderkey div 10").cast("string"), F.lit("."), (F.col("o_orderkey") % 10).cast("string"), F.lit("00"))
    return V.table(spark, d, "orders").select("o_orderkey", T.trim_zeros(n).alias("text"))


@query("latex_normalize", r"SELECT p_partkey, '\frac{' || p_size % 10 || '}{' || (p_size + 1) % 10 || '}+\sqrt{' || p_size % 7 || '}' AS text FROM part")
def latex_normalize(spark, d):
    s = F.col("p_size")
    text = F.concat(F.lit("$ x=\\dfrac"), (s % 10).cast("string"), ((s + 1) % 10).cast("string"), F.lit(" plus \\sqrt"), (s % 7).cast("string"), F.lit("^\\circ\\text{ cm}$"))
    return V.table(spark, d, "part").select("p_partkey", T.latex(F.regexp_replace(text, r"\$ x", "\\$x")).alias("text"))


@query(
    "clean_units",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size || '/100' WHEN 1 THEN p_size || '*3.14' WHEN 2 THEN '3.14+' || p_size ELSE '}π ' || p_size END AS a FROM part""",
)
def clean_units(spark, d):
    s = F.col("p_size").cast("string")
    k = F.col("p_size") % 4
    shapes = F.when(k == 0, F.concat(F.lit("$"), s, F.lit("%"))).when(k == 1, F.concat(s, F.lit("\\pi°C"))).when(k == 2, F.concat(F.lit("π+"), s, F.lit("° C")))
    return V.table(spark, d, "part").select("p_partkey", T.clean_units(shapes.otherwise(F.concat(F.lit("}π "), s, F.lit("¥")))).alias("a"))


@query("options", "SELECT doc_id, [source, lang, 'x', 'y'] AS options FROM documents")
def options(spark, d):
    text = F.concat(F.lit("Which? Answer Choices: (A) "), "source", F.lit(" (B)"), "lang", F.lit(" (C) x (D) y Let's think"))
    return V.table(spark, d, "documents").select("doc_id", T.options(text).alias("options"))


_CHAIN = "chain AS (SELECT traj, list(text ORDER BY idx) AS texts, string_agg('Step ' || idx || ': ' || text, chr(10) || chr(10) ORDER BY idx) AS path FROM steps GROUP BY traj)"


def _chains(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return V.steps(spark, d).groupBy("traj").agg(ordered.alias("s")).select("traj", F.col("s.text").alias("texts"))


@query("path_text", f"WITH {_CHAIN} SELECT traj, path AS text FROM chain", "steps")
def path_text(spark, d):
    return _chains(spark, d).select("traj", T.path_text("texts").alias("text"))


@query(
    "split_steps",
    f"""WITH {_CHAIN}, p AS (SELECT traj, string_split(path, chr(10) || chr(10) || 'Step') AS parts FROM chain), q AS (SELECT traj, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS idx FROM p)
        SELECT traj, CAST(idx AS INTEGER) AS idx, CASE WHEN x LIKE 'Step%' THEN x ELSE 'Step' || x END AS text FROM q""",
    "steps",
)
def split_steps(spark, d):
    return _chains(spark, d).select("traj", F.posexplode(T.split_steps(T.path_text("texts"))).alias("idx", "text"))


@query(
    "prefix_steps",
    f"""WITH {_CHAIN}, q AS (SELECT traj, texts, generate_subscripts(texts, 1) AS k FROM chain)
        SELECT traj, CAST(k - 1 AS INTEGER) AS idx, array_to_string(texts[1:k], chr(10) || chr(10)) || chr(10) || chr(10) AS text FROM q""",
    "steps",
)
def prefix_steps(spark, d):
    return _chains(spark, d).select("traj", F.posexplode(T.prefix_steps("texts")).alias("idx", "text"))


@query(
    "finish_steps",
    f"""WITH t AS (SELECT traj, 'Go. ' || string_agg('Step ' || (idx + 1) || ': ' || text || chr(10), '' ORDER BY idx) AS t FROM steps GROUP BY traj), p AS (SELECT traj, string_split(t, 'Step') AS p FROM t)
        SELECT traj, list_concat(p[1:1], list_transform(p[2:], lambda x: substr(x, 5))) AS texts FROM p""",
    "steps",
)
def finish_steps(spark, d):
    # Words that begin with "Step" and numbers of two digits are cut like any other.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x["text"], F.lit("\n")))
    said = V.steps(spark, d).groupBy("traj").agg(F.concat(F.lit("Go. "), F.array_join(lines, "")).alias("t"))
    return said.select("traj", T.finish_steps("t").alias("texts"))


@query("cut_second_answer", "SELECT doc_id, text || chr(10) AS text FROM qa", "qa")
def cut_second_answer(spark, d):
    q = V.qa(spark, d)
    return q.select("doc_id", T.cut_second_answer(F.concat("text", F.lit("\nThe answer is not it."))).alias("text"))


@query("step_text", r"SELECT doc_id, rtrim(regexp_replace(text, '^\s+|\s+$', '', 'g'), '.') || '.' AS text FROM documents")
def step_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.step_text("text").alias("text"))


@query(
    "reflection",
    r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || '<problem> x' WHEN 2 THEN chr(10) || chr(10) || '<steps> y' WHEN 3 THEN chr(10) || chr(10) || 'Step 9: z' ELSE chr(10) || chr(10) || '<step> w' END AS t FROM documents)
        SELECT doc_id, 'But wait, ' || regexp_extract(t, '(?s)^(.*?)(\n\n(<problem>|<steps>|Step|<step>).*)?$', 1) AS text FROM t""",
)
def reflection(spark, d):
    tails = ["", "\n\n<problem> x", "\n\n<steps> y", "\n\nStep 9: z", "\n\n<step> w"]
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (F.col("doc_id") % 5 + 1).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", T.reflection(F.concat("text", tail)).alias("text"))


@query(
    "plans",
    r"""WITH t AS (SELECT doc_id, source || chr(10) || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Plan 1: 1. ' || source || chr(10) || chr(10) || '2. no' WHEN 1 THEN 'So. Plan 2: first 1. ' || lang || chr(10) || chr(10) || '1. bare' WHEN 2 THEN 'Plan 12: 1. lost' ELSE 'Plan 3: none' END || chr(10) || chr(10) || text AS t FROM documents),
        p AS (SELECT doc_id, list_transform(string_split(t, chr(10) || chr(10)), lambda x: CASE WHEN regexp_matches(x, 'Plan [0-9]+:') THEN regexp_extract(x, '(?s)Plan [0-9]([0-9]*:.*)$', 1) ELSE NULL END) AS tails, string_split(t, chr(10) || chr(10)) AS ps FROM t),
        b AS (SELECT doc_id, list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN tails[i] IS NULL THEN ps[i] ELSE regexp_extract(tails[i], '(?s)[0-9].*$', 0) END) AS bodies FROM p)
        SELECT doc_id, list_transform(list_filter(bodies, lambda x: starts_with(x, '1.')), lambda x: 'Decompose the problem into smaller, solvable sub-problems: ' || x) AS plans FROM b""",
)
def plans(spark, d):
    k = F.col("doc_id") % 4
    middle = F.when(k == 0, F.concat(F.lit("Plan 1: 1. "), "source", F.lit("\n\n2. no"))).when(k == 1, F.concat(F.lit("So. Plan 2: first 1. "), "lang", F.lit("\n\n1. bare")))
    middle = middle.when(k == 2, "Plan 12: 1. lost").otherwise("Plan 3: none")
    text = F.concat_ws("\n\n", "source", middle, "text")
    return V.table(spark, d, "documents").select("doc_id", T.plans(text).alias("plans"))


@query("append_answer", "SELECT doc_id, text || CASE WHEN text LIKE '%.' THEN ' ' ELSE '. ' END || 'The answer is ' || source || '.' AS text FROM documents")
def append_answer(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.append_answer("text", "source").alias("text"))


@query("cut_trace", "SELECT doc_id, text || chr(10) || 'The answer is ' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || '.' AS text FROM documents")
def cut_trace(spark, d):
    return V.qa(spark, d).select("doc_id", T.cut_trace(F.concat("text", F.lit(" More."))).alias("text"))


@query(
    "rule_filter",
    """WITH p AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS ps FROM chatter)
        SELECT doc_id, CASE WHEN contains(text, 'I hope') THEN array_to_string(ps[1:len(ps) - 1], chr(10) || chr(10)) WHEN text LIKE 'Here is%' OR text LIKE 'Based on%' OR text LIKE 'Here''s%' OR contains(text, 'I''m')
            OR contains(text, 'I''d like') OR contains(text, 'I''d be') OR contains(text, 'I would') THEN array_to_string(ps[2:], chr(10) || chr(10)) ELSE text END AS text FROM p""",
    "chatter",
)
def rule_filter(spark, d):
    return V.chatter(spark, d).select("doc_id", T.drop_chatter("text").alias("text"))


@query("simple_filter", "SELECT doc_id FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' Version 2' ELSE '' END AS text FROM documents) WHERE NOT (contains(lower(text), 'to create') OR contains(lower(text), 'version') OR contains(lower(text), 'here''s'))")
def simple_filter(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " Version 2").otherwise(""))
    return V.table(spark, d, "documents").filter(T.is_plain_generation(text)).select("doc_id")


@query(
    "drop_markers",
    r"""WITH t AS (SELECT doc_id, text, doc_id % 3 AS k FROM documents), s AS (SELECT doc_id, regexp_replace(CASE k WHEN 2 THEN 'Sure. ' || text ELSE ': ' || text || ' :' END, '^\s+|\s+$', '', 'g') AS t FROM t)
        SELECT doc_id, regexp_replace(trim(t, ':'), '^\s+|\s+$', '', 'g') AS text FROM s""",
)
def drop_markers(spark, d):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("Sure. #Rewritten Prompt#: "), "text", F.lit(" :"))).when(k == 1, F.concat(F.lit("#Given# a #Created Prompt#: "), "text", F.lit(" :"))).otherwise(F.concat(F.lit("Sure. "), "text"))
    return V.table(spark, d, "documents").select("doc_id", T.drop_markers(text).alias("text"))


@query("first_acceptable", "SELECT doc_id // 10 AS id, arg_min(doc_id, doc_id) AS doc_id FROM documents WHERE doc_id % 5 <> 0 AND NOT (contains(lower(text), 'to create') OR contains(lower(text), 'version') OR contains(lower(text), 'here''s')) GROUP BY 1")
def first_acceptable(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " Version 2").otherwise("")).alias("text")
    outputs = V.table(spark, d, "documents").select(F.expr("doc_id div 10").alias("id"), "doc_id", text)
    return T.first_acceptable(outputs, ["id"], "doc_id").select("id", "doc_id")


@query("standard_output", "SELECT id, max(cand_idx) AS cand_idx, 'none' AS form FROM cand WHERE answer NOT IN ('view', 'error') GROUP BY id UNION ALL SELECT id, max(cand_idx), 'all' FROM cand WHERE answer IN ('view') GROUP BY id", "cand")
def standard_output(spark, d):
    c = V.cand(spark, d).withColumnRenamed("answer", "text")
    none = T.standard_output(c, ["id"], "cand_idx", ["view", "error"]).select("id", "cand_idx", F.lit("none").alias("form"))
    return none.unionByName(T.standard_output(c, ["id"], "cand_idx", ["vi", "ew"], all_words=True).select("id", "cand_idx", F.lit("all").alias("form")))


@query("fill_prompt", "SELECT doc_id, 'Rewrite [' || text || '] in ' || lang || '.' AS prompt FROM documents")
def fill_prompt(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.fill("Rewrite [{a}] in {b}.", a="text", b="lang").alias("prompt"))


@query(
    "accept_response",
    """SELECT doc_id, 'Because.' || chr(10) || chr(10) || 'The answer is ' || chr(CAST(65 + doc_id % 4 AS INTEGER)) || '.' AS response FROM documents WHERE doc_id % 7 IN (0, 1, 2, 3, 4)""",
)
def accept_response(spark, d):
    k = F.col("doc_id") % 7
    idx = F.char(F.lit(65) + F.col("doc_id") % 4)
    # The letter; letter and text; all words of the gold text; a part of it; peeled; another text; another letter.
    said = F.when(k == 0, idx).when(k == 1, F.concat(idx, F.lit(". zzz"))).when(k == 2, "TWO and one").when(k == 3, "wo").when(k == 4, F.concat(F.lit("{{"), idx, F.lit("}}"))).when(k == 5, "zzz").otherwise("X")
    name = F.when(k % 3 == 0, "correct answer").when(k % 3 == 1, "final answer").otherwise("answer")
    response = F.concat(F.lit("Because.\n\nThe "), name, F.lit(" is "), said, F.lit(".\n"))
    out = T.accept_response(response, idx, F.lit("one two"))
    return V.table(spark, d, "documents").select("doc_id", out.alias("response")).filter("response is not null")


@query("few_shot", "SELECT doc_id, 'Problem: q' || chr(10) || chr(10) || 'Response: r' || chr(10) || chr(10) || 'Problem: s' || chr(10) || chr(10) || 'Response: t' || chr(10) || chr(10) || 'Problem: ' || text || chr(10) || chr(10) || 'Response: ' AS prompt FROM documents")
def few_shot(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.few_shot("text", [("q", "r"), ("s", "t")]).alias("prompt"))


@query(
    "task_suffix",
    """WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'winogrande' WHEN 2 THEN 'PLE_TCM_cot' WHEN 3 THEN 'math_500' ELSE source END AS name FROM documents)
        SELECT doc_id, CASE name WHEN 'gsm8k' THEN chr(10) || chr(10) || 'Please format the final answer at the end of the response as: The answer is {answer}.' WHEN 'winogrande' THEN chr(10) || chr(10) || 'Please answer with option letter directly, do not output other infomation.'
            WHEN 'PLE_TCM_cot' THEN chr(10) || chr(10) || '请在回答的最后用以下格式回答：答案为{answer}。' WHEN 'math_500' THEN chr(10) || chr(10) || 'Please format the final answer at the end of the response as:  The answer is {answer}.' ELSE '' END AS suffix FROM n""",
)
def task_suffix(spark, d):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "gsm8k").when(k == 1, "winogrande").when(k == 2, "PLE_TCM_cot").when(k == 3, "math_500").otherwise(F.col("source"))
    return V.table(spark, d, "documents").select("doc_id", T.task_suffix(name).alias("suffix"))


@query("names_of_path", "SELECT doc_id, source AS dataset, 'm-checkpoint-' || lang AS model FROM documents")
def names_of_path(spark, d):
    path = F.concat(F.lit("/a/MedQA/"), "source", F.lit(".jsonl"))
    model = F.concat(F.lit("x/m/checkpoint-"), "lang")
    return V.table(spark, d, "documents").select("doc_id", T.dataset_of(path, ["MedQA", *[f"src{i}" for i in range(100)]]).alias("dataset"), T.model_of(model).alias("model"))


@query("chat_prompt", "SELECT doc_id, '<|system|>' || chr(10) || 's' || chr(10) || '<|user|>' || chr(10) || text || chr(10) AS text FROM documents")
def chat_prompt(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.render_chat(T.chat_prompt("text", F.lit("s"))).alias("text"))


@query("answer_end", "SELECT doc_id, CAST(length(text) + 22 AS INTEGER) AS pos FROM documents")
def answer_end(spark, d):
    text = F.concat("text", F.lit("\nThe answer is kept.\n\nso"))
    return V.table(spark, d, "documents").select("doc_id", T.answer_end(text).cast("int").alias("pos"))


# Metrics -------------------------------------------------------------------------------------

_ACC = "CAST(chr(CAST(65 + doc_id % 5 AS INTEGER)) = gold AS INTEGER)"


def _metric(name: str, rule, sql: str | None = None) -> None:
    @query(name, f"SELECT doc_id, {sql or _ACC} AS acc FROM qa", "qa")
    def run(spark, d):
        return V.qa(spark, d).select("doc_id", rule(F.col("text"), F.col("gold")).alias("acc"))


_metric("acc_score", lambda t, g: M.choice_or_substring(g, T.extract_template(t)))
_metric("node_correct", lambda t, g: M.node_value(g, t))
_metric("multiple_choice", M.multiple_choice)
_metric("medical_text", M.medical_text)
_metric("equal_or_extracted", M.equal_or_extracted)
_metric("medical_substring", M.medical_substring)
_metric("letter_with_period", M.letter_with_period)
_metric("letter_in_sentence", M.letter_in_sentence)
_metric("number_substring", lambda t, g: M.number_substring(t, F.concat(F.lit("so #### "), g), marked=True))
_metric("logic_english", M.logic_english)
_metric("mutual_substring", M.mutual_substring)
_metric("any_of", lambda t, g: M.any_of(t, F.array(g, F.lit("zz"))))
_metric("bracketed_letter", lambda t, g: M.bracketed_letter(F.concat(F.lit("It is ("), T.extract_template(t), F.lit(")")), F.concat(F.lit("("), g, F.lit(")"))))
_metric("logic_chinese", lambda t, g: M.logic_chinese(F.concat(F.lit("答案是 ("), T.extract_template(t), F.lit(")。")), g))
_metric("option_set", lambda t, g: M.option_set(F.concat(F.lit("答案为"), T.extract_template(t)), g))
_metric("equal_without_period", lambda t, g: M.equal_without_period(F.concat(T.extract_template(t), F.lit(".")), g))
_metric("exact", lambda t, g: M.equal(T.extract_template(t), g))
_metric("alias_match", lambda t, g: M.alias_match(T.extract_template(t), F.array(g, F.lit("zz"))))
_metric("first_letter", lambda t, g: M.first_letter(F.concat(F.lit("xyz "), T.extract_template(t)), g))
_metric("judged", lambda t, g: M.judged(M.equal(T.extract_template(t), g), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("0")), f"CASE WHEN {_ACC} = 1 OR doc_id % 2 = 0 THEN 1 ELSE 0 END")
_metric("compare_answer", lambda t, g: M.compare_answer(F.concat(F.lit("\\text{"), T.extract_template(t), F.lit("}")), g))


@query("metric_by_name", f"SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2, 5) THEN {_ACC} WHEN doc_id % 6 = 3 THEN CASE WHEN doc_id % 10 BETWEEN 3 AND 6 THEN 1 ELSE 0 END END AS acc FROM qa", "qa")
def metric_by_name(spark, d):
    k = F.col("doc_id") % 6
    name = F.element_at(F.array(*[F.lit(n) for n in ("MedQA", "seer", "medexpert", "medcalc", "unknown", "rds")]), (k + 1).cast("int"))
    text = F.when(k == 3, F.concat(F.lit("Sum up.\nThe answer is "), (F.col("doc_id") % 10).cast("string"), F.lit("."))).otherwise(F.col("text"))
    acc = M.metric_by_name(name, text, "gold", limits=(F.lit(2), F.lit("3"), F.lit("6.5")))
    return V.qa(spark, d).select("doc_id", acc.alias("acc"))


@query(
    "score_once",
    f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CAST(gold = 'C' AS INTEGER) ELSE {_ACC} END::DOUBLE AS score, doc_id % 7 = 0 AS fresh FROM qa",
    "qa",
)
def score_once(spark, d):
    """Two runs over all outputs; in the second every seventh has another answer, and only these are scored again."""
    rows, path = V.qa(spark, d), shared_folder(spark, "scores")
    rule = lambda t, g: M.choice_or_substring(g, T.extract_template(t))
    kept_scores.score(rows, path, "choice", "1", rule)
    said = F.concat("text", F.lit("\nOn second thoughts, "), F.col("doc_id").cast("string"), F.lit(". The answer is C."))
    rows = rows.withColumn("text", F.when(F.col("doc_id") % 7 == 0, said).otherwise(F.col("text")))
    return kept_scores.score(rows, path, "choice", "1", rule).select("doc_id", "score", "fresh")


@query(
    "exact_metrics",
    f"""SELECT doc_id, CASE WHEN doc_id % 17 < 2 THEN CAST(regexp_extract(text, '[A-E]') = gold AS INTEGER) WHEN doc_id % 17 < 16 THEN {_ACC} END AS acc FROM qa""",
    "qa",
)
def exact_metrics(spark, d):
    """Each data set's exact-match rule by its name, on whole outputs; a name that isn't known has none."""
    names = [*M.EXACT_METRICS, "unknown"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    # Chinese outputs name their letters behind other words.
    text = F.when(name == "cmmlu", F.concat(F.lit("答案为"), T.extract_template("text"))).otherwise(F.col("text"))
    return V.qa(spark, d).select("doc_id", M.metric_by_name(name, text, "gold", metrics=M.EXACT_METRICS).alias("acc"))


_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 6 AS shape, l_partkey % 12 + 1 AS a, l_suppkey % 9 + 1 AS b, CAST(l_quantity AS BIGINT) % 24 + 1 AS c, l_partkey % 8 + 1 AS e FROM lineitem"


@query(
    "symbolic_equal",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE shape WHEN 0 THEN (a + 1) * e = b * c WHEN 1 THEN c - 1 = a WHEN 2 THEN a * b = c WHEN 3 THEN a * e = b * c WHEN 4 THEN a * b = c ELSE a = c END AS equal FROM ({_LINE})""",
)
def symbolic_equal(spark, d):
    """Pairs of expressions of six shapes, equal in value or not."""
    lines = V.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_linenumber % 6 AS shape", *[f"CAST({x} AS BIGINT) AS {n}" for n, x in _NUMBERS.items()])
    fill = lambda template: T.fill(template, a="a", b="b", c="c", e="e", cb=F.col("c") - 1 - F.col("b"), cp=(F.col("c") - 1) * F.col("b"))
    pairs = [
        (r"\frac{{{a}x}}{{{b}}}+\frac{{x}}{{{b}}}", r"\dfrac{{{c}x}}{{{e}}}"),
        ("(x+{a})(x-{b})", "x^2+{cb}x-{cp}"),
        (r"\sqrt{{{a}}} \cdot \sqrt{{{b}}}", r"\sqrt{{{c}}}"),
        (r"\frac{{{a}}}{{{b}}}", "{c}/{e}"),
        (r"{b} \times {a}(x+y)^2", "{c}x^2+{c}y^2+2*{c}xy"),
        ("answer number {a}", "answer number {c}"),
    ]
    # Of the shapes only a row's own is filled in.
    side = lambda k: F.coalesce(*[F.when(F.col("shape") == i, fill(p[k])) for i, p in enumerate(pairs)])
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", S.equal_in_value(side(0), side(1)).alias("equal"))


_NUMBERS = {"a": "l_partkey % 12 + 1", "b": "l_suppkey % 9 + 1", "c": "CAST(l_quantity AS BIGINT) % 24 + 1", "e": "l_partkey % 8 + 1"}


@query(
    "value_votes",
    r"""WITH c AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS cand_idx,
            l_suppkey % 3 + 1 AS v, CASE l_partkey % 3 WHEN 0 THEN '\frac{' || (l_suppkey % 3 + 1) || '}{2}' WHEN 1 THEN CAST((l_suppkey % 3 + 1) / 2 AS VARCHAR) ELSE '\frac{' || (l_suppkey % 3 + 1) || 'x}{2x}' END AS answer FROM lineitem),
        v AS (SELECT id, v, count(*) AS n, min(cand_idx) AS p, arg_min(answer, cand_idx) AS answer FROM c GROUP BY id, v)
        SELECT id, arg_max(answer, row(n, -p)) AS answer, CAST(max(n) AS DOUBLE) AS weight FROM v GROUP BY id""",
)
def value_votes(spark, d):
    """Answers spelled as quotients, decimals and with a factor that cancels vote by value."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(*V.STEP_ORDER)
    v = F.col("l_suppkey") % 3 + 1
    spelled = F.element_at(
        F.array(T.fill(r"\frac{{{v}}}{{2}}", v=v), (v / 2).cast("double").cast("string"), T.fill(r"\frac{{{v}x}}{{2x}}", v=v)), (F.col("l_partkey") % 3 + 1).cast("int")
    )
    cand = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.row_number().over(order) - 1).alias("cand_idx"), spelled.alias("answer"), F.lit(1.0).alias("score"))
    return voting.vote_by_value(cand, "sc").select("id", "answer", "weight")


@query(
    "token_f1",
    r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(string_split(string_split(string_split(text, chr(10))[1], '.')[1], ',')[1], '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), ' '),
            lambda x: x <> '' AND lower(x) NOT IN ('a', 'an', 'the')) AS ws FROM conversations),
        p AS (SELECT a.conv_id, a.turn, a.ws AS a, b.ws AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
        s AS (SELECT conv_id, turn, a, b, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS same FROM p)
        SELECT conv_id, turn, CASE WHEN same = 0 THEN 0.0 ELSE round(2.0 * CAST(same AS DOUBLE) / (len(a) + len(b)), 6) END AS f1 FROM s""",
)
def token_f1(spark, d):
    """Each turn with the next one."""
    c = V.table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(M.best_token_f1("a", F.array("b")), 6).alias("f1"))


@query(
    "ngram_recall",
    r"""WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS ws, string_split_regex(lang || ' ' || string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1], '\s+') AS gs FROM documents),
        g AS (SELECT doc_id, list_distinct(ws) AS a, list_distinct(gs) AS b FROM w)
        SELECT doc_id, round(CAST(len(list_intersect(b, a)) AS DOUBLE) / len(b), 6) AS recall FROM g""",
)
def ngram_recall(spark, d):
    gold = F.concat("lang", F.lit(" "), F.element_at(F.split(T.strip("text"), r"\s+"), 1))
    return V.table(spark, d, "documents").select("doc_id", F.round(M.ngram_recall("text", gold, 1), 6).alias("recall"))


@query(
    "within",
    """WITH g AS (SELECT o_orderkey, o_totalprice AS p, CASE WHEN o_orderkey % 3 = 0 THEN round_even(o_totalprice, 0) + o_orderkey % 2 ELSE o_totalprice + o_orderkey % 7000 END AS g FROM orders)
        SELECT o_orderkey, CASE WHEN g = floor(g) THEN CASE WHEN round_even(p, 0) = g THEN 1 ELSE 0 END WHEN abs(p - g) <= abs(g) * 0.04 THEN 1 ELSE 0 END AS acc FROM g""",
)
def within(spark, d):
    g = F.when(F.col("o_orderkey") % 3 == 0, F.bround("o_totalprice", 0) + F.col("o_orderkey") % 2).otherwise(F.col("o_totalprice") + F.col("o_orderkey") % 7000)
    return V.table(spark, d, "orders").select("o_orderkey", M.within("o_totalprice", g).alias("acc"))


@query("list_within", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS acc FROM orders")
def list_within(spark, d):
    a = F.array(F.lit(2.5), F.lit(1.25), F.col("o_totalprice"))
    b = F.array(F.col("o_totalprice"), F.lit(1.25), F.when(F.col("o_orderkey") % 2 == 0, 2.5).otherwise(-99.5))
    return V.table(spark, d, "orders").select("o_orderkey", M.list_within(a, b).alias("acc"))


@query("score_summary", f"SELECT source, round(avg(CAST({_ACC} AS DOUBLE)), 6) AS acc, count(*) AS n FROM qa GROUP BY source", "qa")
def score_summary(spark, d):
    rows = voting.score_rows(V.qa(spark, d), M.multiple_choice("text", "gold"))
    return voting.score_summary(rows, ["source"]).select("source", rounded("acc"), "n")


@query("wrong_rows", f"SELECT doc_id FROM qa WHERE {_ACC} = 0", "qa")
def wrong_rows(spark, d):
    return voting.wrong_rows(voting.score_rows(V.qa(spark, d), M.multiple_choice("text", "gold"))).select("doc_id")


@query(
    "candidate_pass",
    "WITH c AS (SELECT doc_id // 10 AS id, count(*) AS n, count(*) FILTER (chr(CAST(65 + doc_id % 5 AS INTEGER)) = 'A') AS k FROM documents GROUP BY 1) SELECT id, round(CAST(k AS DOUBLE) / n, 6) AS pass1, CASE WHEN n < 2 THEN 0.0 WHEN n - k < 2 THEN 1.0 ELSE round(1 - CAST((n - k) * (n - k - 1) AS DOUBLE) / (n * (n - 1)), 6) END AS pass2 FROM c",
)
def candidate_pass(spark, d):
    texts = V.qa(spark, d).groupBy(F.expr("doc_id div 10").alias("id")).agg(F.collect_list("text").alias("texts"))
    ks = texts.select("id", M.pass_at("texts", F.lit("A")).alias("p"))
    return ks.select("id", F.round(F.get("p", F.lit(0)), 6).alias("pass1"), F.round(F.get("p", F.lit(1)), 6).alias("pass2"))


# Partitioning --------------------------------------------------------------------------------


@query("chunk", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // ((SELECT count(*) + 6 FROM orders) // 7) AS BIGINT) AS chunk FROM orders")
def chunk(spark, d):
    return part.split_chunks(V.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7).select("o_orderkey", "chunk")


@query("get_chunk", "SELECT o_orderkey FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // ((SELECT count(*) + 6 FROM orders) // 7) AS chunk FROM orders) WHERE chunk = 2")
def get_chunk(spark, d):
    return part.get_chunk(V.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7, 2).select("o_orderkey")


@query("batches", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS BIGINT) AS batch FROM orders")
def batches(spark, d):
    return part.batches(V.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 16).select("o_orderkey", "batch")


@query("head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 16")
def head(spark, d):
    return part.head(V.table(spark, d, "orders"), ["o_orderkey"], 16).select("o_orderkey")


@query("single_row", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 3")
def single_row(spark, d):
    return part.single_row(V.table(spark, d, "orders"), ["o_orderkey"], 3).select("o_orderkey")


@query("resume_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def resume_anti(spark, d):
    done = V.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return part.resume(V.table(spark, d, "customer"), done, "c_custkey").select("c_custkey")


@query("resume_watermark", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'O')")
def resume_watermark(spark, d):
    o = V.table(spark, d, "orders").withColumn("id", F.concat(F.lit("q_"), F.col("o_orderkey").cast("string")))
    return part.resume_after(o, o.filter("o_orderkey % 3 = 0 and o_orderstatus = 'O'")).select("o_orderkey")


@query("test_split", "SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) <= CAST(floor((SELECT count(*) FROM orders) * 0.01) AS BIGINT) AS is_test FROM orders")
def test_split(spark, d):
    return part.test_split(V.table(spark, d, "orders").select("o_orderkey"), (F.col("o_orderkey") * 7919) % 10007, ["o_orderkey"], 0.01).select("o_orderkey", "is_test")


@query("first_n", "SELECT id, cand_idx FROM (SELECT id, cand_idx, row_number() OVER (PARTITION BY id ORDER BY cand_idx) AS k FROM cand WHERE answer <> '') WHERE k <= 5", "cand")
def first_n(spark, d):
    return part.first_answers(V.cand(spark, d), 5).select("id", "cand_idx")


@query("topk_value", "SELECT traj, idx, CAST(rank AS INTEGER) AS rank FROM (SELECT traj, idx, row_number() OVER (PARTITION BY traj ORDER BY v DESC, idx) AS rank FROM steps) WHERE rank <= 2", "steps")
def topk_value(spark, d):
    return part.top_k(V.steps(spark, d), ["traj"], "v", "idx", 2).select("traj", "idx", "rank")


@query(
    "topk_conditional",
    "SELECT traj, idx FROM (SELECT traj, idx, count(*) FILTER (v < 0.2) OVER (PARTITION BY traj) AS neg, row_number() OVER (PARTITION BY traj ORDER BY v DESC, idx) AS rank FROM steps) WHERE neg > 0 OR rank <= 2",
    "steps",
)
def topk_conditional(spark, d):
    from pyspark.sql import Window as W

    s = V.steps(spark, d).withColumn("neg", F.sum(F.when(F.col("v") < 0.2, 1).otherwise(0)).over(W.partitionBy("traj")))
    return part.top_k_unless_negative(s, ["traj"], "v", "idx", 2, "neg").select("traj", "idx")


@query(
    "topk_variance",
    """WITH t AS (SELECT traj, traj // 50 AS item, traj % 2 AS label, round(var_pop(v), 9) AS var FROM steps GROUP BY traj),
        r AS (SELECT *, row_number() OVER (PARTITION BY item, label ORDER BY var DESC, traj) AS rank, count(*) FILTER (label = 1) OVER (PARTITION BY item) AS n1, count(*) FILTER (label = 0) OVER (PARTITION BY item) AS n0 FROM t)
        SELECT item, label, traj, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= least(n1, n0)""",
    "steps",
)
def topk_variance(spark, d):
    t = V.steps(spark, d).groupBy("traj").agg(F.round(F.var_pop("v"), 9).alias("var")).withColumns({"item": F.expr("traj div 50"), "label": F.col("traj") % 2})
    return part.balance_classes(t, ["item"], "label", "var", "traj", -1).select("item", "label", "traj", "rank")


@query("drop_overlong", r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) <= 300")
def drop_overlong(spark, d):
    return part.drop_overlong(V.table(spark, d, "documents"), "text", 300).select("doc_id")


# Trees ---------------------------------------------------------------------------------------

_LEAF = "leaf AS (SELECT * FROM node n WHERE NOT EXISTS (SELECT 1 FROM node c WHERE c.tree_id = n.tree_id AND c.pid = n.nid))"
_UP = "up AS (SELECT tree_id, nid, nid AS anc, pid AS above, v, depth, 0 AS k FROM node UNION ALL SELECT u.tree_id, u.nid, p.nid, p.pid, p.v, p.depth, k + 1 FROM up u JOIN node p ON p.tree_id = u.tree_id AND p.nid = u.above)"
_PMIN = "pmin AS (SELECT tree_id, nid, min(CASE WHEN depth > 0 THEN v END) AS value FROM up GROUP BY tree_id, nid)"


@query("leaves", f"WITH {_LEAF} SELECT tree_id, nid, v FROM leaf", "node")
def leaves(spark, d):
    return tree.leaves(V.node(spark, d)).select("tree_id", "nid", "v")


@query("depth_size", "SELECT tree_id, max(depth) AS depth, count(*) AS nodes FROM node GROUP BY tree_id", "node")
def depth_size(spark, d):
    return tree.tree_size(V.node(spark, d))


@query("path_min", f"WITH RECURSIVE {_UP}, {_PMIN} SELECT * FROM pmin", "node")
def path_min(spark, d):
    return tree.path_min(V.node(spark, d))


@query("path_chain", f"WITH RECURSIVE {_UP} SELECT tree_id, nid, list(anc ORDER BY k DESC) AS chain FROM up GROUP BY tree_id, nid", "node")
def path_chain(spark, d):
    n = V.node(spark, d).withColumn("me", F.col("nid"))
    return tree.paths(n, ["me"]).select("tree_id", "nid", F.col("path.me").alias("chain"))


@query("diversity", f"WITH RECURSIVE {_UP} SELECT u.tree_id, u.anc AS nid, count(DISTINCT n.trace) AS value FROM up u JOIN node n ON n.tree_id = u.tree_id AND n.nid = u.nid GROUP BY u.tree_id, u.anc", "node")
def diversity(spark, d):
    return tree.diversity(V.node(spark, d))


@query("subtree_size", f"WITH RECURSIVE {_UP} SELECT tree_id, anc AS nid, count(*) AS nodes FROM up GROUP BY tree_id, anc", "node")
def subtree_size(spark, d):
    """From the intervals of a walk, as for trees of any size."""
    return intervals.intervals(V.node(spark, d)).select("tree_id", "nid", intervals.size().alias("nodes"))


@query("diversity_walk", f"WITH RECURSIVE {_UP} SELECT u.tree_id, u.anc AS nid, count(DISTINCT n.trace) AS value FROM up u JOIN node n ON n.tree_id = u.tree_id AND n.nid = u.nid GROUP BY u.tree_id, u.anc", "node")
def diversity_walk(spark, d):
    return intervals.diversity(V.node(spark, d))


@query("path_min_doubling", f"WITH RECURSIVE {_UP}, {_PMIN} SELECT * FROM pmin", "node")
def path_min_doubling(spark, d):
    return intervals.path_min(V.node(spark, d))


@query("node_depth", "SELECT tree_id, nid, depth FROM node", "node")
def node_depth(spark, d):
    return intervals.depths(V.node(spark, d))


_SCORE = """dv AS (SELECT u.tree_id, u.anc AS nid, count(DISTINCT n.trace) AS dv FROM up u JOIN node n ON n.tree_id = u.tree_id AND n.nid = u.nid GROUP BY u.tree_id, u.anc),
    sc AS (SELECT n.tree_id, n.nid, n.pid, dv * 0.5::DOUBLE + CASE WHEN n.n > 0 THEN 1.0::DOUBLE / n.n ELSE 0 END * 0.5 AS score FROM node n JOIN dv ON dv.tree_id = n.tree_id AND dv.nid = n.nid)"""


@query("node_score", f"WITH RECURSIVE {_UP}, {_SCORE} SELECT tree_id, nid, round(score, 6) AS score FROM sc", "node")
def node_score(spark, d):
    return tree.node_scores(V.node(spark, d)).select("tree_id", "nid", rounded("score"))


@query(
    "representative",
    f"""WITH RECURSIVE {_UP}, {_SCORE}, inn AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, nid) AS k, count(*) OVER (PARTITION BY tree_id) AS n
        FROM sc s WHERE pid IS NOT NULL AND EXISTS (SELECT 1 FROM node c WHERE c.tree_id = s.tree_id AND c.pid = s.nid)) SELECT tree_id, nid, round(score, 6) AS score FROM inn WHERE k <= n // 2""",
    "node",
)
def representative(spark, d):
    return tree.representative(V.node(spark, d)).select("tree_id", "nid", rounded("score"))


@query("intermediate", f"WITH {_LEAF} SELECT tree_id, nid FROM node n WHERE pid IS NOT NULL AND EXISTS (SELECT 1 FROM node c WHERE c.tree_id = n.tree_id AND c.pid = n.nid) UNION ALL SELECT tree_id, nid FROM leaf WHERE n > 0 AND type <> 'Finish'", "node")
def intermediate(spark, d):
    return tree.intermediate(V.node(spark, d)).select("tree_id", "nid")


@query("correct_leaves", f"WITH {_LEAF} SELECT tree_id, nid, correct FROM leaf WHERE correct OR type = 'Finish'", "node")
def correct_leaves(spark, d):
    n = V.node(spark, d).withColumn("path", F.col("nid"))
    return tree.answers(n, True).unionByName(tree.answers(n, False)).select("tree_id", "nid", "correct")


@query(
    "ucb_select",
    """WITH c AS (SELECT c.tree_id, c.pid AS nid, c.nid AS child, CASE WHEN c.n > 0 THEN c.v + 1.4 * sqrt(ln(p.n) / c.n) ELSE 5.0 END AS u
            FROM node c JOIN node p ON p.tree_id = c.tree_id AND p.nid = c.pid WHERE NOT ((c.type = 'Finish' AND c.correct) OR (c.completed AND NOT (c.type = 'Finish' AND c.v < 0.3))))
        SELECT tree_id, nid, arg_max(child, row(u, -child)) AS child, round(max(u), 6) AS ucb FROM c GROUP BY tree_id, nid""",
    "node",
)
def ucb_select(spark, d):
    return tree.select_child(V.node(spark, d), unvisited=5.0).select("tree_id", "nid", "child", rounded("ucb"))


def _backprop_sql(rule: str) -> str:
    new = "(n.v + m.m) / 2" if rule == "comp" else "m.m"
    parts, previous = [], "node"
    for depth in (2, 1, 0):
        mean = f"SELECT tree_id, pid, sum(v * n) / sum(n) AS m FROM {previous} WHERE depth = {depth + 1} GROUP BY tree_id, pid"
        parts.append(f"b{depth} AS (SELECT n.tree_id, n.nid, n.pid, n.depth, n.n, CASE WHEN m.m IS NULL THEN n.v ELSE {new} END AS v FROM {previous} n LEFT JOIN ({mean}) m ON m.tree_id = n.tree_id AND m.pid = n.nid)")
        previous = f"b{depth}"
    return f"WITH {', '.join(parts)} SELECT tree_id, nid, round(v, 6) AS value FROM b0"


@query("backprop_static", _backprop_sql("default"), "node")
def backprop_static(spark, d):
    return tree.back_propagate(V.node(spark, d)).select("tree_id", "nid", rounded("value"))


@query("backprop_comp", _backprop_sql("comp"), "node")
def backprop_comp(spark, d):
    return tree.back_propagate(V.node(spark, d), "comp").select("tree_id", "nid", rounded("value"))


@query("termination", f"WITH {_LEAF} SELECT tree_id, bool_and(type = 'Finish' AND completed) OR count(*) FILTER (correct) >= 4 OR (SELECT count(*) FROM node n WHERE n.tree_id = leaf.tree_id) >= 60 AS done FROM leaf GROUP BY tree_id", "node")
def termination(spark, d):
    return tree.termination(V.node(spark, d), 60, 4, 6)


@query("complete_paths", f"WITH {_LEAF} SELECT tree_id, nid FROM leaf WHERE v IN (0, 1)", "node")
def complete_paths(spark, d):
    return tree.complete_paths(V.node(spark, d)).select("tree_id", "nid")


@query("reflecting", "SELECT c.tree_id, c.nid FROM node c JOIN node p ON p.tree_id = c.tree_id AND p.nid = c.pid WHERE c.v < p.v AND c.depth > 1", "node")
def reflecting(spark, d):
    return tree.reflecting(V.node(spark, d)).select("tree_id", "nid")


@query("finish_children", f"WITH {_LEAF} SELECT tree_id, nid AS pid, depth + 1 AS depth, 'The answer is ' || step || '.' AS step FROM leaf WHERE type <> 'Finish'", "node")
def finish_children(spark, d):
    answer = F.concat(F.lit("The answer is "), "step", F.lit("."))
    return tree.finish_children(V.node(spark, d), answer).select("tree_id", "pid", "depth", "step")


@query("simulation_accuracy", "SELECT tree_id, nid, round(avg(CASE WHEN (nid * 7 + k) % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sim FROM node, range(20) r(k) WHERE k < greatest(20 // (depth + 1), 5) GROUP BY tree_id, nid", "node")
def simulation_accuracy(spark, d):
    runs = V.node(spark, d).select("tree_id", "nid", "depth", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    runs = runs.withColumn("correct", (F.col("nid") * 7 + F.col("k")) % 3 == 0)
    return tree.simulation_accuracy(runs).select("tree_id", "nid", rounded("sim"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    n = V.node(spark, d).withColumn("step", F.concat("step", F.lit(" "), F.col("nid").cast("string")))
    return tree.records(n)


_REC = "ends AS (SELECT tree_id, nid, correct, v FROM leaf WHERE correct OR type = 'Finish')"


@query("tree_records", f"WITH {_LEAF}, {_REC} SELECT tree_id, count(*) FILTER (correct) AS n_pos, count(*) FILTER (NOT correct) AS n_neg FROM ends GROUP BY tree_id", "node")
def tree_records(spark, d):
    return _records(spark, d).select("tree_id", F.size("pos").cast("long").alias("n_pos"), F.size("neg").cast("long").alias("n_neg"))


@query("tree_from_chains", f"WITH RECURSIVE {_LEAF}, {_REC}, {_UP} SELECT DISTINCT u.tree_id, n.depth, n.step || ' ' || n.nid AS step FROM ends e JOIN up u ON u.tree_id = e.tree_id AND u.nid = e.nid JOIN node n ON n.tree_id = u.tree_id AND n.nid = u.anc", "node")
def tree_from_chains(spark, d):
    return tree.from_chains(_records(spark, d)).select("tree_id", "depth", "step")


@query(
    "tree_search",
    # By hand from the rules: sure, all three first steps get one right answer; lost, each of three times three wrong
    # answers gets one reflection; long, two first steps get three answers of two steps; slow, twenty rounds of three
    # steps, then an answer for each of the 41 leaves.
    # The deepest leaves are those of the last of three full levels, and seven of the next.
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, list_extract([7, 22, 16, 102], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS nodes, list_extract([2, 3, 3, 5], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS depth,
        list_extract([3, 12, 9, 60], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS n_reason, list_extract([63 / 64, 0, NULL, NULL], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS root,
        list_extract([3, 0, 6, 41], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS n_pos, list_extract([0, 9, 0, 0], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS n_neg FROM orders""",
)
def tree_search(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("sure", "lost", "long", "slow")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = search.tree_search(_problems(spark, d, kind), search.ScriptModel(), columns=("id", "pid", "depth", "type", "v", "correct"))
    finish = F.col("type") == "Finish"
    # Six visits halve what a root of sure steps lacks.
    root = F.max(F.when(F.col("pid").isNull() & (F.col("id").cast("long") % 4 < 2), F.col("v"))).alias("root")
    return found.groupBy("id").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.col("type") == "Reason").alias("n_reason"), root,
        F.count_if(finish & F.col("correct")).alias("n_pos"), F.count_if(finish & ~F.col("correct")).alias("n_neg"),
    )


def _problems(spark: SparkSession, d: str, kind) -> DataFrame:
    answer = F.char(F.lit(65) + F.col("o_orderkey") % 4)
    o = V.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat_ws(" ", answer, F.col("o_orderkey").cast("string"), kind).alias("question"), answer.alias("answer"))


@query(
    "tree_search_valued",
    # By hand: without rollouts a first step is never sure, so each asks which action to take. sure: two steps get three
    # right answers each; lost, long and slow as above.
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, list_extract([10, 22, 16, 102], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS nodes, list_extract([2, 3, 3, 5], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS depth,
        list_extract([6, 9, 6, 41], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS n_finish, list_extract([6, 0, 6, 41], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS n_pos FROM orders""",
)
def tree_search_valued(spark, d):
    """A value model scores the steps; finished ones are checked against the answer."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("sure", "lost", "long", "slow")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = search.tree_search(
        _problems(spark, d, kind), search.ScriptModel(), dataclasses.replace(search.PIPELINE, value_model=True), columns=("id", "depth", "type", "correct")
    )
    finish = F.col("type") == "Finish"
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.count_if(finish).alias("n_finish"), F.count_if(finish & F.col("correct")).alias("n_pos"))


@query("tree_search_hash")
def tree_search_hash(spark, d):
    found = search.tree_search(_problems(spark, d, F.lit("drawn")), search.HashModel(), columns=("id", "depth", "type", "correct"))
    finish = F.col("type") == "Finish"
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.count_if(finish & F.col("correct")).alias("n_pos"), F.count_if(finish & ~F.col("correct")).alias("n_neg"))


# Training sets -------------------------------------------------------------------------------


@query(
    "sft_rows",
    f"WITH RECURSIVE {_LEAF}, {_UP}, {_PMIN}, e AS (SELECT l.tree_id, l.nid, coalesce(p.value, 1) AS m FROM leaf l JOIN pmin p ON p.tree_id = l.tree_id AND p.nid = l.nid WHERE l.correct), r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY m DESC) AS k FROM e) SELECT tree_id AS id, count(*) AS n, round(CAST(sum(CAST(m AS DECIMAL(30,12))) AS DOUBLE), 6) AS total FROM r WHERE k <= 3 GROUP BY tree_id",
    "node",
)
def sft_rows(spark, d):
    rows = _records(spark, d).withColumns({"id": F.col("tree_id"), "question": F.col("tree_id").cast("string")})
    kept = D.supervised(rows, k=3)
    values = _records(spark, d).select("tree_id", F.explode("pos").alias("t")).select(
        F.col("tree_id").alias("id"), T.path_text("t.chain.step").alias("said"), D.inner_min(F.col("t.chain.value")).alias("m")
    )
    talk = kept.select("id", F.col("conversations")[1]["value"].alias("said")).join(values, ["id", "said"])
    return talk.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(voting.exact_sum("m"), 6).alias("total"))


@query(
    "messages",
    "WITH m AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, 'system:s' || chr(10) || string_agg(CASE i % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END || text, chr(10) ORDER BY i) AS said FROM m GROUP BY conv_id",
)
def messages(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))))
    c = V.table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("c"))
    said = F.transform(D.messages("c", "s"), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return c.select("conv_id", F.array_join(said, "\n").alias("said"))


@query("learn_advantage", "SELECT traj, idx, CASE WHEN v < lag(v) OVER (PARTITION BY traj ORDER BY idx) THEN -100.0 ELSE round(v, 6) END AS label FROM steps", "steps")
def learn_advantage(spark, d):
    return D.learn_advantage(V.steps(spark, d)).select("traj", "idx", rounded("label"))


_WALK = """txt AS (SELECT u.tree_id, u.nid, list(n.step ORDER BY u.k DESC) AS path FROM up u JOIN node n ON n.tree_id = u.tree_id AND n.nid = u.anc GROUP BY u.tree_id, u.nid),
    own AS (SELECT tree_id, nid, path, nid = min(nid) OVER (PARTITION BY tree_id, path) AS own FROM txt),
    walk AS (SELECT u.tree_id, u.nid, bool_and(o.own) AS first FROM up u JOIN own o ON o.tree_id = u.tree_id AND o.nid = u.anc GROUP BY u.tree_id, u.nid)"""
_LEVEL = f"""{_LEAF}, {_UP}, {_WALK}, fam AS (SELECT n.*, t.path[1:len(t.path) - 1] AS ppath, EXISTS (SELECT 1 FROM leaf l WHERE l.tree_id = n.tree_id AND l.nid = n.nid) AS is_leaf FROM node n
        JOIN (SELECT tree_id, pid FROM node WHERE pid IS NOT NULL GROUP BY tree_id, pid HAVING count(*) > 1) k ON k.tree_id = n.tree_id AND k.pid = n.pid
        JOIN walk w ON w.tree_id = n.tree_id AND w.nid = n.nid AND w.first JOIN txt t ON t.tree_id = n.tree_id AND t.nid = n.nid),
    lev AS (SELECT a.tree_id, CASE WHEN a.v > b.v THEN a.nid ELSE b.nid END AS chosen, CASE WHEN a.v > b.v THEN b.nid ELSE a.nid END AS rejected, a.is_leaf AND b.is_leaf AS finished FROM fam a JOIN fam b ON a.tree_id = b.tree_id AND a.depth = b.depth AND a.nid < b.nid AND a.ppath <> b.ppath WHERE abs(a.v - b.v) > 0.8)"""


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    """Trees in which every fifth node has the text of the third, so that some path texts are equal."""
    return V.node(spark, d).withColumn("step", F.when(F.col("nid") % 5 == 3, "again").otherwise(F.col("step")))


_DOUBLED = "dbl AS (SELECT * REPLACE (CASE WHEN nid % 5 = 3 THEN 'again' ELSE step END AS step) FROM node)"
_AGAIN = lambda sql: f"{_DOUBLED}, " + sql.replace("FROM node", "FROM dbl").replace("JOIN node", "JOIN dbl")


@query("dpo_level", f"WITH RECURSIVE {_AGAIN(_LEVEL)} SELECT * FROM lev", "node")
def dpo_level(spark, d):
    return D.level_pairs(_doubled(spark, d))


@query(
    "dpo_finish",
    f"""WITH RECURSIVE {_AGAIN(_LEVEL.replace('0.8', '0.3'))}, {_PMIN}, ends AS (SELECT n.tree_id, n.nid, n.v, p.value FROM dbl n JOIN pmin p ON p.tree_id = n.tree_id AND p.nid = n.nid JOIN walk w ON w.tree_id = n.tree_id AND w.nid = n.pid AND w.first WHERE n.type = 'Finish')
        SELECT c.tree_id, c.nid AS chosen, r.nid AS rejected FROM ends c JOIN ends r ON c.tree_id = r.tree_id WHERE c.v = 1 AND r.v = 0 AND c.value - r.value > 0.3 AND NOT EXISTS (SELECT 1 FROM lev x WHERE x.tree_id = c.tree_id AND x.chosen = c.nid AND x.rejected = r.nid AND x.finished)""",
    "node",
)
def dpo_finish(spark, d):
    return D.finish_pairs(_doubled(spark, d), 0.3)


@query("dpo_sibling", "SELECT tree_id, pid AS parent, arg_max(nid, row(v, -nid)) AS chosen, arg_min(nid, row(v, nid)) AS rejected FROM node WHERE pid IS NOT NULL GROUP BY tree_id, pid HAVING max(v) > min(v)", "node")
def dpo_sibling(spark, d):
    return D.sibling_pairs(V.node(spark, d))


@query(
    "dpo_leaf",
    f"""WITH RECURSIVE {_LEAF}, {_UP}, {_PMIN}, ends AS (SELECT l.tree_id, l.nid, l.v, p.value FROM leaf l JOIN pmin p ON p.tree_id = l.tree_id AND p.nid = l.nid),
        good AS (SELECT tree_id, nid, row_number() OVER (PARTITION BY tree_id ORDER BY value DESC, nid) AS k FROM ends WHERE v = 1), bad AS (SELECT tree_id, nid, row_number() OVER (PARTITION BY tree_id ORDER BY value, nid DESC) AS k FROM ends WHERE v = 0)
        SELECT g.tree_id, CAST(g.k AS INTEGER) AS k, g.nid AS chosen, b.nid AS rejected FROM good g JOIN bad b ON g.tree_id = b.tree_id AND g.k = b.k""",
    "node",
)
def dpo_leaf(spark, d):
    return D.leaf_pairs(V.node(spark, d)).select("tree_id", "k", "chosen", "rejected")


@query("prm_step_index", "SELECT traj, idx, CAST(coalesce(sum(len(string_split(text, chr(10) || chr(10) || 'Step'))) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS step_idx FROM steps", "steps")
def prm_step_index(spark, d):
    return D.step_index(V.steps(spark, d)).select("traj", "idx", F.col("step_idx").cast("long").alias("step_idx"))


def _labels_sql(soft: bool) -> str:
    hard = "s.v - (r.label - s.v)"
    rule = f"CASE WHEN s.idx <= 1 THEN s.v ELSE {hard} END"
    if soft:
        rule = f"CASE WHEN s.idx <= 1 OR s.nxt IS NULL THEN s.v WHEN s.v < r.label AND s.v < s.nxt THEN s.v - (r.label - s.nxt) ELSE {hard} END"
    return f"""WITH RECURSIVE s AS (SELECT traj, idx, v, lead(v) OVER (PARTITION BY traj ORDER BY idx) AS nxt FROM steps),
        r AS (SELECT traj, idx, v AS label, v FROM s WHERE idx = 0 UNION ALL SELECT s.traj, s.idx, {rule}, s.v FROM r JOIN s ON s.traj = r.traj AND s.idx = r.idx + 1)"""


@query("prm_labels", _labels_sql(False) + " SELECT traj, idx, round(label, 6) + 0.0 AS label FROM r", "steps")
def prm_labels(spark, d):
    return D.reward_label_rows(V.steps(spark, d)).select("traj", "idx", (F.round("label", 6) + 0.0).alias("label"))


@query("prm_soft_labels", _labels_sql(True) + " SELECT traj, idx, round(label, 6) + 0.0 AS label FROM r", "steps")
def prm_soft_labels(spark, d):
    # Ties of a float with itself are exact: both engines read the same doubles.
    return D.reward_label_rows(V.steps(spark, d), soft=True).select("traj", "idx", (F.round("label", 6) + 0.0).alias("label"))


def _hard(spark: SparkSession, d: str, hrm: bool) -> DataFrame:
    ordered = V.steps(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("v").cast("double").alias("v")))).alias("s"))
    v = F.col("s.v")
    return ordered.select("traj", F.posexplode(D.hard_labels(v, D.reward_labels(v), 0.45, hrm)).alias("idx", "label"))


@query("prm_hard_labels", "SELECT traj, idx, CASE WHEN v > 0.45 THEN 1 ELSE 0 END AS label FROM steps", "steps")
def prm_hard_labels(spark, d):
    return _hard(spark, d, False)


@query("prm_hrm_labels", _labels_sql(False) + " SELECT traj, idx, CASE WHEN v > 0.45 OR (idx > 0 AND v >= lag(label) OVER (PARTITION BY traj ORDER BY idx)) THEN 1 ELSE 0 END AS label FROM r", "steps")
def prm_hrm_labels(spark, d):
    return _hard(spark, d, True)


@query("prm_rows", f"WITH {_LEAF}, {_REC}, c AS (SELECT tree_id, count(*) FILTER (correct) AS p, count(*) FILTER (NOT correct) AS q FROM ends GROUP BY tree_id) SELECT tree_id AS id, 2 * least(p, q) AS n FROM c WHERE p > 0 AND q > 0", "node")
def prm_rows(spark, d):
    rows = _records(spark, d).select(F.col("tree_id").alias("id"), F.col("tree_id").cast("string").alias("question"), "pos", "neg")
    return D.reward_rows(rows).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("path_variance", "SELECT traj, round(var_pop(v), 6) AS var FROM steps GROUP BY traj", "steps")
def path_variance(spark, d):
    g = V.steps(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return g.select("traj", F.round(D.path_variance("vs"), 6).alias("var"))


@query("token_labels", "WITH n AS (SELECT traj, idx, l, sum(l) OVER (PARTITION BY traj ORDER BY idx) - 1 AS pos FROM (SELECT traj, idx, 3 + idx % 2 AS l FROM steps)) SELECT traj, CAST(pos AS INTEGER) AS pos, CAST(idx AS DOUBLE) AS label FROM n WHERE idx > 0", "steps")
def token_labels(spark, d):
    g = V.steps(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list("idx")).alias("i"))
    labels = D.token_labels(F.transform("i", lambda x: 3 + x % 2), F.transform("i", lambda x: x.cast("double")))
    return g.select("traj", F.posexplode(labels).alias("pos", "label")).filter("label <> -100")


@query(
    "text_labels",
    r"""WITH t AS (SELECT traj, idx, text || chr(10) || chr(10) AS step, CAST(idx AS DOUBLE) AS label FROM steps),
        e AS (SELECT traj, idx, label, CAST(sum(length(step)) OVER (PARTITION BY traj ORDER BY idx) AS BIGINT) AS stop FROM t),
        w AS (SELECT traj, string_agg(step, '' ORDER BY idx) AS whole FROM t GROUP BY traj),
        p AS (SELECT traj, unnest(regexp_extract_all(whole, '\s*[^\s]+|\s+$')) AS piece, generate_subscripts(regexp_extract_all(whole, '\s*[^\s]+|\s+$'), 1) - 1 AS pos FROM w),
        q AS (SELECT traj, pos, CAST(sum(length(piece)) OVER (PARTITION BY traj ORDER BY pos) AS BIGINT) AS stop FROM p),
        m AS (SELECT e.traj, e.idx, e.label, max(q.pos) AS pos FROM e JOIN q ON q.traj = e.traj AND q.stop <= e.stop GROUP BY e.traj, e.idx, e.label)
        SELECT traj, CAST(pos AS INTEGER) AS pos, label FROM (SELECT *, lag(pos) OVER (PARTITION BY traj ORDER BY idx) AS before FROM m) WHERE idx > 0 AND pos > before""",
    "steps",
)
def text_labels(spark, d):
    """Labels of the words of whole trajectories; a word takes the white space before it, so it may begin in the step before."""
    step = F.concat("text", F.lit("\n\n"))
    rows = V.steps(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("idx", step.alias("step")))).alias("s"))
    labels = D.text_labels(D.piece_lengths(F.array_join("s.step", "")), F.transform("s.step", F.char_length), F.transform("s.idx", lambda i: i.cast("double")))
    return rows.select("traj", F.posexplode(labels).alias("pos", "label")).filter("label <> -100")


@query(
    "losses",
    """WITH e AS (SELECT vec_id % 10 AS k, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, (vec_id % 5) / 4.0::DOUBLE AS y, vec_id % 7 = 0 AS skip FROM embeddings),
        f AS (SELECT *, exp(b) / (exp(a) + exp(b)) AS p, 1 / (1 + exp(-b)) AS s, least(y, 1 - 1e-4) AS z FROM e),
        g AS (SELECT k, skip, -(y * ln(p) + (1 - y) * ln(1 - p)) AS soft, (p - y) * (p - y) AS mse, CASE WHEN abs(p - y) <= 0.5 THEN 0.5 * (p - y) * (p - y) ELSE 0.5 * (abs(p - y) - 0.25) END AS huber,
            -(z * ln(s) + (1 - z) * ln(1 - s)) AS bce, CASE WHEN abs(s - z) <= 0.5 THEN 0.5 * (s - z) * (s - z) ELSE 0.5 * (abs(s - z) - 0.25) END AS h, -ln(CASE WHEN y > 0 THEN exp(d) ELSE exp(c) END / (exp(c) + exp(d))) AS pen FROM f)
        SELECT k, round(avg(soft), 6) AS soft, round(avg(mse), 6) AS mse, round(avg(huber), 6) AS huber, round(avg(bce), 6) AS bce, round(avg(0.5 * bce + 0.5 * h), 6) AS hybrid, round(avg(soft) + 0.3 * avg(pen), 6) AS penalised FROM g WHERE NOT skip GROUP BY k""",
)
def losses(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, D.IGNORE).otherwise((F.col("vec_id") % 5) / 4.0)
    e = V.table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("k"), F.slice(x, 1, 2).alias("logits"), F.slice(x, 3, 2).alias("other"), label.alias("label"))
    each = [F.round(F.avg(D.token_loss(kind, "logits", "label")), 6).alias(kind) for kind in D.LOSSES]
    return e.groupBy("k").agg(*each, F.round(D.penalised_loss("logits", "label", "other", "label"), 6).alias("penalised"))


@query("pad_collate", "WITH a AS (SELECT doc_id, doc_id // 8 AS b, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CAST(max(n) OVER (PARTITION BY b) AS INTEGER) AS width, CAST(max(n) OVER (PARTITION BY b) - n AS INTEGER) AS pads FROM a")
def pad_collate(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.expr("doc_id div 8").alias("b"), F.transform(F.split("text", "\n", -1), lambda _: F.lit(1)).alias("ids"))
    out = D.collate(docs, ["b"], "ids", 0)
    return out.select("doc_id", F.size("ids").alias("width"), F.size(F.filter("ids", lambda x: x == 0)).alias("pads"))


@query("softmax_score", "SELECT vec_id, round(exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)), 6) AS p, round(1 / (1 + exp(-embedding[3]::DOUBLE)), 6) AS s FROM embeddings")
def softmax_score(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return V.table(spark, d, "embeddings").select("vec_id", F.round(D.step_probability(F.slice(x, 1, 2)), 6).alias("p"), F.round(D.sigmoid(x[2]), 6).alias("s"))


@query(
    "penalised_score",
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings) SELECT vec_id, round(exp(x[2]) / (exp(x[1]) + exp(x[2])) - 0.5 * exp(x[4]) / (exp(x[3]) + exp(x[4])), 6) AS p, round(-ln(1 - 1 / (1 + exp(-x[1]))), 6) AS loss, round(0.5 * (x[1] + x[2]), 6) AS blend FROM e",
)
def penalised_score(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    p = D.penalised_probability(F.slice(x, 1, 2), F.slice(x, 3, 2))
    return V.table(spark, d, "embeddings").select(
        "vec_id", F.round(p, 6).alias("p"), F.round(D.binary_cross_entropy(D.sigmoid(x[0]), F.lit(0.0)), 6).alias("loss"), F.round(D.blend(x[0], x[1]), 6).alias("blend")
    )


@query("mean_loss", "SELECT vec_id, round(list_avg(list_filter(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN x::DOUBLE ELSE 0 END), lambda y: y <> 0)), 6) AS loss FROM embeddings")
def mean_loss(spark, d):
    x = F.transform("embedding", lambda v: F.when(v > 0, v.cast("double")).otherwise(0.0))
    return V.table(spark, d, "embeddings").select("vec_id", F.round(D.mean_loss(x), 6).alias("loss"))


# Functions in Python -------------------------------------------------------------------------


@query("boxed", "SELECT p_partkey, ['a', '{' || p_size || '}'] AS boxes, '{' || p_size || '}' AS last FROM part")
def boxed(spark, d):
    text = F.concat(F.lit("x \\boxed{a} y \\boxed{{"), F.col("p_size").cast("string"), F.lit("}} z"))
    return V.table(spark, d, "part").select("p_partkey", P.boxed_all_udf(text).alias("boxes"), P.boxed_last_udf(text).alias("last"))


@query("medcalc_extract", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '0' || (p_size % 9 + 1) || '/05/2024' WHEN 1 THEN '(' || p_size || ', 3)' WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size * 2 AS VARCHAR) END AS answer FROM part")
def medcalc_extract(spark, d):
    s = F.col("p_size").cast("string")
    k = F.col("p_size") % 4
    text = (
        F.when(k == 0, F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("/5/2024 or so")))
        .when(k == 1, F.concat(F.lit("['"), s, F.lit(" weeks', '3 days']")))
        .when(k == 2, F.concat(s, F.lit(" out of 9")))
        .otherwise(F.concat(F.lit("str("), s, F.lit(" kg * 2)")))
    )
    kind = F.when(k == 0, 13).when(k == 1, 69).when(k == 2, 4).otherwise(2)
    return V.table(spark, d, "part").select("p_partkey", P.calculator_answer_udf(text, kind).alias("answer"))


@query("medcalc_correct", "SELECT p_partkey, CASE WHEN p_size % 10 >= 3 AND p_size % 10 <= 6 THEN 1 ELSE 0 END AS acc FROM part")
def medcalc_correct(spark, d):
    answer = (F.col("p_size") % 10).cast("string")
    return V.table(spark, d, "part").select("p_partkey", P.calculator_correct_udf(answer, F.lit("5"), F.lit(2), F.lit("3"), F.lit("6.5")).alias("acc"))


@query("number_of", "SELECT p_partkey, round(p_size / 100.0::DOUBLE, 6) AS a, round(p_size / 8.0::DOUBLE, 6) AS b FROM part")
def number_of(spark, d):
    s = F.col("p_size").cast("string")
    a, b = P.number_udf(F.concat(s, F.lit("%"))), P.number_udf(F.concat(F.lit("\\frac{"), s, F.lit("}{8}")))
    return V.table(spark, d, "part").select("p_partkey", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query(
    "lcs_recall",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE len(string_split(p_name, ' ')) / (len(string_split(p_name, ' ')) + 2.0::DOUBLE) END AS recall FROM part""",
)
def lcs_recall(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    # Two words exchanged; nothing in common; more words between; two words missing.
    text = F.when(k == 0, F.concat(F.lit("b a x "), s, F.lit(" c"))).when(k == 1, "q r").when(k == 2, F.concat(F.lit("a y b z "), s, F.lit(" y c"))).otherwise(F.col("p_name"))
    gold = F.when(k == 3, F.concat(F.lit("0 "), "p_name", F.lit(" 1"))).otherwise(F.concat(F.lit("a b "), s, F.lit(" c")))
    return V.table(spark, d, "part").select("p_partkey", P.lcs_recall_udf(text, gold).alias("recall"))


@query(
    "clean_answer",
    r"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_size * 1000 AS VARCHAR) WHEN 3 THEN '2' ELSE '' END AS number,
        CASE WHEN p_size % 3 = 0 THEN 'none of it' ELSE chr(CAST(65 + p_size % 10 AS INTEGER)) END AS letter,
        CASE p_size % 3 WHEN 0 THEN '\frac{1}{' || (p_size % 9) || '}' WHEN 1 THEN 'x+' || p_size ELSE '\sqrt{' || (p_size % 9) || '}' END AS latex,
        CASE p_size % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN '(b)' ELSE CAST(p_size AS VARCHAR) END AS theorem FROM part""",
)
def clean_answer(spark, d):
    n = F.col("p_size")
    s = n.cast("string")
    pick = lambda m, *shapes: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in shapes]), (n % m + 1).cast("int"))
    number = pick(
        5, F.concat(F.lit("1 and 2. The answer is "), s, F.lit(".00 eggs, not 3.")), F.concat(F.lit("9, then 00"), s, F.lit(".0")), F.concat(F.lit("the answer is "), s, F.lit(",000.")),
        F.concat(F.lit("The answer is 2.\n\nNext. The answer is "), s), "The answer is none.",
    )
    letter = F.when(n % 3 == 0, "The answer is none of it.").otherwise(F.concat(F.lit("so it is "), F.char(F.lit(65) + n % 10), F.lit(")")))
    digit = (n % 9).cast("string")
    maths = pick(3, F.concat(F.lit("The answer is \\boxed{\\dfrac1"), digit, F.lit("}.")), F.concat(F.lit("The answer is y = x + "), s, F.lit(".")), F.concat(F.lit("\\boxed{\\sqrt"), digit, F.lit("}")))
    theorem = pick(4, "The answer is yes.", "The answer is: it is false.", "The answer is (b)", F.concat(F.lit("The answer is x = "), s, F.lit("°C.")))
    return V.table(spark, d, "part").select(
        "p_partkey",
        P.clean_answer(number, "gsm8k").alias("number"), P.clean_answer(letter, "mmlu_pro").alias("letter"), P.clean_answer(maths, "math").alias("latex"), F.trim(P.clean_answer(theorem, "theoremqa")).alias("theorem"),
    )


@query("svamp", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS acc FROM part")
def svamp(spark, d):
    said = F.concat(F.lit("\\boxed{"), F.col("p_size").cast("string"), F.lit("}"))
    gold = F.col("p_size") + F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5)
    return V.table(spark, d, "part").select("p_partkey", P.svamp_correct_udf(said, gold).alias("acc"))


# Sources and sinks ---------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "files")


@query("jsonl_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def jsonl_roundtrip(spark, d):
    path = _folder(spark) + "/events.jsonl"
    files.write_any(V.table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_any(spark, path, "event_id long, user_id long, event_type string, value double")


@query("json_roundtrip", "SELECT n_nationkey, n_name FROM nation")
def json_roundtrip(spark, d):
    path = _folder(spark) + "/nation.json"
    files.write_any(V.table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    kind = V.table(spark, d, "nation").schema["n_nationkey"].dataType.simpleString()
    return files.read_any(spark, path, f"n_nationkey {kind}, n_name string")


@query("running_votes", vote_sql("vote-sum"), "cand")
def running_votes(spark, d):
    """Candidates that arrive in two parts, the odd ones first, the stream stopped in between."""
    folder, session = _folder(spark), spark.newSession()
    cand = V.cand(spark, d)
    for k in (1, 0):
        cand.filter(F.col("cand_idx") % 2 == k).write.mode("append").parquet(f"{folder}/arrived")
        vote_arriving(session.readStream.schema(cand.schema).parquet(f"{folder}/arrived"), f"{folder}/votes")
    return last_votes(spark.read.parquet(f"{folder}/votes/updates")).select("id", "answer", rounded("weight"))


@query("json_array", "SELECT doc_id, lang, text FROM documents")
def json_array(spark, d):
    """Documents as JSON arrays, one per task that wrote them, read back by byte ranges."""
    path = _folder(spark) + "/documents.json"
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "text")
    files.write_json(docs, path)
    return read_json_array(spark, path, docs.schema)


@query("combine_files", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 2")
def combine_files(spark, d):
    folder, nation = _folder(spark), V.table(spark, d, "nation").select("n_nationkey", "n_name")
    for k in range(3):
        files.write_json(nation.filter(F.col("n_nationkey") % 3 == k), f"{folder}/part_{k}.json")
    kind = nation.schema["n_nationkey"].dataType.simpleString()
    return files.combine_prefixed(spark, folder, "part", 2, numbered_only=True).select(F.col("n_nationkey").cast(kind).alias("n_nationkey"), "n_name")


@query("append_merge", "SELECT n_nationkey, n_name FROM nation")
def append_merge(spark, d):
    folder, nation = _folder(spark), V.table(spark, d, "nation").select("n_nationkey", "n_name")
    for k in range(2):
        files.append_rows(nation.filter(F.col("n_nationkey") % 2 == k), f"{folder}/infer-{k}.jsonl")
    kind = nation.schema["n_nationkey"].dataType.simpleString()
    return files.merge_parts(spark, f"{folder}/infer-*.jsonl", f"n_nationkey {kind}, n_name string")


@query("parse_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_props(spark, d):
    return V.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("text_lines", "SELECT n_nationkey || ',' || n_name AS value FROM nation")
def text_lines(spark, d):
    path = _folder(spark) + "/nation.csv"
    rows = V.table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    files.write_any(rows, path)
    return files.read_any(spark, path)


@query("convert_jsonl", "SELECT n_nationkey, n_name FROM nation")
def convert_jsonl(spark, d):
    folder, nation = _folder(spark), V.table(spark, d, "nation").select("n_nationkey", "n_name")
    files.write_jsonl(nation, f"{folder}/a.jsonl")
    files.convert_jsonl(spark, f"{folder}/a.jsonl", f"{folder}/a.json")
    assert files.list_names(spark, folder) == ["a.json"]
    return files.read_any(spark, f"{folder}/a.json", f"n_nationkey {nation.schema['n_nationkey'].dataType.simpleString()}, n_name string")


@query("combine_folders", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def combine_folders(spark, d):
    folder, nation = _folder(spark), V.table(spark, d, "nation").select("n_nationkey", "n_name")
    for sub in ("a", "b"):
        files.write_json(nation, f"{folder}/{sub}/both.json")
    files.write_json(nation, f"{folder}/a/one.json")
    common = files.combine_folders(spark, [f"{folder}/a", f"{folder}/b"])
    assert list(common) == ["both.json"]
    kind = nation.schema["n_nationkey"].dataType.simpleString()
    return common["both.json"].select(F.col("n_nationkey").cast(kind).alias("n_nationkey"), "n_name")


@query("csv_records", "SELECT n_nationkey, n_name FROM nation")
def csv_records(spark, d):
    path, nation = _folder(spark) + "/q.csv", V.table(spark, d, "nation").select("n_nationkey", "n_name")
    nation.write.option("header", True).csv(path)
    return files.read_table(spark, path, f"n_nationkey {nation.schema['n_nationkey'].dataType.simpleString()}, n_name string")


@query("whole_text", "SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS value FROM nation")
def whole_text(spark, d):
    path = _folder(spark) + "/names.txt"
    files.write_any(V.table(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1), path)
    return files.read_any(spark, path)


@query("question_tags", "SELECT doc_id, text || ' Let''s write a program.' AS tagged, text AS bare FROM documents")
def question_tags(spark, d):
    tagged = T.add_tag("text", "pot_prompt")
    return V.table(spark, d, "documents").select("doc_id", tagged.alias("tagged"), T.remove_tag(tagged, "pot_prompt").alias("bare"))


@query("choice_letters", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ABC' ELSE 'ABCDE' END AS letters FROM documents")
def choice_letters(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, "pubmedqa").otherwise("other")
    return V.table(spark, d, "documents").select("doc_id", M.choice_letters(name).alias("letters"))


@query("math_correct", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS acc FROM part")
def math_correct(spark, d):
    s = F.col("p_size").cast("string")
    said = F.concat(F.lit("So. The answer is \\dfrac{1}{"), s, F.when(F.col("p_size") % 3 == 0, "").otherwise("9"), F.lit("}."))
    target = P.boxed_all_udf(F.concat(F.lit("it is \\boxed{\\frac{1}{"), s, F.lit("}}")))
    return V.table(spark, d, "part").select("p_partkey", M.math_correct(said, F.get(target, F.lit(0))).alias("acc"))


@query("calculation", "SELECT p_partkey, CASE WHEN p_size % 10 >= 3 AND p_size % 10 <= 6 THEN 1 ELSE 0 END AS acc FROM part")
def calculation(spark, d):
    said = F.concat(F.lit("Sum up.\nThe answer is "), (F.col("p_size") % 10).cast("string"), F.lit(" mg (dose)."))
    return V.table(spark, d, "part").select("p_partkey", M.calculation(said, F.lit("5"), F.lit(2), F.lit("3"), F.lit("6.5")).alias("acc"))


@query(
    "rouge",
    """SELECT p_partkey, list_extract([0.75::DOUBLE, 1.0, 0.0, 0.5], p_size % 4 + 1) AS r1, round(list_extract([1 / 3.0::DOUBLE, 1.0, 0.0, 0.0], p_size % 4 + 1), 6) AS r2, list_extract([0.75::DOUBLE, 1.0, 0.0, 0.25], p_size % 4 + 1) AS rl FROM part""",
)
def rouge(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    # One word exchanged; equal; nothing in common; two words the other way round.
    text = F.when(k == 0, F.concat(F.lit("a b x "), s)).when(k == 1, F.concat(F.lit("a b c "), s)).when(k == 2, "q").otherwise("b a")
    r = M.rouge(text, F.concat(F.lit("a b c "), s))
    return V.table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", rounded_field("rouge_1", "r1"), rounded_field("rouge_2", "r2"), rounded_field("rouge_l", "rl"))


def rounded_field(field: str, name: str):
    return F.round(F.col(f"r.{field}"), 6).alias(name)


@query(
    "score_cache",
    f"""WITH c AS (SELECT doc_id, source, chr(CAST(65 + doc_id % 5 AS INTEGER)) AS pred, gold, CAST({_ACC} AS DOUBLE) AS acc FROM qa),
        s AS (SELECT source, avg(acc) AS acc, avg((acc + CASE WHEN gold = 'A' THEN 1 ELSE 0 END) / 2) AS p1, avg(CASE WHEN acc + CASE WHEN gold = 'A' THEN 1 ELSE 0 END >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS p2 FROM c GROUP BY source)
        SELECT source, round(acc, 6) AS acc, round(p1, 6) AS pass1, round(p2, 6) AS pass2 FROM s""",
    "qa",
)
def score_cache(spark, d):
    rows = V.qa(spark, d).withColumnRenamed("doc_id", "id")
    both = F.array("text", F.lit("The answer is A."))
    cache = voting.score_cache(rows, M.multiple_choice("text", "gold"), T.extract_answer("text"), F.col("gold"), both)
    result = voting.result_row(cache.join(rows.select("id", "source"), "id"), ["source"])
    return result.select("source", rounded("acc"), F.round(F.get("pass_at_k", F.lit(0)), 6).alias("pass1"), F.round(F.get("pass_at_k", F.lit(1)), 6).alias("pass2"))


@query(
    "vote_override",
    f"""WITH w AS ({vote_sql("vote-sum")}), g AS (SELECT DISTINCT user_id AS id, list_extract(['view', 'click', 'signup', 'error', 'purchase'], CAST(user_id % 5 + 1 AS INTEGER)) AS gold FROM events)
        SELECT g.id, w.answer AS pred, CASE WHEN contains(w.answer, g.gold) THEN 1.0 ELSE 0.0 END AS acc FROM g JOIN w USING (id)""",
    "cand",
)
def vote_override(spark, d):
    sentence = F.concat(F.lit("So the answer is '"), F.upper("answer"), F.lit("'."))
    cand = V.cand(spark, d).withColumn("answer", F.when(F.col("cand_idx") % 2 == 0, sentence).otherwise(F.col("answer")))
    return voting.vote_override(V.gold(spark, d).withColumnRenamed("answer", "gold"), cand, "vote-sum").select("id", "pred", "acc")


@query(
    "rouge_summary",
    """SELECT p_size % 3 AS k, round(avg(list_extract([0.75::DOUBLE, 1.0, 0.0, 0.5], p_size % 4 + 1)), 6) AS rouge_1, round(avg(list_extract([1 / 3.0::DOUBLE, 1.0, 0.0, 0.0], p_size % 4 + 1)), 6) AS rouge_2,
        round(avg(list_extract([0.75::DOUBLE, 1.0, 0.0, 0.25], p_size % 4 + 1)), 6) AS rouge_l FROM part GROUP BY p_size % 3""",
)
def rouge_summary(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    text = F.when(k == 0, F.concat(F.lit("a b x "), s)).when(k == 1, F.concat(F.lit("a b c "), s)).when(k == 2, "q").otherwise("b a")
    rows = V.table(spark, d, "part").withColumn("k", F.col("p_size") % 3)
    means = voting.rouge_summary(rows, M.rouge(text, F.concat(F.lit("a b c "), s)), ["k"])
    return means.select("k", rounded("rouge_1"), rounded("rouge_2"), rounded("rouge_l"))


@query("sample_outputs", "SELECT CAST(n_nationkey AS VARCHAR) AS id, k AS cand_idx, n_name || ' ' || k AS text FROM nation, (SELECT CAST(range AS INTEGER) AS k FROM range(4))")
def sample_outputs(spark, d):
    from ..operators.generate import sample_outputs as sample

    prompts = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("prompt"))
    return sample(prompts, lambda texts, n: [[f"{t} {k}" for k in range(n)] for t in texts], n=4, threads=2).select("id", "cand_idx", "text")
