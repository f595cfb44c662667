"""Views of the driver's tables in the shapes the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_TYPES = ("view", "click", "signup", "error", "purchase")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("cand_idx"), F.col("event_type").alias("answer"), F.col("value").alias("score"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), pick.alias("answer")).distinct()


def cand_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") + 0.5)
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 10").alias("id"), F.col("vec_id").alias("cand_idx"), F.col("label").cast("string").alias("answer"), steps.alias("steps"))


STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj, idx, v, text): the lines of an order as steps."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("traj"),
        (F.row_number().over(w) - 1).alias("idx"),
        (1 - F.col("l_discount") * 10).alias("v"),
        F.concat(F.lit("Take part "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "\n\nStep back").otherwise("")).alias("text"),
    )


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of 40 nodes with three children each, from parts."""
    n = F.col("p_partkey") % 40
    depth = F.when(n < 1, 0).when(n < 4, 1).when(n < 13, 2).otherwise(3)
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).alias("tree_id"),
        n.alias("nid"),
        F.when(n > 0, F.floor((n - 1) / 3)).alias("pid"),
        depth.alias("depth"),
        ((F.col("p_size") % 11).cast("double") / 10).alias("v"),
        F.col("p_size").alias("n"),
        F.when(F.col("p_size") % 4 == 0, "Finish").otherwise("Reason").alias("type"),
        F.col("p_name").alias("step"),
        F.col("p_brand").alias("trace"),
        (F.col("p_size") % 11 == 10).alias("correct"),
        (F.col("p_size") % 3 == 0).alias("completed"),
        F.lit(0).alias("refine_cnt"),
        F.lit(1).alias("refine_limit"),
        ((F.col("p_size") % 11).cast("double") / 10).alias("sim"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, gold): documents that end with an answer sentence."""
    said = F.concat("text", F.lit("\nThe answer is "), F.char(F.lit(65) + F.col("doc_id") % 5), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", "source", said.alias("text"), F.char(F.lit(65) + (F.col("doc_id") * 7) % 5).alias("gold"))


def chatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents with remarks around them."""
    k = F.col("doc_id") % 4
    lead = F.when(k == 0, "Here is the text:\n\n").when(k == 1, "I'm happy to help.\n\n").otherwise("")
    tail = F.when(F.col("doc_id") % 3 == 0, "\n\nI hope this helps").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text", tail).alias("text"))


SQL = {
    "cand": "cand AS (SELECT user_id AS id, event_id AS cand_idx, event_type AS answer, value AS score FROM events)",
    "gold": "gold AS (SELECT DISTINCT user_id AS id, CASE user_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' ELSE 'purchase' END AS answer FROM events)",
    "cand_steps": "cand AS (SELECT vec_id // 10 AS id, vec_id AS cand_idx, CAST(label AS VARCHAR) AS answer, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) + 0.5) AS steps FROM embeddings)",
    "steps": """steps AS (SELECT l_orderkey AS traj, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS INTEGER) AS idx,
        1 - l_discount * 10 AS v, 'Take part ' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || chr(10) || 'Step back' ELSE '' END AS text FROM lineitem)""",
    "node": """node AS (SELECT p_partkey // 40 AS tree_id, p_partkey % 40 AS nid, CASE WHEN p_partkey % 40 > 0 THEN (p_partkey % 40 - 1) // 3 END AS pid,
        CASE WHEN p_partkey % 40 < 1 THEN 0 WHEN p_partkey % 40 < 4 THEN 1 WHEN p_partkey % 40 < 13 THEN 2 ELSE 3 END AS depth,
        CAST(p_size % 11 AS DOUBLE) / 10 AS v, p_size AS n, CASE WHEN p_size % 4 = 0 THEN 'Finish' ELSE 'Reason' END AS type, p_name AS step, p_brand AS trace,
        p_size % 11 = 10 AS correct, p_size % 3 = 0 AS completed FROM part)""",
    "qa": "qa AS (SELECT doc_id, source, text || chr(10) || 'The answer is ' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || '.' AS text, chr(CAST(65 + (doc_id * 7) % 5 AS INTEGER)) AS gold FROM documents)",
    "chatter": """chatter AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Here is the text:' || chr(10) || chr(10) WHEN 1 THEN 'I''m happy to help.' || chr(10) || chr(10) ELSE '' END || text
        || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'I hope this helps' ELSE '' END AS text FROM documents)""",
}
