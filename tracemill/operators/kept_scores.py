"""Scores kept over runs by what was scored, so a run scores only what no run before has seen.

A row's address is a hash of its text, its gold answer, the metric's name and the metric's version: a changed text, answer or rule has a new
address, a renamed or repeated row hasn't. Each run adds one folder of rows (address, score) by the writers' commit protocol, so a run
that dies adds nothing, and runs side by side at worst score a row twice, to the same score. :func:`compact` puts all folders into one;
it writes the new one before it removes the old ones, and readers take one row per address, so stopping in between does no harm.

Null texts and null gold answers have addresses of their own. An empty table scores nothing; a cache that isn't there is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

SCHEMA = "address string, score double"


def address(text: Column | str, gold: Column | str, metric: str, version: str) -> Column:
    """The hash of all that a score depends on; lengths keep the parts apart."""
    parts = [F.lit(metric), F.lit(version), *(F.col(c) if isinstance(c, str) else c for c in (text, gold))]
    told = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*told), 256)


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{name}" for name in files.list_names(spark, path) if name.startswith("run-")]


def load(spark: SparkSession, path: str) -> DataFrame:
    """(address, score), one row per address."""
    found = _folders(spark, path)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*found).dropDuplicates(["address"])


def score(rows: DataFrame, path: str, metric: str, version: str, rule: Callable[[Column, Column], Column], text: str = "text", gold: str = "gold") -> DataFrame:
    """``rows`` with ``score`` and ``fresh`` (scored in this run). ``rule`` sees each new (text, gold) once; what it gives is added to the cache."""
    spark = rows.sparkSession
    known = load(spark, path)
    at = address(text, gold, metric, version)
    asked = rows.select(at.alias("address"), F.col(text).alias("_text"), F.col(gold).alias("_gold")).join(known, "address", "left_anti").dropDuplicates(["address"])
    run = f"{path}/run-{uuid.uuid4().hex}"
    asked.select("address", rule(F.col("_text"), F.col("_gold")).cast("double").alias("score")).write.parquet(run)
    fresh = spark.read.schema(SCHEMA).parquet(run).withColumn("fresh", F.lit(True))
    every = known.withColumn("fresh", F.lit(False)).unionByName(fresh)
    return rows.withColumn("address", at).join(every, "address", "left").drop("address")


def compact(spark: SparkSession, path: str) -> int:
    """All folders as one; the number of rows it holds."""
    old = _folders(spark, path)
    if not old:
        return 0
    new = f"{path}/run-{uuid.uuid4().hex}"
    load(spark, path).write.parquet(new)
    for folder in old:
        files.remove(spark, folder)
    return spark.read.schema(SCHEMA).parquet(new).count()
