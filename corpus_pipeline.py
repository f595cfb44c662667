"""A corpus from raw documents: drop toxic ones, deduplicate, pack into training sequences.

Each stage takes the table the one before kept, with all its columns, and returns those columns; the last
returns the pieces of its sequences. Null texts count as empty: they are not toxic, are copies of one another and of
the empty text, have no near copies and one token. Rows with a null id stay in every stage but exact
deduplication, where they lose to a copy with an id. Repeated rows are one after exact deduplication. Texts of any
length are read whole. Columns of other names are carried along, whatever their names. An empty table goes
through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import exact_dedup, minhash, packing, suffix, toxicity
from tracemill.llm.common import drop_scratch, scratch, table
from tracemill.llm.vocabulary import path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Classifier, tokenizer and suffix sort are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
        drop_scratch(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
