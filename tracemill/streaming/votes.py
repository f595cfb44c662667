"""Votes over candidates that keep arriving.

The state of a question is a tally for each distinct answer: candidates, exact sum and largest of their scores, first position. Tallies
add up in any order, so the last winner of a question is the one that :func:`tracemill.operators.voting.vote` gives for all its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.voting import parse_method, scored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "answer string"
TALLY = "n long, scored long, total decimal(38,12), best double, best_at long, first_at long"


def _tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One tally per question and answer of each batch, so that a question with very many candidates sends few rows on."""
    for b in batches:
        b = b.sort_values(["id", "answer", "g", "cand_idx"], ascending=[True, True, False, True], na_position="last")
        # The first of a group holds its best score, at the smallest position.
        groups = b.groupby(["id", "answer"], sort=False, dropna=False)
        out = groups.agg(n=("cand_idx", "size"), scored=("g", "count"), total=("exact", _exact_sum), best=("g", "first"), first_at=("cand_idx", "min"))
        scores = b[b["g"].notna()].groupby(["id", "answer"], sort=False, dropna=False)["cand_idx"].first()
        out["best_at"] = scores.reindex(out.index).astype("Int64")
        yield out.reset_index()[["id", "answer", "n", "scored", "total", "best", "best_at", "first_at"]]


def _exact_sum(values) -> Decimal:
    with localcontext() as c:
        c.prec = 38
        return sum((v for v in values if v is not None), Decimal(0))


class _Votes(StatefulProcessor):
    def __init__(self, rule: str):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tallies = handle.getMapState("tallies", ANSWER, TALLY)
        self.seen = handle.getValueState("seen", "n long")

    def _weight(self, t: tuple) -> float | None:
        n, voted, total, best, *_ = t
        if self.rule == "vote-count":
            return float(n)
        if not voted:
            return None
        return {"vote-sum": lambda: float(total), "vote-mean": lambda: float(total) / voted, "max": lambda: best}[self.rule]()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for batch in rows:
            for r in batch.itertuples(index=False):
                best, at = (None, None) if pd.isna(r.best) else (float(r.best), int(r.best_at))
                new = (int(r.n), int(r.scored), r.total, best, at, int(r.first_at))
                answer = (r.answer,)
                if self.tallies.containsKey(answer):
                    new = _add(tuple(self.tallies.getValue(answer)), new)
                self.tallies.updateValue(answer, new)
                seen += int(r.n)
        self.seen.update((seen,))
        winner = None
        for answer, t in self.tallies.iterator():
            weight, first = self._weight(t), (t[4] if self.rule == "max" and t[4] is not None else t[5])
            rank = (weight is not None, weight or 0.0, -first, answer[0])
            winner = max(winner, (rank, weight)) if winner else (rank, weight)
        yield pd.DataFrame({"id": [key[0]], "answer": [winner[0][3]], "weight": pd.array([winner[1]], dtype="Float64"), "seen": [seen]})

    def close(self) -> None:
        pass


def _add(a: tuple, b: tuple) -> tuple:
    scores = [(-t[3], t[4]) for t in (a, b) if t[3] is not None]
    best, at = min(scores) if scores else (None, None)
    with localcontext() as c:
        c.prec = 38
        total = a[2] + b[2]
    return a[0] + b[0], a[1] + b[1], total, None if best is None else -best, at, min(a[5], b[5])


def running_votes(cand: DataFrame, method: str = "vote-sum") -> DataFrame:
    """(id, answer, weight, seen) of a stream of candidates, in update mode: the winner of each question that got candidates, after all it
    has got so far; ``seen`` says how many voted, so of several rows of a question the one with the largest ``seen`` counts.

    Takes the methods and rules of ``vote``: null and empty answers and NaN scores don't vote, ties go to the answer met first, questions
    with a null id are one question. ``cand_idx`` says what is first, not the order of arrival. The state grows with the distinct answers
    and stays in RocksDB; a candidate that arrives twice votes twice, so sources should be exactly once."""
    op, rule = parse_method(method)
    rows = scored(cand, op).withColumn("cand_idx", F.col("cand_idx").cast("long")).withColumn("exact", F.col("g").try_cast("decimal(30,12)"))
    kind = rows.schema["id"].dataType
    parts = rows.mapInPandas(_tallies, f"id {kind.simpleString()}, answer string, {TALLY}")
    out = T.StructType([T.StructField("id", kind), T.StructField("answer", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("seen", T.LongType())])
    return parts.groupBy("id").transformWithStateInPandas(_Votes(rule), outputStructType=out, outputMode="Update", timeMode="None")


def last_votes(updates: DataFrame) -> DataFrame:
    """(id, answer, weight): of all rows that :func:`running_votes` gave, the last of each question."""
    best = F.max_by(F.struct("answer", "weight"), "seen").alias("w")
    return updates.groupBy("id").agg(best).select("id", "w.answer", "w.weight")


def vote_arriving(cand: DataFrame, target: str, method: str = "vote-sum") -> None:
    """Take what has arrived of the stream ``cand`` since the last call and add the new winners to the table ``target``/updates.

    ``cand`` is of a session of its own, whose state store is set to RocksDB; other sessions keep their settings. A batch that is run again
    after a failure overwrites what it had written."""
    session = cand.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/updates/batch={number}")

    stream = running_votes(cand, method).writeStream.outputMode("update").foreachBatch(batch)
    stream.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
