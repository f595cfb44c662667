"""Votes of a stream of candidates against those of all candidates at once."""

from __future__ import annotations

import json
import random

import pytest

from tracemill.operators.voting import vote
from tracemill.streaming.resume import arriving_records
from tracemill.streaming.votes import last_votes, vote_arriving

SCHEMA = "id string, cand_idx long, answer string, score double"


def candidates(seed: int) -> list[dict]:
    rng = random.Random(seed)
    rows = [{"id": rng.choice("abcd"), "cand_idx": i, "answer": rng.choice(["x", "y", "z", "", None]), "score": rng.choice([0.1, 0.2, 0.3, 0.7, -1.0, None])} for i in range(150)]
    rows += [{"id": "hot", "cand_idx": 1000 + i, "answer": rng.choice("xyz"), "score": 0.1} for i in range(300)]
    rows += [{"id": "tie", "cand_idx": k, "answer": a, "score": 0.5} for k, a in [(7, "late"), (3, "early")]]
    return rows + [{"id": "unscored", "cand_idx": 1, "answer": "x", "score": None}, {"id": "big", "cand_idx": 1, "answer": "x", "score": 1e15}]


def answers(df) -> dict:
    return {r["id"]: (r["answer"], None if r["weight"] is None else round(r["weight"], 9)) for r in df.collect()}


@pytest.mark.parametrize("method", ["sc", "vote-mean", "max"])
def test_any_order_of_arrival_and_restarts(spark, tmp_path, method):
    rows = candidates(3)
    want = answers(vote(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), method))
    random.Random(method).shuffle(rows)
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:200], rows[200:210], rows[210:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
        # A new query each time: it goes on from the checkpoint.
        vote_arriving(arriving_records(spark.newSession(), folder, SCHEMA), target, method)
    updates = spark.read.parquet(f"{target}/updates")
    got = answers(last_votes(updates))
    assert got == want and len(want) == 8
    assert updates.filter("id = 'tie'").count() <= 2
