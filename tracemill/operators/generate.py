"""Sampling outputs from a model: the model is any callable on a list of prompts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

Sampler = Callable[[list[str], int], list[list[str]]]


def retry(tries: int, default):
    """Call again after an error; ``default`` when every try fails."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            for _ in range(tries):
                try:
                    return f(*args, **kwargs)
                except Exception:  # noqa: BLE001  a model's errors are of any kind
                    continue
            return default

        return call

    return wrap


def sample_outputs(prompts: DataFrame, sampler: Sampler, n: int = 16, batch: int = 8, threads: int = 1, tries: int = 3) -> DataFrame:
    """(id, cand_idx, text, error) of prompts (id, prompt): n outputs each, in batches; ``threads`` batches at a time, for
    models behind a network. A prompt whose batch fails on every try keeps a row that says so."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = retry(tries, None)(sampler)
        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                ids, texts = f["id"].tolist(), f["prompt"].tolist()
                starts = range(0, len(ids), batch)
                rows = []
                for s, outputs in zip(starts, pool.map(lambda s: ask(texts[s : s + batch], n), starts), strict=True):
                    for i, id_ in enumerate(ids[s : s + batch]):
                        if outputs is None:
                            rows.append((id_, None, None, "the model failed"))
                        else:
                            rows += [(id_, k, t, None) for k, t in enumerate(outputs[i])]
                yield pd.DataFrame(rows, columns=["id", "cand_idx", "text", "error"]).astype({"cand_idx": "Int64"})

    return prompts.select("id", "prompt").mapInPandas(run, "id string, cand_idx int, text string, error string")
