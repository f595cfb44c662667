"""Labels of tokens from real offsets, and losses."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import python_functions as P
from tracemill.operators import datasets as D

I = D.IGNORE


def plain(tokens, steps, labels):
    ends, at = [], 0
    for n in tokens:
        at += n
        ends.append(at)
    out, stop, before = [I] * len(tokens), 0, -1
    for i, n in enumerate(steps):
        stop += n
        inside = [k for k, e in enumerate(ends) if e <= stop]
        last = inside[-1] if inside else -1
        if i and last > before:
            out[last] = labels[i]
        before = last
    return out


def test_labels_at_ends():
    # The second token begins in the first step and ends in the second.
    assert list(P.labels_at_ends([3, 4, 2], [5, 4], [0.1, 0.9], I)) == [I, I, 0.9]
    # No token ends in the second step.
    assert list(P.labels_at_ends([2, 9], [2, 3, 6], [0.1, 0.2, 0.3], I)) == [I, 0.3]
    assert list(P.labels_at_ends([], [], [], I)) == []
    rng = random.Random(3)
    for _ in range(300):
        steps = [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]
        tokens, left = [], sum(steps)
        while left:
            tokens.append(min(left, rng.randint(1, 5)))
            left -= tokens[-1]
        labels = [rng.random() for _ in steps]
        assert list(P.labels_at_ends(tokens, steps, labels, I)) == plain(tokens, steps, labels)


def test_labels_of_texts(spark):
    steps = ["First one.\n\n", "", "Then\n\n", "and é on.\n\n"]
    rows = [(steps, [0.1, 0.2, 0.3, 0.4]), ([], []), (None, None), (["only"], [0.5])]
    df = spark.createDataFrame(rows, "s array<string>, l array<double>")
    whole = D.piece_lengths(F.array_join("s", ""))
    labels = D.text_labels(whole, F.transform("s", F.char_length), "l")
    cut = D.text_labels(whole, F.transform("s", F.char_length), "l", limit=2)
    got = [tuple(r) for r in df.select(whole, labels, cut).collect()]
    # The words begin with the white space before them; the last piece is the white space at the end.
    assert got[0] == ([5, 5, 6, 5, 2, 4, 2], [I, I, 0.3, I, I, I, 0.4], [I, I])
    assert got[1] == ([], [], []) and got[2] == (None, None, None) and got[3] == ([4], [I], [I])


def test_losses(spark):
    rng = random.Random(2)
    rows = [([rng.uniform(-4, 4), rng.uniform(-4, 4)], rng.choice([0.0, 0.3, 1.0, I])) for _ in range(40)] + [([900.0, -900.0], 1.0), ([-900.0, 900.0], 0.0)]
    df = spark.createDataFrame(rows, "x array<double>, y double")
    got = df.select(*[D.token_loss(k, "x", "y").alias(k) for k in D.LOSSES]).collect()
    for ((a, b), y), r in zip(rows, got, strict=True):
        if y == I:
            assert all(v is None for v in r)
            continue
        top = max(a, b)
        whole = top + math.log(math.exp(a - top) + math.exp(b - top))
        p, z = math.exp(b - whole), min(y, 1 - 1e-4)
        s = 1 / (1 + math.exp(-b)) if b > -700 else 0.0
        hub = lambda d: 0.5 * d * d if d <= 0.5 else 0.5 * (d - 0.25)
        bce = max(b, 0) - b * z + math.log1p(math.exp(-abs(b)))
        want = [-(y * (b - whole) + (1 - y) * (a - whole)), (p - y) ** 2, hub(abs(p - y)), bce, 0.5 * bce + 0.5 * hub(abs(s - z))]
        assert list(r) == pytest.approx(want)
