"""Properties on generated inputs, against naive versions or the libraries."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tracemill.llm import packing, quality, suffix
from tracemill.llm.bpe import WordBpe
from tracemill.llm.graph import local_roots
from tracemill.llm.hashing import shingles
from tracemill.llm.vocabulary import byte_encoder, path


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    name = path("word_bpe_49k.json")
    return WordBpe(name), Tokenizer.from_file(name)


@settings(max_examples=1500, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdehilnorst '</w>|")), max_size=60))
def test_bpe_equals_the_library(bpe, text):
    own, library = bpe
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    name = path("byte_bpe_50k.json")
    return byte_encoder(name), Tokenizer.from_file(name)


@settings(max_examples=1000, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n<|endoftext|>'s12")), max_size=60))
def test_byte_bpe_equals_the_library(byte_bpe, text):
    own, library = byte_bpe
    assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 2047), max_size=60))
def test_bins(lengths):
    bins, out = packing.Bins(0, 2048), []
    for i, n in enumerate(lengths):
        at = 0
        for size, k in packing.cuts(n, 2048, 64):
            out += bins.put([i, at, size, 0, n, None, None, 0, k], k)
            at += size
    out += bins.first_fit(0.0)
    assert sum(p[2] for p in out) == sum(lengths)
    by: dict = {}
    for p in out:
        by.setdefault(p[5], []).append(p)
    for ps in by.values():
        ps.sort(key=lambda p: p[6])
        assert [p[6] for p in ps] == [sum(q[2] for q in ps[:i]) for i in range(len(ps))]
        assert sum(p[2] for p in ps) <= 2048


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10)), max_size=20))
def test_union_of_spans(spans):
    got = suffix.union_of([{"start": s, "stop": s + n} for s, n in spans])
    covered = {i for s, n in spans for i in range(s, s + n)}
    assert {i for s, e in got for i in range(s, e)} == covered
    assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40))))
def test_local_roots(case):
    n, links = case
    i, j = (np.array([x[k] for x in links], dtype=int) for k in (0, 1))
    want = brute.components(range(n), links)
    assert local_roots(n, i, j).tolist() == [want[k] for k in range(n)]


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5), st.sampled_from([2, 5]))
def test_shingle_counts(texts, width):
    _, owner = shingles([t.encode("utf-8", "replace") for t in texts], width)
    sets = brute.word_sets(list(enumerate(t.encode("utf-8", "replace").decode() for t in texts)), width)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(sets[i]) for i in range(len(texts))]


@given(st.text(max_size=200))
def test_statistics_are_finite(text):
    assert np.isfinite(quality.expand(np.array([quality.statistics(text)], dtype=float))).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4))
def test_runs_cover_every_string(texts):
    data = [t.encode() for t in texts]
    r = suffix.runs(data, 20, 10)
    got = sorted((int(t), int(s) + k) for t, s, m in zip(r["text"], r["start"], r["many"], strict=True) for k in range(int(m)))
    assert got == [(i, s) for i, t in enumerate(data) for s in range(len(t) - 19)]
    # Equal strings have equal grams at equal distances.
    seen: dict = {}
    for t, s, m, lead, g in zip(*(r[c] for c in ("text", "start", "many", "lead", "gram")), strict=True):
        for k in range(int(m)):
            where = int(s) + k
            key = data[int(t)][where : where + 20]
            assert seen.setdefault(key, (int(lead) - k, int(g))) == (int(lead) - k, int(g))
