"""Properties on generated inputs, against naive versions."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.functions import python_functions as P
from tracemill.operators import search

WORDS = st.lists(st.sampled_from("a b c d".split()), max_size=12)


@given(WORDS, WORDS)
def test_lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    want = n[-1][-1] / len(b) if b else 0.0
    assert P.lcs_recall(" ".join(a), " ".join(b)) == want


@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), max_leaves=8))
def test_arithmetic(expression):
    assert P.arithmetic(expression) == eval(expression)  # noqa: S307  digits, brackets and + - * only


@given(st.text())
def test_functions_take_any_text(text):
    P.number(text)
    P.boxed_all(text)
    P.boxed_last(text)
    for kind in (2, 4, 13, 69, 1):
        P.calculator_answer(text, kind)
    for name in ("gsm8k", "math", "mmlu", "gpqa", "theoremqa", "numglue", "bbh"):
        assert isinstance(P.raw_answer(name, ("The answer is",), text), str)


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=8), st.integers(1, 4), st.integers(5, 40), st.integers(0, 100))
def test_search_always_ends(problem, children, nodes, skill):
    config = search.Config(max_children=children, max_nodes=nodes, simulation=6)
    found = search.Search(problem, "A", search.HashModel(skill), config).run()
    rows = list(found.root.walk())
    assert sorted(n.nid for n in rows) == list(range(len(rows)))
    assert all(n.visits == 0 or 0 <= n.value <= 1 for n in rows)
    assert found.root.completed or all(n.kind == "Finish" for n in found.leaves())
