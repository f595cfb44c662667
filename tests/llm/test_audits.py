"""Filter audit, spelling variants and token counts against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import filter_audit, spelling, token_counts
from tracemill.llm.vocabulary import path

WORDS = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, mask int, part string, kind int, range int, n long, h long, block long, cut long"


def table(spark, rows, parts=3):
    """(doc_id, text, lang) with other columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA).repartition(parts)


# ---------------------------------------------------------------- filters


def audited(rng: random.Random) -> list[tuple]:
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    rows: list[tuple] = []
    for i in range(80):
        text = " ".join(word() for _ in range(rng.choice([3, 99, 100, 101, 150])))
        if i % 3 == 0:
            text = " ".join(f"w{k}" for k in range(rng.choice([100, 120])))
        if i % 4 == 0:
            text = text.upper()
        if i % 5 == 0:
            text += rng.choice("#$%&*|")
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(100 + i, "the same text of a third of all", "en") for i in range(60)]
    rows += [(200, None, "fr"), (201, "", "fr"), (202, "\t \n", "fr"), (203, "É" * 9 + "A", "fr"), (204, "x " * 30_000, None)]
    rows += [(210, "twice", "en"), (210, "twice", "en"), (None, "no id", "en"), (None, "no id", "en"), (211, "no id", "de"), (None, None, None)]
    return rows


def plain_masks(rows) -> list[int]:
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any((o or "") == t and i is not None and (j is None or j < i) for j, o, _ in rows)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        out.append(sum(1 << k for k, f in enumerate(fails) if f))
    return out


def plain_audit(rows, labels) -> Counter:
    masks = plain_masks(rows)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {r[2] or "" for r in rows}:
        mine = [(m, r[0]) for m, r in zip(masks, rows, strict=True) if (r[2] or "") == part]
        removed = Counter()
        for order in orders:
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[0] & bit]
                early = sum(1 for m, _ in mine if m & bit) - len(gone)
                left = [x for x in left if not x[0] & bit]
                removed[f] += len(gone)
                alone = sum(1 for m, _ in mine if m == bit)
                lost = lambda ids: sum(1 for _, d in gone if d in ids)  # noqa: B023, E731
                out[part, order, step] = (len(left), len(gone), early, alone, lost(good), lost(toxic))
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step] += (removed[f],)
    return Counter((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_filter_audit(spark, parts):
    rows = audited(random.Random(3))
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 220, 2)] + [(4, 0, 1), (100, None, None), (None, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    given_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.audit(table(spark, rows), given_labels)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        # No label has a null id that a document could meet.
        assert Counter(map(tuple, got.collect())) == plain_audit(rows, [x for x in labels if x[0] is not None])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_filter_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table(spark, []), labels).count() == 0


def test_copies_over_many_ranges(spark):
    rows = [(i, "same", "en") for i in range(400)] + [(1000 + i, f"other {i}", "en") for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.failures(table(spark, rows, 8)).filter("mask >= 16").select("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r[0] for r in got) == list(range(1, 400))


# --------------------------------------------------------------- spelling


def plain_words(rows) -> dict[str, int]:
    out: Counter = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words: dict[str, int]) -> set[tuple]:
    form, count = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, count[w], words[form[w]] if form[w] else None))
    return out


def spelled(rng: random.Random) -> list[tuple]:
    base = ["".join(rng.choice("abcé÷Àÿ") for _ in range(rng.randint(6, 8))) for _ in range(12)]
    counts: Counter = Counter()
    for w in base:
        counts[w] += rng.choice([5, 30, 150, 800])
        for _ in range(6):
            i = rng.randrange(len(w))
            edit = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + rng.choice("abz") + w[i + 1 :]])
            counts[edit] += rng.choice([4, 5, 6, 25, 30])
    counts |= {"aaaaaa": 6, "aaaaaaa": 30, "aabaaa": 30, "aaabaa": 30, "abcabcx": 5, "abcabcy": 25, "abcabcz": 125, "abcabc": 25}
    some = list(counts.elements())
    rng.shuffle(some)
    rows: list[tuple] = []
    for i in range(0, len(some), 40):
        rows.append((i, " ".join(w.upper() if k % 7 == 0 and w.isascii() else w for k, w in enumerate(some[i : i + 40])) + rng.choice(["!", "1", "ş"]), None))
    return [*rows, rows[0], (None, rows[1][1], "x"), (7, None, None), (8, "", "en"), (9, "b" * 50_000 + " " + " ".join(["longer"] * 9), "en")]


@pytest.mark.parametrize("group", [1, 4, spelling.GROUP])
def test_spelling(spark, group, monkeypatch):
    rows = spelled(random.Random(11))
    words = plain_words(rows)
    vocabulary = spelling.words(table(spark, rows))
    assert {tuple(r) for r in vocabulary.collect()} == set(words.items())
    pairs = [tuple(r) for r in spelling.near_pairs(vocabulary, group).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}
    if group == spelling.GROUP:
        got = spelling.variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert len(got) == len(words)
        assert {tuple(r) for r in got} == plain_variants(words)


def test_many_words_of_the_same_letters(spark):
    """All orders of eight letters share their keys; each is near few others, and few pairs are made."""
    orders = sorted({"".join(p) for p in permutations("aabbccd")})
    words = orders + [o[:-1] + "z" for o in orders[:40]]
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n long").distinct()
    pairs = {tuple(r) for r in spelling.near_pairs(vocabulary).collect()}
    known = set(words)
    assert pairs == {(a, b) for a in known for b in known if a < b and near(a, b)}


def test_chains_of_forms_end_in_one_root(spark):
    words = [f"stem{'abcdefghi'[: i + 2]}" for i in range(7)]
    vocabulary = spark.createDataFrame([(w, 5 * 6**i) for i, w in enumerate(words)], "word string, n long")
    formed = spelling.forms(vocabulary, spelling.near_pairs(vocabulary))
    assert {tuple(r) for r in spelling.roots(formed).collect()} == {(w, words[-1]) for w in words[:-1]}


def test_spelling_of_empty_tables(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, "few words", "en")])).count() == 0


# ----------------------------------------------------------------- tokens

TEXTS = [
    None, "", " ", "The reader's don't 're 'r 'v '' !!'s 'll", "a!<|endoftext|>b<|endof", "<|endoftext|><|startoftext|>x", "İstanbul é éa 漢字。かな ñandú",
    "x" * 50 + "qzqzz" * 10, "̈́क़ ﷺ ΑΣ Σ", "3.14159 2nd x y", "a\x0bb\x85c​d \x1c e\x1ff", "é" * 9 + " naïve", "word " * 3000, "Unbelievably " * 40 + "😀👍🏽",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(WORDS))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(path(WORDS), memo=300)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="thersain'sTHE <|endoftext|>é漢́ͅΣσς 1", max_size=60))
def test_every_prefix(counter, library, text):
    assert list(counter.counts(text)) == [library(text[:i]) for i in range(len(text) + 1)]
    assert counter.total(text) == library(text)


def test_chunks_are_cut_at_spaces(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    counter = token_counts.PrefixCounter(path(WORDS))
    text = "".join(random.Random(2).choice(["word ", "don't", "\n", "é ", "漢字", "<|endoftext|>", " 'll"]) for _ in range(400))
    assert counter.total(text) == library(text)


def test_token_counts(spark, library):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, TEXTS[3], "en")]
    got = token_counts.token_counts(table(spark, rows), path(WORDS)).collect()
    want = Counter((i, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert any(r["over_limit"] for r in got)
    assert token_counts.token_counts(table(spark, []), path(WORDS)).count() == 0


def test_questions_to_the_index(spark, library):
    texts = {i: t or "" for i, t in enumerate(TEXTS)}
    index = token_counts.prefix_counts(table(spark, [(i, t, None) for i, t in enumerate(TEXTS)]), path(WORDS), block=16).cache()
    rng = random.Random(1)
    asked = [(i, c) for i, t in texts.items() for c in (0, 1, len(t) // 2, len(t), len(t) + 99, 16, rng.randint(0, 60))] + [(0, None), (3, -1), (99, 5)]
    got = token_counts.tokens_at(index, spark.createDataFrame(asked, "doc_id long, cut long"), block=16).collect()
    want = Counter((i, c, None if c is None or c < 0 or i == 99 else library(texts[i][:c])) for i, c in asked)
    assert Counter(map(tuple, got)) == want

    asked = [(i, b) for i in texts for b in (0, 1, 3, 10, 4000)] + [(0, None), (3, -1), (99, 5)]
    got = token_counts.truncations(index, spark.createDataFrame(asked, "doc_id long, budget long"), block=16).collect()
    short = {i: [library(t[:c]) for c in range(len(t) + 1)] for i, t in texts.items() if len(t) < 600}
    seen = 0
    for r in got:
        if r["doc_id"] in short and r["budget"] is not None and r["budget"] >= 0:
            counts = short[r["doc_id"]]
            cut = max(c for c, n in enumerate(counts) if n <= r["budget"])
            assert (r["cut"], r["n_tokens"]) == (cut, counts[cut])
            seen += 1
        elif r["budget"] is None or r["budget"] < 0 or r["doc_id"] == 99:
            assert r["cut"] is None
    assert seen == 5 * len(short) and len(got) == len(asked)
    index.unpersist()
