"""Operators on documents: small tables with nulls, empty and long texts, repeats and clashing names."""

from __future__ import annotations

import random
import re
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracemill.llm import bpe, exact_dedup, hashing, licenses, minhash, packing, quality, suffix, toxicity
from tracemill.llm.common import only, scratch
from tracemill.llm.vocabulary import byte_encoder, path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, label int, rep long, _maybe boolean"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(12)]
    passage = words(rng, 60)
    texts: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    for i in range(8):  # near copies of one text
        w = base[0].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append((20 + i, " ".join(w)))
    texts += [(30 + i, base[1]) for i in range(6)]  # exact copies
    texts += [(40 + i, f"{words(rng, 20 + i)} {passage} {words(rng, 20)}") for i in range(6)]
    texts += [(50, None), (51, ""), (52, "   "), (53, "one"), (54, "one"), (55, "two words"), (56, "x" * 5000), (57, words(rng, 6000)), (58, "é漢😀 " * 60), (59, "A" + base[2][1:])]
    texts += [(60, base[3]), (60, base[3]), (None, base[4]), (None, None)]
    return [(i, t, "en", "s", len(t or ""), True, "k", 1, 0, False) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    rows = [(d[0], d[1] or "") for d in documents()]
    got = exact_dedup.decisions(docs).collect()
    assert len(got) == len(rows)
    by_text: dict[str, list] = {}
    for i, t in rows:
        by_text.setdefault(brute.sha(t), []).append(i)
    for r in got:
        ids = by_text[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == (max(known) if known else None, len(ids))
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(brute.sha(r["text"] or "") for r in left.collect()) == sorted(by_text)
    assert exact_dedup.decisions(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, width):
    rows = [(d[0], d[1]) for d in documents() if d[0] is not None]
    want = brute.near_components(rows, width)
    sets = brute.word_sets(rows, width)
    got = minhash.near_duplicates(docs, width=width, block=3).collect()
    assert len(got) == len(documents())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {None} | set(brute.near_components(rows, 5).values())


def test_words_that_modular_hashes_confuse(spark):
    """Thue-Morse words and their complements share no shingle."""
    rows = []
    for i, n in enumerate((1024, 2048, 65_536)):
        bits = [bin(k).count("1") % 2 for k in range(n)]
        rows += [(10 * i + 1, "".join("ab"[b] for b in bits) + " x"), (10 * i + 2, "".join("ba"[b] for b in bits) + " x")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)


def test_words_that_were_made_to_collide(spark):
    """Without a key, these words have equal hashes in pairs."""
    one = "4wsjlbcag3x6sv80 rs18bf38il5pj3jo 4jdko3qdmv309g5b 3dgig25ubdlpwrjf"
    two = "5otvu4eapgdwzqt1 7w6ghwwn0\"]][n(> 7tqqk83s.x+)5`7` m0mf6vd4xtu!n@//"
    plain = [hashing.words([t.encode()])[0] for t in (one, two)]
    keyed = [hashing.words([t.encode()], key=hashing.new_key())[0] for t in (one, two)]
    assert np.isin(*plain).any()
    assert not np.isin(*keyed).any()
    docs = spark.createDataFrame([(1, one), (2, two), (3, "another text of some words"), (4, one)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_blocks_of_two_threads(spark):
    """Each thread removes its own tables only."""
    inside, removed = threading.Event(), threading.Event()
    kept = {}

    def other():
        with only("other") as keep:
            table = scratch(spark.range(3), "mine")
            inside.set()
            removed.wait(60)
            kept["other"] = keep(table)

    thread = threading.Thread(target=other)
    with only("first") as keep:
        thread.start()
        inside.wait(60)
        kept["first"] = keep(scratch(spark.range(2), "own"))
    removed.set()
    thread.join()
    assert kept["first"].count() == 2 and kept["other"].count() == 3


def test_slices_of_the_filter(spark, docs, monkeypatch):
    """A filter of many slices gives the same rows, and the probed side is not exchanged."""
    from tracemill.llm import bloom

    monkeypatch.setattr(bloom, "SLICE_BYTES", 4096)
    keys = spark.range(0, 20_000, 2).withColumnRenamed("id", "key")
    some = bloom.Bloom(keys, 10_000)
    assert some.blocks > 2
    probed = some.probe(spark.range(40_000), F.col("id"))
    assert "Exchange hash" not in probed._jdf.queryExecution().executedPlan().toString()
    found = {r["id"] for r in probed.filter("_maybe").collect()}
    assert set(range(0, 20_000, 2)) <= found and len(found) < 11_000
    left = exact_dedup.deduplicate(docs)
    assert sorted(brute.sha(r["text"] or "") for r in left.collect()) == sorted({brute.sha(d[1] or "") for d in documents()})


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    small = a[:1]
    h = np.concatenate([a, b, small])
    owner = np.repeat([0, 1, 2], [1000, 1000, 1])
    s = minhash.sketch(h, owner, 4, 256)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[:3] != top).all() and (s[3] == top).all()  # every coordinate fills, however small the set


def test_suffix_removals(docs, empty):
    rows = [(d[0], d[1]) for d in documents() if d[0] is not None and d[0] != 60]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(docs.filter("doc_id <> 60 or doc_id is null")).collect()}
    want = brute.suffix_removals(rows)
    assert {k: v for k, v in got.items() if k is not None} == want
    twice = [tuple(r)[1:] for r in suffix.removals(docs).filter("doc_id = 60").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert suffix.removals(empty).count() == 0
    left = suffix.without_repeats(docs)
    assert left.columns == docs.columns
    assert left.count() == docs.count()
    assert left.filter("doc_id = 35").first()["text"] == ""
    assert left.filter("doc_id = 35").first()["n_chars"] == 0


def test_suffix_buckets_cut_groups(spark, monkeypatch):
    """Splitters inside the runs of one gram give the same result."""
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 40)
    rng = random.Random(9)
    shared = words(rng, 80)
    rows = [(i, f"{words(rng, 3)} {shared} {words(rng, 3)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(df).collect()} == brute.suffix_removals(rows)


def test_runs_that_hashes_confuse(spark, monkeypatch):
    """Where the hash of grams sees nothing, runs and chunks are still told apart; so are texts that a sum of
    powers confuses."""
    import numpy as np

    rng = random.Random(4)
    letters = [rng.choice("ab") for _ in range(300)]
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    rows = [(i, "".join(rng.choice("ab") for _ in range(160))) for i in range(30)] + [(100 + i, "".join(letters)) for i in range(2)]
    rows += [(200, "".join("ab"[b] for b in bits)), (201, "".join("ba"[b] for b in bits))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.suffix_removals(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(df).collect()} == want
    monkeypatch.setattr(suffix, "prefix", lambda data: np.zeros(len(data) + 1, np.uint64))
    r = suffix.runs([t.encode() for _, t in rows], 100, 50)
    assert len(set(r["gram"].tolist())) == 1
    by_text = {d: tuple(zip(r["one"][r["text"] == i], r["two"][r["text"] == i], strict=True)) for i, (d, _) in enumerate(rows)}
    assert by_text[100] == by_text[101] and by_text[200] != by_text[201]
    assert len({x for d, t in by_text.items() if d < 100 for x in t}) == sum(len(t) for d, t in by_text.items() if d < 100)


def test_ranges_of_buckets(spark, monkeypatch):
    """More buckets than are done at once: ranges one after the other give the same result."""
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 30)
    monkeypatch.setattr(suffix, "MAX_BUCKETS", 6)
    rng = random.Random(9)
    shared = words(rng, 60)
    rows = [(i, f"{words(rng, 30)} {shared} {words(rng, 3)}") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(df).collect()} == brute.suffix_removals(rows)


def test_buckets_by_splitters():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = {c: rng.integers(0, 4, 3000) for c in suffix.KEY}
    splitters = np.array(sorted(map(tuple, rng.integers(0, 4, (40, 6)).tolist())))
    cut = [tuple(s) for s in splitters.tolist()]
    want = [sum(c <= k for c in cut) for k in zip(*(rows[c].tolist() for c in suffix.KEY), strict=True)]
    assert suffix.bucket_of(rows, splitters).tolist() == want
    two = splitters[:, :2]
    assert suffix.bucket_of(rows, two).tolist() == [sum(tuple(c) <= k for c in two.tolist()) for k in zip(rows["head"].tolist(), rows["gram"].tolist(), strict=True)]
    assert suffix.bucket_of(rows, splitters[:0]).tolist() == [0] * 3000


def test_multikey_quicksort():
    import numpy as np

    rng = np.random.default_rng(2)
    w = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffix.multikey_quicksort(w, np.arange(500))
    keys = [tuple(w[i]) for i in order]
    assert keys == sorted(keys)
    assert sorted(order) == list(range(500))


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    vocabulary = path("word_bpe_49k.json")
    tok = Tokenizer.from_file(vocabulary)
    rng = random.Random(3)
    extra = ["<|endoftext|>a <|startoftext|>", "IT'S don't 12 Σς İ ﬁ", "aaaaaaaaaaaaaaaaaaaaa hahahahaha", "́é \x00\x1f"]
    texts = [d[1] or "" for d in documents()] + extra
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = set()
    for t in (rng.choice(("a" * 9000, "ab1" * 4000, "漢字" * 3000)) for _ in range(3)):  # one long word
        assert bpe.word_bpe(vocabulary).encode(t) == tok.encode(t, add_special_tokens=False).ids
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.add((len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    assert {tuple(r)[1:] for r in bpe.encode_digests(df, vocabulary).collect()} == want
    assert bpe.encode_digests(empty, vocabulary).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, vocabulary).collect()}
    assert ids[53] == tok.encode("one", add_special_tokens=False).ids


def test_packing(docs, empty):
    import numpy as np

    encoder = byte_encoder(path("byte_bpe_50k.json"))
    got = packing.pack(docs, path("byte_bpe_50k.json"), fan_in=2).toPandas()
    one = got[got["doc_id"].notna() & (got["doc_id"] != 60)]
    for i, t in [(d[0], d[1] or "") for d in documents() if d[0] is not None and d[0] != 60]:
        ids = [*encoder.encode(t), 1]
        mine = one[one["doc_id"] == i].sort_values("start")
        at = 0
        for p in mine.itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 2048
        assert list(s["offset"]) == list(s["length"].cumsum() - s["length"])
    assert packing.pack(empty, path("byte_bpe_50k.json")).count() == 0


def test_packing_repeated_and_null_ids(spark):
    """Each row is packed on its own, whatever its id."""
    import numpy as np

    encoder = byte_encoder(path("byte_bpe_50k.json"))
    rng = random.Random(8)
    rows = [(7, words(rng, 900)), (7, words(rng, 30)), (7, "same"), (7, "same"), (None, words(rng, 1500)), (None, None), (None, "same"), (8, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path("byte_bpe_50k.json"), fan_in=2).toPandas()
    want: dict = {}
    for i, t in rows:
        ids = np.array([*encoder.encode(t or ""), 1], "<u4")
        want.setdefault(i, []).append(ids)
    for i, texts in want.items():
        mine = got[got["doc_id"].isna() if i is None else got["doc_id"] == i]
        assert mine["length"].sum() == sum(map(len, texts))
        pieces = list(zip(mine["start"], mine["length"], mine["doc_tokens"], mine["ids_crc32"], strict=True))
        made = [(s, n, len(ids), zlib.crc32(ids[s : s + n].tobytes())) for ids in texts for s, n, total, _ in pieces if total == len(ids) and s + n <= total]
        assert all(p in made for p in pieces)
        assert sum(s == 0 for s, *_ in pieces) == len(texts)
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_packing_leaves_little(monkeypatch):
    """What a worker leaves open is a few pieces, however many small ones it has."""
    bins = packing.Bins(0, 2048)
    rng = random.Random(2)
    for _ in range(30_000):
        n = rng.choice([1, 2, 3, 20, 64, 65, 300, 1025, 2000])
        at = 0
        for size, k in packing.cuts(n, 2048, 64):
            bins.put([0, at, size, 0, n, None, None, 0, k], k)
            at += size
    assert sum(map(len, bins.open.values())) <= 31 * 32 // 2 + 2048
    left = [p for p in bins.first_fit(0.95) if p[5] is None]
    assert sum(p[2] for p in left) <= 2 * 2048


def test_cuts():
    for n in range(1, 2048):
        pieces = packing.cuts(n, 2048, 64)
        assert sum(p for p, _ in pieces) == n
        assert all(p * k <= 2048 for p, k in pieces)


def test_license_with_words_inside():
    """A notice with foreign words in its middle is found wherever the blocks fall."""
    rng = random.Random(6)
    notice = licenses.TEMPLATES[2][1].split()
    index = licenses.Templates(licenses.TEMPLATES, 32)
    for inserted in (16, 60):
        half = len(notice) // 2
        texts = [f"{words(rng, n)} {' '.join(notice[:half])} {words(rng, inserted)} {' '.join(notice[half:])} {words(rng, 90)}".encode() for n in range(60)]
        found = {d for d, i, share, _ in index.scan(texts, 0.8) if i == 2 and share >= 0.8}
        assert found == set(range(60))
    assert not index.scan([f"{' '.join(notice[:half])} {words(rng, 90)}".encode()], 0.8)


def brute_licenses(rows):
    """(doc_id, license) -> share, for every template in every whole text."""
    def grams(text):
        w = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = {}
    for i, t in rows:
        mine = grams(t or "")
        for name, template in licenses.TEMPLATES:
            share = len(grams(template) & mine) / len(grams(template))
            if share >= 0.8:
                out[i, name] = max(share, out.get((i, name), 0))
    return out


def test_licenses_equal_a_plain_scan(spark):
    """Whole notices, notices with words changed, cut or put in, two in one text, repeated rows and null ids."""
    rng = random.Random(12)
    rows = []
    for k in range(400):
        w = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1].split()
        kind = k // 16 % 5
        if kind == 1:
            w[rng.randrange(len(w))] = "changed"
        elif kind == 2:
            w = w[: int(len(w) * 0.9)]
        elif kind == 3:
            w.insert(len(w) // 2, words(rng, 2))
        elif kind == 4:
            w += licenses.TEMPLATES[(k * 7 + 3) % len(licenses.TEMPLATES)][1].split()
        rows.append((k, f"{words(rng, rng.randrange(80))} {' '.join(w)} {words(rng, rng.randrange(80))}"))
    rows += [(5, rows[5][1]), (None, licenses.TEMPLATES[0][1]), (900, None), (901, "of the MIT License"), (902, "")]
    want = brute_licenses(rows)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r["doc_id"], r["license"]): r["containment"] for r in got}
    assert found.keys() == want.keys()
    assert all(found[k] <= want[k] + 1e-9 for k in found)
    assert sum(r["doc_id"] == 5 for r in got) == 2 * sum(k[0] == 5 for k in want)
    assert found[None, "MIT"] == 1.0


def test_licenses(docs, empty):
    rng = random.Random(3)
    texts = [f"{words(rng, n)}\n{t}\n{words(rng, 50)}" for n, (_, t) in zip((0, 3, 10, 50, 999), licenses.TEMPLATES, strict=False)]
    df = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}
    assert {(i, licenses.TEMPLATES[i][0]) for i in range(len(texts))} <= got
    assert licenses.scan(docs).count() == 0
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError, match="words"):
        licenses.Templates([("x", "too few")], 4)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, words(rng, 80) + (" vileword nastyword" * rng.randint(1, 6) if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (5000, None, None)])
    grader = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.grade(df, grader).collect()}
    wrong = [i for i in range(200, 400) if got[i]["toxic"] != (i % 4 == 0)]
    assert len(wrong) <= 2
    assert list(grader.thresholds) == sorted(grader.thresholds)
    mild, severe = (sum(got[i]["severity"] for i, t in rows if t.count("vileword") == n) / max(1, sum(t.count("vileword") == n for _, t in rows)) for n in (1, 6))
    assert severe > mild
    assert toxicity.grade(docs, grader).count() == docs.count()
    assert toxicity.grade(empty, grader).count() == 0
    assert toxicity.reject(docs, grader).columns == docs.columns
    nothing = toxicity.fit(df, labels_of(spark, []))
    assert toxicity.grade(df, nothing).filter("toxic").count() == 0


def test_toxicity_of_held_out_tables(spark):
    """Fitted on two thirds of the labels, judged on the rest; scores equal a plain sum over the weights."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    grader = toxicity.fit(docs, labels.filter(~held))
    gold = labels.filter(held).select("doc_id", F.col("toxic").alias("gold")).filter("gold is not null")
    some = docs.join(gold.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity.grade(some, grader).join(gold, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    caught, alone = ([r["toxic"] for r in scored if r["gold"] == g] for g in (1, 0))
    assert len(caught) >= 100 and sum(caught) >= 0.9 * len(caught)
    assert len(alone) >= 1000 and sum(alone) <= 0.005 * len(alone)
    rows = [(r["doc_id"], r["severity"], r["text"]) for r in scored]
    for _, severity, text in rows[:200]:
        counts: dict = {}
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for f in [w] + [w[:n] + "*" for n in (4, 5) if len(w) >= n]:
                if f in grader.features:
                    counts[f] = counts.get(f, 0) + 1
        z = sum(grader.weights[grader.features[f]] * math.log1p(n) for f, n in counts.items())
        assert severity == pytest.approx(sum(1 / (1 + math.exp(min(50, max(-50, t - z)))) for t in grader.thresholds), abs=1e-9)


def test_toxicity_of_one_text_under_two_labels(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, 40) + (" vileword nastyword" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(500, "twice told vileword"), (501, "twice told vileword")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(500, 1, 0), (501, 1, 1)])
    one, two = toxicity.fit(df, labels), toxicity.fit(df.repartition(5), labels.repartition(3))
    assert one.features == two.features and (abs(one.weights - two.weights) < 1e-9).all()
    sample = toxicity.one_of_each(df.join(labels, "doc_id").select("text", F.col("toxic").alias("label"), F.lit(1 / 202).alias("weight"))).collect()
    assert [r["label"] for r in sample if r["text"].startswith("twice")] == [1]
    assert sum(r["weight"] for r in sample) == pytest.approx(1)


def test_quality_of_held_out_tables(spark):
    from tracemill.llm.queries import op8_quality

    scored = op8_quality(spark, "/root/testdata/sf0.01").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = scored.join(labels.filter("quality is not null"), "doc_id").collect()
    assert len(got) > 30
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, words(rng, 60) if i % 3 else " ".join([words(rng, 2)] * 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranker = quality.fit(df, labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(150)]))
    got = {r["doc_id"]: r["score"] for r in quality.score(df, ranker).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in range(150, 300)) >= 145
    assert all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs, ranker).filter(F.col("score").isNull()).count() == 0
    assert quality.score(empty, ranker).count() == 0
    assert {r["score"] for r in quality.score(df, quality.fit(df, labels_of(spark, []))).collect()} == {0.5}


def test_quality_is_fitted_on_every_labelled_row(spark, monkeypatch):
    """Each row is first in one block, each block compares both classes, and the mark is the exact quantile of all rows."""
    monkeypatch.setattr(quality, "BLOCK", 50)
    monkeypatch.setattr(quality, "OTHERS", 10)
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 9 == 0), [float(v) for v in rng.random(19)]) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, label int, x array<double>")
    made = quality.blocks(df, {0: 1600, 1: 200}).collect()
    good, own = ([np.frombuffer(r[c], bool) for r in made] for c in ("good", "own"))
    assert sum(int(o.sum()) for o in own) == 1800 and all(g.any() and not g.all() for g in good)
    placed = sorted(tuple(v) for r, o in zip(made, own) for v in np.frombuffer(r["x"]).reshape(len(o), -1)[o].tolist())
    assert placed == sorted(tuple(x) for _, _, x in rows)
    values = [*rng.normal(size=300).tolist(), 0.0, -0.0, 0.0, 5.0, 5.0, 5.0, -7.5, 1e300, -1e300]
    s = spark.createDataFrame([(v,) for v in values], "s double")
    for k in (0, 1, 150, 153, 305, len(values) - 1):
        assert quality.ranked(s, k) == sorted(values)[k]
    stats = df.select("doc_id", F.transform("x", lambda x: x + F.col("label") * 0.3).alias("x"))
    ranker = quality.fit_measured(stats, df.select("doc_id", F.col("label").alias("quality")))
    over = quality.score_measured(stats, ranker).filter("score > 0.5").count()
    assert over == 200
