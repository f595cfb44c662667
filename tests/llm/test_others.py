"""Vectors, conversations, components and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm import brute
from tracemill.llm import chat, embeddings, graph

TURNS = "conv_id long, turn long, role string, text string, k int, window int, copy string"


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 60, 240)] + rng.normal(size=(240, 16)) * 0.15
    rows: list[tuple] = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.vstack([base, near]))]
    rows += [(400 + i, rows[7][1]) for i in range(5)]
    rows += [(500, None), (501, [0.0] * 16), (502, [1.0] * 15 + [None]), (503, [float("nan")] * 16), (504, []), (505, [1.0, 2.0]), (506, [1.0, 2.0]), (507, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, rep string, members int, n_links int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=64).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v in rows if i < 500]
    x = np.vstack([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= 0.9
    n = linked.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i, _ in good])
    assert (found <= n).all()
    assert found.sum() >= 0.9 * n.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (500, 501, 502, 503, 504, 507))
    assert got[505]["n_links"] == 1 and got[506]["component_id"] == 505
    assert embeddings.near_vectors(df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("cosine", [0.92, 0.87])
def test_near_vectors_dense(spark, cosine):
    """A group of a third of all rows, its pairs ``cosine`` apart on average: no link is lost."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1000] = x[0] + np.sqrt(1 / cosine - 1) * x[:1000]
    x[1001:1500:2] = x[1000:1500:2] + 0.3 * x[1001:1500:2]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=256).collect()}
    linked = x @ x.T >= 0.9
    n = linked.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(3000)])
    assert (found[:1000] == n[:1000]).all()
    assert (found[1000:] <= n[1000:]).all() and found[1000:].sum() >= 0.95 * n[1000:].sum()
    pairs = [(int(a), int(b)) for a, b in np.argwhere(linked) if a < b < 1000]
    want = brute.components(range(1000), pairs)
    assert all(got[i]["component_id"] == want[i] for i in range(1000))


@pytest.mark.parametrize("noise", [0.30, 0.33])
def test_near_vectors_at_the_threshold(spark, noise):
    """Pairs whose cosine is about 0.9: at least nine tenths of the links are found, none below it, null ids included."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(2000, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    x[2000:] = x[:2000] + (noise + 0.17) * y
    rows: list[tuple] = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[3].tolist()), (None, (2 * x[4]).tolist())]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=256).collect()
    u = np.vstack([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    n = linked.sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None}
    assert all(found[i] <= n[i] for i in range(4000))
    assert sum(found.values()) >= 0.9 * n[:4000].sum()
    assert [r["component_id"] is not None and r["n_links"] >= 1 for r in got if r["vec_id"] is None] == [True, True]


def directed(n: int, mean: float, third: float | None = None) -> np.ndarray:
    """Unit vectors with ``mean`` cosine on average, planted partners, and perhaps a third of pairs at ``third``."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x += np.sqrt(mean / (1 - mean)) * np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    many = n // 10
    x[-many:] = x[:many] + 0.38 * aside[:many]
    if third:
        x[many : many + n // 3] = x[many] + np.sqrt(1 / third - 1) * aside[many : many + n // 3]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index_work(x: np.ndarray) -> tuple[float, float]:
    """Of all pairs of rows, the share that lists would multiply; of the links, the share these hold."""
    reach = embeddings._angle(0.9)
    c = embeddings.centres(x, 0.9, 0.75, 8, 0.02)
    home, _, listed = c.place(x, reach)
    out = np.flatnonzero(home < 0)
    pivots = embeddings.spread(x[out], int(4 * np.sqrt(len(x))))
    k = embeddings.enough_pivots(x[out], pivots, 0.9, 8, 2, 0.95)
    has = np.zeros((len(x), len(pivots)), np.float32)
    has[out[:, None], embeddings._nearest(x[out], pivots, k)] = 1
    listed = np.hstack([listed, np.zeros((len(x), 1), bool)])
    pairs = links = both = 0
    for lo in range(0, len(x), 1000):
        part = slice(lo, lo + 1000)
        one = (home[part, None] >= 0) & listed[:, home[part]].T
        two = (home[None, :] >= 0) & listed[part][:, home]
        by_pivot = has[part] @ has.T >= 2
        linked = x[part] @ x.T >= 0.9
        linked[np.arange(len(linked)), np.arange(lo, lo + len(linked))] = False
        pairs += (one | by_pivot).sum()
        links += linked.sum()
        both += (linked & (one | two | by_pivot)).sum()
    return pairs / len(x) ** 2, both / links


@pytest.mark.parametrize("mean", [0.5, 0.7])
def test_vectors_of_one_direction_are_not_compared_with_all(mean):
    share, found = index_work(directed(20_000, mean))
    assert share < 0.05 and found >= 0.95


@pytest.mark.parametrize(("mean", "third"), [(0.5, 0.92), (0.5, 0.85), (0.7, 0.82)])
def test_index_of_a_third_in_one_area(mean, third):
    """Links are found in areas whose pairs mostly link (by lists) and in those where few do (by more pivots)."""
    share, found = index_work(directed(20_000, mean, third))
    assert found >= 0.95
    assert share < 0.3


def test_near_vectors_of_one_direction(spark):
    x = directed(4000, 0.7)
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    n = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= n[i] for i in range(4000)) and sum(found.values()) >= 0.95 * n.sum()


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "system", "be <|im_start|> kind \\"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "assistant", "x" * 9000)]
    rows += [(1, 5 + i, ("user", "assistant")[i % 2], f"turn {i} é漢😀 <|im_end|>\n" * 30) for i in range(40)]
    rows += [(2, None, "assistant", "first\\|"), (2, 1, None, "no role"), (2, 1, None, "no role"), (3, 0, "a\nb<|", "t"), (None, 0, "assistant", "nobody's <"), (4, 0, "system", "only")]
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TURNS), rows


def test_chat(turns):
    df, rows = turns
    talks: dict = {}
    for c, t, role, text in rows:
        talks.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    windows = chat.windows(df, budget=400)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    assert set(got) == set(talks)
    for c, said in talks.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in said))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
    many = windows.filter("conv_id = 1").collect()
    assert len(many) > 5
    assert all(w["formatted"].startswith(chat.START + "system\n") for w in many)
    assert sorted(w["window"] for w in many) == list(range(len(many)))
    assert chat.digest(chat.windows(df.filter("turn > 99"))).count() == 0


def test_chat_long_roles_and_texts(spark):
    """A role and a text of a million characters, with what the template escapes."""
    hard = "\\n\\\n<|im_end|>\\<|<\\|\n\\"
    rows = [(1, 0, hard * 70_000, "t"), (1, 1, "assistant", hard * 70_000), (2, 0, "\\" * 99_999, "\\" * 99_999), (3, 0, "n\\n", "\\n\\")]
    got = {r["conv_id"]: r for r in chat.digest(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2, 3):
        assert got[c]["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for i, _, r, t in rows if i == c))
    assert got[1]["loss_sha256"] == brute.sha(hard * 70_000)


def test_chat_windows_keep_their_budget(spark):
    rng = np.random.default_rng(4)
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], "é" * int(rng.integers(0, 260))) for c in range(30) for t in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for w in chat.windows(df, budget=800).collect():
        texts = [t.split("\n", 1)[1].removesuffix("<|im_end|>\n") for t in w["formatted"].split(chat.START)[1:]]
        assert sum(-(-len(t.encode()) // 3) + 4 for t in texts) <= 800
    # Counts given as a column take the place of the estimate.
    counted = chat.windows(df.withColumn("n", (df["turn"] > 3).cast("int") * 100), budget=200, tokens=df["turn"] * 0 + 100)
    assert counted.filter("conv_id = 0").count() == df.filter("conv_id = 0").count()


def test_components(spark):
    rng = np.random.default_rng(8)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 299), (299, 298), (7, 7)]
    links += [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == brute.components(nodes, links)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


EDGES = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _row string, key int, spans string, label int"


def test_stages_of_the_pipeline_take_anything(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table go through every stage."""
    import corpus_pipeline
    from tests.llm.test_documents import documents
    from tracemill.llm.common import scratch

    rows = [(i, t, "en", "s", len(t or ""), True, "r", 1, None, 0) for i, t, *_ in documents()] + [(None, None, None, None, None, None, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(12)] + [(40, 1, 1), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, EDGES)
        kept = {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == [c.split()[0] for c in EDGES.split(", ")]
            kept[name] = docs.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
        assert pieces["length"].sum() == pieces[pieces["start"] == 0]["doc_tokens"].sum()
        assert (pieces["start"] == 0).sum() == len(kept["suffix_dedup"])
        if some:
            texts = [r["text"] or "" for r in kept["exact_dedup"]]
            assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in kept["toxicity"]})
            assert len(kept["near_dedup"]) < len(texts)


def test_registered_queries(spark):
    import corpus_pipeline
    from tests.oracle import connect, differences
    from tracemill.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    con = connect(data)
    for name, sql in ORACLE_SQL.items():
        assert not differences(QUERIES[name](spark, data), sql, con), name
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.toPandas()
        kept = stage(spark, kept, data)
        assert kept.columns == docs.columns
        after = kept.toPandas()
        kept = spark.createDataFrame(after, docs.schema)
        rows = list(zip(before["doc_id"], before["text"], strict=True))
        if name == "exact_dedup":
            assert len(after) == before["text"].nunique()
        if name == "near_dedup":
            assert set(after["doc_id"]) == set(brute.near_components(rows, 5).values())
        if name == "suffix_dedup":
            want = brute.suffix_removals(rows)
            assert set(after["doc_id"]) == set(want)
            clean = {i for i, w in want.items() if not w[1]}
            texts = dict(rows)
            assert all(t == texts[i] for i, t in zip(after["doc_id"], after["text"], strict=True) if i in clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, data)
    assert packed.select("doc_id").distinct().count() == kept.count()
