from __future__ import annotations

import numpy as np

from tessela.llm.vectors import CentroidGraph, ListParams, fit_centroids, nearest, usable

P = ListParams(dimension=16, list_size=64, sample=2_000, posting_block=50, query_block=40, probes=6)


def _data(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, 16))
    x = centres[rng.integers(0, len(centres), n)] + 0.4 * rng.normal(size=(n, 16))
    return x.astype(np.float32), rng.integers(0, n // 5, n)


def _brute(x, grp, ids, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    s[grp[:, None] == grp[None]] = -9
    top = np.argsort(-s, axis=1)[:, :k]
    return {(ids[i], ids[j]) for i in range(len(x)) for j in top[i]}


def test_recall_against_brute_force(spark):
    x, grp = _data()
    ids = [f"v{i:05}" for i in range(len(x))]
    rows = [(i, f" A{g} " if n % 2 else f"a{g}", v.tolist()) for n, (i, g, v) in enumerate(zip(ids, grp, x))]
    df = spark.createDataFrame(rows + rows[:50], "id string, asset string, vector array<float>").repartition(5)
    got = {(r["id"], r["other"]) for r in nearest(usable(df, "id", "asset", "vector", 16), 5, P).collect()}
    want = _brute(x, grp, ids)
    assert len(got & want) / len(want) >= 0.9 and all(a != b for a, b in got)
    assert len(got) == 5 * len(x)


def test_dirty_vectors(spark):
    ok = [1.0] + [0.5] * 15
    data = [("a", "g", ok), ("b", "h", ok), ("c", None, ok), ("d", "x", [0.0] * 16), ("e", "x", [1.0] * 15), ("f", "x", None), ("g", "x", []), ("h", "x", [float("nan")] * 16), ("i", "x", [None] * 16), (None, "x", ok)]
    df = spark.createDataFrame(data, "id string, asset string, vector array<float>")
    got = {(r["id"], r["other"]) for r in nearest(usable(df, "id", "asset", "vector", 16), 5, P).collect()}
    assert got == {(a, b) for a in "abc" for b in "abc" if a != b}


def test_one_list_holds_a_third(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 16))
    df = spark.createDataFrame([(f"v{i}", f"g{i}", v.tolist()) for i, v in enumerate(x)], "id string, asset string, vector array<float>")
    assert nearest(usable(df, "id", "asset", "vector", 16), 5, P).count() == 3000


def test_graph_finds_the_nearest_centroids():
    x, _ = _data(3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = fit_centroids(u, 200)
    ids, _ = CentroidGraph(c).search(u[:500], 6)
    best = np.argmax(u[:500] @ c.T, axis=1)
    assert (ids[:, 0] == best).mean() > 0.95
    sizes = np.bincount(np.argmax(u @ c.T, axis=1), minlength=len(c))
    assert sizes.max() < 6 * sizes.mean()


def test_single_and_none(spark):
    df = spark.createDataFrame([("a", "g", [1.0] * 16)], "id string, asset string, vector array<float>")
    assert nearest(usable(df, "id", "asset", "vector", 16), 5, P).count() == 0
    assert nearest(usable(df.limit(0), "id", "asset", "vector", 16), 5, P).count() == 0


def test_one_group_fills_its_lists(spark):
    """Vectors whose nearest lists hold their own group only search on in farther lists until they have k neighbours."""
    rng = np.random.default_rng(2)
    far = rng.normal(size=(20, 16))
    x = np.concatenate([np.ones((700, 16)) + 0.02 * rng.normal(size=(700, 16)), -np.ones((300, 16)) + 0.5 * far[rng.integers(0, 20, 300)]])
    df = spark.createDataFrame([(f"v{i}", "one" if i < 700 else f"g{i}", v.tolist()) for i, v in enumerate(x)], "id string, asset string, vector array<float>")
    got = nearest(usable(df, "id", "asset", "vector", 16), 5, P).groupBy("id").count().collect()
    assert len(got) == 1000 and all(r["count"] == 5 for r in got)
