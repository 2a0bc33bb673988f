import math

import numpy as np
import pytest

from adjudica.llm import neighbours


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for q, rank, v, score in rows_of(neighbours.nearest(vectors)):
        got.setdefault(q, []).append(v)
        assert rank == len(got[q]) and math.isclose(score, float(x[ids == q][0] @ x[ids == v][0]), abs_tol=1e-12)
    found = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        found += len(set(got[q]) & set([i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]))
        assert len(got[q]) == 20
    assert found / (20 * len(got)) >= 0.9


def test_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(1, 60)] + [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (120, None), (140, [1.0, None]), (160, [nan, 1.0]), (180, [inf, 1.0]), (None, [1.0, 1.0]), (200, [-1.0, 0.5]), (220, []), (240, [1.0, 2.0, 3.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for q, rank, v, score in rows_of(neighbours.nearest(df)):
        got.setdefault(q, []).append((v, score))
    assert got[0] == [(i, 1.0) for i in range(1, 21)]
    assert got[20] == [(i, 1.0) for i in [*range(20)]]
    assert set(got) == {0, 20, 40, 200}
    assert got[200] == [(i, -1.0) for i in range(20)]
    assert neighbours.nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert rows_of(neighbours.nearest(few)) == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]


def clusters(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 100, 64))[rng.integers(0, n // 100, n)] + rng.standard_normal((n, 64)) * 0.08
    return x / np.sqrt((x * x).sum(1))[:, None]


def plain(x, ids, query, query_id, k):
    """The k best ids, each once, with the best of its scores."""
    best = {}
    for i, s in zip(ids.tolist(), (x @ query).tolist()):
        if i != query_id:
            best[i] = max(s, best.get(i, -np.inf))
    return sorted(best, key=lambda i: (-best[i], i))[:k]


def test_repeated_ids(spark):
    """Ids with two vectors each: a query searches with the smaller one, a candidate counts once."""
    rng = np.random.default_rng(8)
    x, ids = rng.standard_normal((900, 8)), np.repeat(np.arange(450), 2)
    got = {}
    for q, rank, v, score in rows_of(neighbours.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"))):
        got.setdefault(q, []).append(v)
        assert rank == len(got[q])
    found = 0
    for q in range(0, 450, 20):
        assert len(got[q]) == 20 == len(set(got[q])) and q not in got[q]
        found += len(set(got[q]) & set(plain(x, ids, np.array(min(x[ids == q].tolist())), q, 20)))
    assert set(got) == set(range(0, 450, 20)) and found / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("kind", ["even", "clusters", "norms"])
def test_recall_over_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 2500)
    monkeypatch.setattr(neighbours, "QUERIES", 100)
    rng = np.random.default_rng(1)
    x = {"even": rng.standard_normal((9000, 64)), "clusters": clusters(9000), "norms": rng.standard_normal((9000, 64)) * rng.uniform(0.2, 3, (9000, 1))}[kind]
    got, ids = {}, np.arange(9000)
    for q, _, v, _ in rows_of(neighbours.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))):
        got.setdefault(q, []).append(v)
    found = [len(set(got[q]) & set(plain(x, ids, x[q], q, 20))) / 20 for q in range(0, 9000, 200)]
    assert len(got) == 450 and np.mean(found) >= 0.9


def test_on_clusters_little_is_touched():
    """The sorted arrays are walked from the query outwards: most of them, and nearly all vectors, are never looked at."""
    x, touched = clusters(20_000), []
    neighbours.search(x, np.arange(20_000), x[:50], np.arange(50), 20, touched)
    walked, verified = np.array(touched).reshape(-1, 2).mean(0)
    assert verified < 400 and walked / neighbours.PROJECTIONS < 0.2 * 20_000


def test_few_and_no_candidates():
    x = np.array([[1.0, 0.0], [0.5, 0.5], [0.5, 0.5]])
    assert [c.tolist() for c in neighbours.search(x[:1], np.array([7]), x[:1], np.array([7]), 20)] == [[], [], []]
    assert [c.tolist() for c in neighbours.search(x, np.array([3, 4, 4]), x[:1], np.array([3]), 20)] == [[3], [4], [0.5]]
