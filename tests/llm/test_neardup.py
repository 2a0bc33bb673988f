from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest

from adjudica.llm import neardup
from adjudica.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def slow_groups(texts):
    """The smallest index that links of Jaccard similarity 0.8 reach, and how many pairs are linked but not equal."""
    sets, at, root, pairs = [slow_set(t) for t in texts], defaultdict(list), list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x]).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                pairs += s != sets[j]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            at[x].append(i)
    return [find(i) for i in range(len(texts))], pairs


@pytest.mark.parametrize("block", [4096, 2])
def test_stage_against_brute_force_jaccard(spark, sf, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = documents(spark, sf)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    groups, pairs = slow_groups([t for _, t in rows])
    assert pairs >= 10
    got = dict(cp.STAGES)["SimHash near-dedup"](spark, docs, sf)
    assert tuple(got.columns) == cp.COLUMNS
    assert sorted(r["doc_id"] for r in got.collect()) == [rows[k][0] for k in sorted(set(groups))]


@pytest.mark.parametrize("texts,size", [(1000, 90), (1 << 30, 90), (1000, 900), (1000, 9)])
def test_recall_of_the_grids(texts, size):
    """Pairs right at the similarity of 0.8; texts with nothing in common seldom meet."""
    rng, found, met, grids = np.random.default_rng(3), 0, 0, neardup.Grids(texts)
    trials = 300
    for _ in range(trials):
        n, both = size // 9, np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        common, own = both[n:], both[:n]
        a, b = (np.unique(np.r_[common, x]) for x in (own, rng.integers(0, 1 << 63, n, dtype=np.uint64)))
        found += bool(set(grids.cells(a).tolist()) & set(grids.cells(b).tolist()))
        met += bool(set(grids.cells(a).tolist()) & set(grids.cells(rng.integers(0, 1 << 63, size, dtype=np.uint64)).tolist()))
    assert found >= 0.99 * trials and met <= 0.1 * trials


def test_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(5)
    for n in (5, 300, 30_000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[n // 3 :], rng.integers(0, 1 << 64, n // 4, dtype=np.uint64)])
        x, y = neardup.folded([neardup.coarse(s) for s in (a, b)]).astype(int)
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_chains_and_rows_without_id(spark):
    words = [f"w{k}" for k in range(100)]
    chain = [" ".join(words[4 * k : 4 * k + 60]) for k in range(6)]  # neighbours 52 of 60, ends far apart
    rows = [(k + 10, t) for k, t in enumerate(chain)] + [(None, chain[0] + " more"), (None, "alone a b c d e"), (None, "Alone a b c d e"), (None, "alone a b c d e"), (5, ""), (6, None), (7, "a b"), (7, "a b")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = neardup.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 5, 7, 10] and {r["text"].lower() for r in got if r["doc_id"] is None} == {"alone a b c d e"}
    assert neardup.one_of_each(docs.limit(0)).collect() == []
