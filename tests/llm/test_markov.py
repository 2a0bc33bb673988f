import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from adjudica.llm import markov
from adjudica.llm.common import documents


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(rows)}
    c = Counter(w for k, (d, _) in enumerate(rows) if not out(d) for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return [(d, out(d), len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k])) for k, (d, _) in enumerate(rows)]


def test_base_and_gain(spark, sf):
    docs = documents(spark, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {w[0]: w for w in base(rows)}
    got = markov.scored(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5] and math.isclose(r["base_score"], w[5], rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.02 * sum(r["n_tokens"] for r in held)


@pytest.mark.parametrize("steps", [1 << 18, 2])
def test_recursions_are_exact(monkeypatch, steps):
    monkeypatch.setattr(markov, "STEPS", steps)
    rng = np.random.default_rng(1)
    part = lambda x, axis: x / x.sum(axis, keepdims=True)
    first, step, shows = part(rng.random(3), -1), part(rng.random((3, 3)), -1), part(rng.random((4, 3)), 0)
    strings = [rng.integers(0, 4, n) for n in (1, 5, 3, 4, 6)]

    def slow(s):
        return math.log10(sum(first[z[0]] * math.prod(step[a, b] for a, b in zip(z, z[1:])) * math.prod(shows[x, a] for a, x in zip(z, s)) for z in product(range(3), repeat=len(s))))

    assert np.allclose(markov.forward(first, step, shows, strings), [slow(s) for s in strings])
    for own in ([*strings[:4]], [strings[4]], [strings[1]]):
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
        for s in own:
            total = 10 ** slow(s)
            for z in product(range(3), repeat=len(s)):
                p = first[z[0]] * math.prod(step[a, b] for a, b in zip(z, z[1:])) * math.prod(shows[x, a] for a, x in zip(z, s)) / total
                start[z[0]] += p
                for a, b in zip(z, z[1:]):
                    move[a, b] += p
                for a, x in zip(z, s):
                    emit[x, a] += p
        for got, want in zip(markov.expected(first, step, shows, own), (start, move, emit)):
            assert np.allclose(got, want, atol=1e-9)


def test_model_against_plain_numpy(spark, monkeypatch):
    """Two rounds over the whole corpus in one place, and the same through blocks and buckets, one of them with numbers above 65,536."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 80), p=(w := rng.random(60) ** 4) / w.sum()))) for k in range(120)]
    monkeypatch.setattr(markov, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(markov, "BUCKET_BYTES", 1)  # buckets: one for each byte
    docs = spark.createDataFrame(rows * 30, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in markov.scored(docs, 3, 2).collect()}
    rows = rows * 30
    names = sorted({w for _, t in rows for w in t.split()} | {"\n"})
    number = {w: k for k, w in enumerate(names)}
    strings = [np.array([number[w] for w in [*t.split(), "\n"]]) for _, t in rows]
    train = [s for s, (d, _) in zip(strings, rows) if not out(d)]
    count = np.bincount(np.concatenate(train), minlength=len(names))
    n, v = count.sum(), (count > 0).sum()
    import xxhash

    shares = markov.first_shares(np.array([xxhash.xxh64_intdigest(w.encode()) for w in names], np.uint64), 3)
    start, move = np.full(3, 1 / 3), np.full((3, 3), 0.2 / 3) + np.eye(3) * 0.8
    for _ in range(3):
        gathered = (shares * count[:, None]).sum(0)
        emit = markov.emissions(shares * markov.WHOLE, count, n, v, gathered)
        unseen = markov.emissions(np.zeros((1, 3)), np.zeros(1), n, v, gathered)
        assert np.allclose(emit[count > 0].sum(0) + unseen, 1)
        if _ < 2:
            first, moves, seen = markov.expected(start, move, emit, train)
            start, move = (first + 1e-3) / (first + 1e-3).sum(), (moves + 1e-3) / (moves + 1e-3).sum(1, keepdims=True)
            shares = seen / np.maximum(seen.sum(1, keepdims=True), 1e-300)
    want = dict(zip((d for d, _ in rows), markov.forward(start, move, emit, strings)))
    assert len(got) == 120 and all(math.isclose(got[d], want[d], rel_tol=1e-4) for d in want)
    assert sum(len(t) for _, t in rows) > 1 << 17


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(["a b a c", "b b", "", "c a"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id >= 0")
    table = markov.scored(docs.unionByName(spark.createDataFrame([(None, "zz")], "doc_id long, text string")), 2, 2)
    assert table.count() == 21 and all(r["score"] < 0 for r in table.collect())


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(markov, "STEPS", 1 << 12)
    docs = spark.createDataFrame([(1, "ab cd ab " * 20_000), (2, "ab"), (0, "cd x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in markov.scored(docs, 2, 1).collect()}
    assert got[1]["n_tokens"] == 60_001 and got[1]["score"] < got[2]["score"] and math.isfinite(got[1]["score"])


def test_special_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "Été a a"), (0, "A \x85b c"), (30, "new words")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in markov.scored(docs).collect())
    assert got == sorted((str(d), h, n, k, t, round(b, 9)) for d, h, n, k, t, b in base(rows))
    assert markov.scored(docs.limit(0)).collect() == []
