import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from adjudica.llm import codes

COLUMNS = "vec_id long, embedding array<float>, label int"


def slow(rows):
    """Plain Lloyd: every part against every entry in every round, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(([math.floor(4096 * x) for x in np.array(r[1], np.float32).astype(float)], r[0], r[2]) for r in kept)
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0))
    width = len(kept[0][0]) // 8
    parts = [[v[p * width : p * width + width] for p in range(8)] for v, _, _ in kept]
    books = [[x[p] for x in parts[:16]] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = defaultdict(list)
            for x in parts:
                groups[nearest(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(x[p], books[p]) for p in range(8)] for x in parts]
    errors, digest = defaultdict(int), hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (_, i, label), f in zip(kept, found)]


def random_rows(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (7, dim))
    return [(int(k) * 3, [float(v) for v in (centres[k % 7] + rng.normal(0, 0.2, dim)).astype(np.float32)], None if k % 5 == 0 else int(k % 3)) for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        random_rows(400, 16, 1),
        random_rows(60, 64, 2, 4000.0),  # distances beyond 2^53
        random_rows(5, 8, 3),
        [(k, [float(k % 4)] * 8, 1) for k in range(200)] * 2,  # ties everywhere, repeated rows, unused entries
        random_rows(50, 8, 4) + [(None, [0.5] * 8, 9), (1, None, 1), (2, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 2), (5, [1.0] * 7 + [None], 2), (3, [-0.0001] * 8, None)],
    ],
    ids=["clusters", "large", "few", "ties", "nulls"],
)
def test_against_plain_lloyd(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS).repartition(3).selectExpr("*", "vec_id as code", "label as error", "label as name")
    assert Counter(map(tuple, codes.coded(table).collect())) == Counter(slow(rows))


def test_rounds_compare_moved_entries_only(monkeypatch):
    rng = np.random.default_rng(5)
    x, entries = rng.integers(-50, 50, (3000, 4)), rng.integers(-50, 50, (16, 4))
    code, far = codes.assign(x, entries)
    seen, whole = [], codes.distances
    monkeypatch.setattr(codes, "distances", lambda a, b: seen.append((len(a), len(b))) or whole(a, b))
    for step in range(30):
        moved = rng.random(16) < 0.2
        entries = np.where(moved[:, None], rng.integers(-50, 50, (16, 4)), entries)
        stale = int(moved[code].sum())
        seen.clear()
        code, far = codes.assign(x, entries, code, far, moved)
        assert seen == [s for s in ((stale, 16), (3000 - stale, int(moved.sum()))) if all(s)]
        every = whole(x, entries)
        assert (code == every.argmin(1)).all() and (far == every.min(1)).all()


def test_other_lengths_and_extremes(spark):
    rows = [(1, [1.0] * 8, 1), (2, [1.0] * 9, 1), (3, [], 1), (4, [3e38] * 8, 1), (5, [-3e38] * 8, 2)]
    got = codes.coded(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 4, 5] and all(r["error"] == 0 for r in got)
    uneven = codes.coded(spark.createDataFrame([(k, [float(k)] * 11, 1) for k in range(40)], COLUMNS)).collect()
    assert len(uneven) == 40 and all(len(r["code"]) == 16 for r in uneven)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [None], 2)], [(1, [], None)]])
def test_nothing_to_code(spark, rows):
    got = codes.coded(spark.createDataFrame(rows, COLUMNS))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == sum(r[1] == [] for r in rows)


def test_against_sql(spark, sf):
    got = codes.coded(spark.read.parquet(f"{sf}/embeddings.parquet"))
    with duckdb.connect() as c:
        c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
        want = c.sql(codes.SQL)
        assert want.columns == got.columns
        assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_decoded_vectors_are_near(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found, books = codes.learned(table)
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    errors = [((codes.decoded(r["code"], books) - np.floor(np.array(vectors[r["vec_id"]]) * 4096) / 4096) ** 2).sum() * 4096**2 - r["error"] for r in found.collect()]
    assert np.abs(errors).max() < 1
