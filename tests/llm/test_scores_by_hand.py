"""Scores of op2 and op8 against plain Python, and the recall of op9 over several blocks."""

import math
from collections import Counter

import numpy as np
import xxhash

from adjudica.llm import neighbours, quality, toxicity
from adjudica.llm.common import documents


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bucket(kind, *words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return signed(h) % quality.BUCKETS + kind * quality.BUCKETS


def test_quality_ratio(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"] or "") if w] for r in docs.collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good) < quality.TRUSTED
    grams = {d: [[bucket(0, x[-3:]) for x in w], [bucket(1, x) for x in w], [bucket(2, x, y) for x, y in zip(w, w[1:])]] for d, w in texts.items()}
    raw, trusted = Counter(), Counter()
    for d, kinds in grams.items():
        for own in kinds:
            raw.update(own)
            trusted.update(own if d in good else ())
    size = quality.BUCKETS
    total = lambda c, k: sum(n for b, n in c.items() if b // size == k) + quality.PRIOR * size
    odds = [math.log(total(raw, k) / total(trusted, k)) for k in range(3)]
    ratio = lambda b: math.log((trusted[b] + quality.PRIOR) / (raw[b] + quality.PRIOR)) + odds[b // size]
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    for d, kinds in grams.items():
        want = sum(sum(map(ratio, own)) / max(1, len(own)) for own in kinds)
        assert abs(got[d]["llr"] - want) < 1e-5 and got[d]["kept"] == (not got[d]["base_failed"] and got[d]["llr"] >= quality.THRESHOLD)


def test_toxicity_score(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    part, weight, bias, slope, cut = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    for r in docs.limit(400).collect():
        total = mean = 0.0
        for word in toxicity.words_of(r["text"] or ""):
            data = b" " + word + b" "
            grams = [data[k : k + n] for n in toxicity.GRAMS for k in range(len(data) - n + 1)]
            places = [int.from_bytes(g, "little") + len(g) for g in grams] + [toxicity.zlib.crc32(word)]
            for place in (p * int(toxicity._MIX) % (1 << 64) >> 46 for p in places):
                total, mean = total + float(weight[place]), mean + float(part[place])
        logit = max(mean / total + bias, toxicity.FLOOR) if total else toxicity.FLOOR
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * (logit - cut)))))
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-4 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5)


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 450)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    # four rows with the vector of row 0, which are dealt to different blocks: equal scores, the smaller id first
    rows = [(r["vec_id"], r["embedding"]) for r in rows] + [(1_000_001 + k, rows[0]["embedding"]) for k in range(4)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    found = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        found += len(set(got[q]) & set([i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]))
    assert found / (20 * len(got)) >= 0.9
    first = rows[0][0]
    assert first % 20 or got[first][:4] == [1_000_001, 1_000_002, 1_000_003, 1_000_004]
