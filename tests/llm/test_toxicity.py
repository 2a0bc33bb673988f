import zlib

import numpy as np
import pytest

from adjudica.llm import toxicity
from adjudica.llm.common import documents


def test_held_out_accuracy(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.scored(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    own = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    pairs = [(a["score"] > b["score"]) for a in own for b in own if labels[a["doc_id"]] > labels[b["doc_id"]]]
    assert sum(pairs) / len(pairs) > 0.85


def test_held_out_precision_and_recall(spark):
    """On the larger tables, as the small ones hold out six toxic documents."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.scored(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").collect() if r["doc_id"] in labels]
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in got)
    assert hit / sum(r["predicted"] for r in got) > 0.7 and hit / sum(labels[r["doc_id"]] for r in got) > 0.6
    order = np.argsort([r["score"] for r in got], kind="stable")
    rank, toxic = np.empty(len(got)), np.array([labels[r["doc_id"]] for r in got])
    rank[order] = np.arange(len(got))
    n = toxic.sum()
    assert (rank[toxic == 1].sum() - n * (n - 1) / 2) / (n * (len(got) - n)) > 0.92


def test_an_unseen_misspelling_scores_high():
    clean = [f"the quiet river number {k} runs to the sea" for k in range(200)]
    toxic = [f"you {w} number {k} of the sea" for k in range(50) for w in ("idiot", "moron")]
    model = toxicity.trained([toxicity.bag(t) for t in clean + toxic], np.array([0] * 200 + [1] * 100))
    score = lambda t: toxicity.logits([t], *model)[0]
    assert score("such an idiott by the river") > score("such a valley by the river") + 1
    assert score("") == score(None) == toxicity.FLOOR


def test_logits_of_bags_are_those_of_texts(spark, sf):
    texts = [r["text"] for r in documents(spark, sf).limit(200).collect()] + [None, "", "zzqx"]
    bags = [toxicity.bag(t) for t in texts]
    model = toxicity.trained(bags, np.arange(len(bags)) % 2)
    assert np.allclose(toxicity.bag_logits(bags, model), toxicity.logits(texts, *model), atol=1e-4)


def test_the_gradient_lowers_the_loss(monkeypatch):
    rng = np.random.default_rng(2)
    marks = np.arange(120) % 2
    bags = [toxicity.bag(" ".join(rng.choice(["red", "green", "blue"], 30)) + (" vile" if m else "")) for m in marks]
    texts = ["red green", "red vile blue"]
    gaps = []
    for passes in (0, 1, 4):
        monkeypatch.setattr(toxicity, "PASSES", passes)
        low, high = toxicity.logits(texts, *toxicity.trained(bags, marks))
        gaps.append(high - low)
    assert gaps[0] < gaps[1] < gaps[2]


def test_the_cut_has_the_largest_f1():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x, y, weight = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40), rng.random(40)
        if y.any():
            f1 = lambda cut: 2 * weight[(x >= cut) & (y == 1)].sum() / (weight[x >= cut].sum() + weight[y == 1].sum())
            assert f1(toxicity.best_cut(x, y, weight)) == pytest.approx(max(f1(c) for c in x))


@pytest.mark.parametrize("marks", [[], [(1, 0)], [(1, 1), (1, 0), (None, 1), (2, None), (3, 0)]])
def test_special_cases(spark, marks):
    docs = spark.createDataFrame([(1, "bad bad", 7), (2, None, 7), (None, "", 7), (3, "good " * 3000, 7), (3, "good", 7)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), labels).collect() == []
