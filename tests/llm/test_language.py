import zlib

import numpy as np
import pytest

from adjudica.llm import language
from adjudica.llm.common import documents


def slow_logits(text, net):
    """Filters run over embedded bytes in plain loops, window by window."""
    own, total, weight = net.weights, 0.0, 0
    for w in language.windows_of(text):
        x = own["bytes"][np.frombuffer(w.ljust(language.LENGTH, b"\0"), np.uint8)]
        peaks = []
        for size in language.WIDTHS:
            answers = [x[k : k + size].ravel() @ own[f"filters{size}"] for k in range(language.LENGTH - size + 1)]
            peaks.append(np.max(answers, axis=0) + own[f"shift{size}"])
        total = total + len(w) * (np.maximum(np.concatenate(peaks), 0) @ own["softmax"] + own["bias"])
        weight += len(w)
    return total / weight


def test_tables_give_what_the_filters_give():
    net = language.Network(3)
    for k, v in net.weights.items():
        v += net.rng.normal(0, 0.1, v.shape).astype(np.float32)
    texts = [b"a", b"ab", "é".encode() * 200, bytes(range(256)) * 3, b"x" * 256, b"y" * 257, b"z" * 509, b"z" * 510]
    want = np.array([slow_logits(t, net) for t in texts])
    p = np.exp(want - want.max(1, keepdims=True))
    assert np.allclose(language.shares(texts, net.tables()), p / p.sum(1, keepdims=True), atol=1e-4)


def test_windows_lose_no_stretch():
    for n in (0, 1, 3, 4, 255, 256, 257, 258, 509, 510, 511, 2000):
        text = bytes(k % 251 for k in range(n))
        cut = language.windows_of(text)
        assert all(len(w) == language.LENGTH for w in cut[:-1]) and cut[0] + b"".join(w[language.SHARED :] for w in cut[1:]) == text
        widest = max(language.WIDTHS)
        assert {text[k : k + widest] for k in range(n - widest + 1)} <= {w[k : k + widest] for w in cut for k in range(len(w))}


def test_gradients():
    net = language.Network(3, seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, weight = net.rng.integers(0, 256, (4, language.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 1]), np.array([1.0, 0.5, 2.0, 1.0])

    def loss():
        peaks, _ = net.pooled(x)
        logit = np.maximum(peaks, 0) @ net.weights["softmax"] + net.weights["bias"]
        return float((weight * (np.log(np.exp(logit).sum(1)) - logit[np.arange(4), y])).sum())

    spots = [("bytes", (int(x[0, 5]), 2)), ("filters2", (3, 4)), ("filters4", (20, 1)), ("shift3", (2,)), ("softmax", (7, 1)), ("bias", (2,))]
    slopes = []
    for name, at in spots:
        net.weights[name][at] += 1e-6
        up = loss()
        net.weights[name][at] -= 2e-6
        slopes.append((up - loss()) / 2e-6)
        net.weights[name][at] += 1e-6
    net.moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in net.weights.items()}
    net.step(x, y, weight)
    for (name, at), slope in zip(spots, slopes):
        assert net.moments[name][0][at] * 10 == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_held_out_accuracy(spark, sf):
    docs = documents(spark, sf)
    known = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    got = language.predicted(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(known)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, known[r["doc_id"]][1]))) for r in got)
    own = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == known[r["doc_id"]][0] for r in own) / len(own) > 0.98


def test_neither_source_nor_own_language_matters(spark, sf):
    docs = documents(spark, sf)
    swapped = docs.withColumn("lang", language.F.when(language.held_out(language.F.col("doc_id")), "en").otherwise(language.F.col("lang"))).withColumn("source", language.F.lit(None).cast("string"))
    own = lambda d: sorted((r["doc_id"], r["lang_pred"]) for r in language.predicted(d).where("held_out").collect())
    assert own(docs) == own(swapped)


def test_special_cases(spark):
    rows = [(1, "the quiet river", "en"), (3, "der stille Fluss", "de"), (5, None, "en"), (8, "", "de"), (None, "a river", "en"), (None, None, None), (9, "12 34 !?", "en"), (4, "Ж", None), (6, "the river " * 20_000, None), (1, "the quiet river", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as score", "doc_id as key", "text as cut", "1 as place")
    got = language.predicted(docs).collect()
    assert len(got) == 10 and {r["lang_pred"] for r in got} == {"en", "de", "und"}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (5, 8, 9) or r["doc_id"] is None and r["score"] == 0) for r in got)
    assert language.predicted(docs.limit(0)).collect() == []
    one = language.predicted(docs.where("doc_id = 1 or doc_id = 9")).collect()
    assert sorted((r["lang_pred"], r["score"]) for r in one) == [("en", 1.0), ("en", 1.0), ("und", 0.0)]
    none = language.predicted(docs.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_equal_rows_teach_once(spark):
    rows = [(1, "the quiet river", "en")] * 3000 + [(3, "der stille Fluss", "de")]
    known, tables = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert known == ["de", "en"] and language.shares([b"the quiet river"], tables).argmax() == 1
