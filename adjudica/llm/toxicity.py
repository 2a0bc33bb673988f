"""Toxicity scores from subword bags.

A document is the bag of its words' subwords: each word itself and its character n-grams (bytes of the lower-cased word with
a space at both ends, 3 to 5 of them), all hashed into buckets, as often as they occur. A misspelling that was never seen
shares most of its n-grams with the word it comes from. The vectors of a bag are averaged, rarer subwords with more weight
(the logarithm of the share of documents that have them), and go through a linear softmax; vectors and softmax are trained
together in numpy. As all of it is linear, what is broadcast is two numbers a bucket: its weight, and its weight times its
vector's part of the toxic logit.

Each half of the training documents also gets logits from a model of the other half, as new documents would. On these,
weighed as the classes are in all labels, a logistic fit gives the slope of the score, and its 0.5 is put at the logit that
separates them best (largest F1).

Training uses at most ``TRAIN`` labelled documents of either class (chosen by a hash of their id, held-out ones never), over
their whole texts. The driver gets their bags without subwords that few of them have. Scoring is one pass over all texts
without a shuffle.

Defined cases: a null or empty text, or one without a known subword, has the smallest logit; without labelled documents of
both classes every score is 0; labels with a null doc_id or mark are ignored, of several marks for one document the largest
counts, of several texts of one document the first in order teaches; repeated rows get equal scores; a null doc_id is not
held out; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, written

#: Labelled documents of each class at most; hash buckets, length of a vector, passes over the documents, documents a step.
TRAIN, BUCKETS, SIZE, PASSES, STEP = 3_000, 1 << 18, 8, 3, 32
#: A subword counts if this many training documents have it (with fewer than 800 of these: one in 100).
LEAST = 8
GRAMS = (3, 4, 5)
FOLDS = 5
#: Logit of a text without known subwords.
FLOOR = -12.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Punctuation and control characters separate words, like spaces.
_TABLE = bytes(32 if b <= 32 or chr(b) in '.,;:!?"()[]{}|' else b for b in range(256))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, each with the place of its word: n-grams first, then the words themselves."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" " + bytes(8), np.uint8)
    n = len(buf) - 8
    space = np.flatnonzero(buf[:n] == 32)
    word = np.repeat(np.arange(len(space)), np.diff(np.r_[space, n]))  # each byte with the word that its space leads
    stop = np.append(space[1:], n - 1)[word]  # the space behind that word
    packed = np.lib.stride_tricks.as_strided(buf, (n, 8), (1, 1)).copy().view("<u8").ravel()
    at = np.arange(n)
    buckets, owner = [], []
    for size in GRAMS:
        own = np.flatnonzero(at + size - 1 <= stop)
        own = own[word[own] < len(words)]
        value = ((packed[own] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size)) * _MIX
        buckets.append((value >> np.uint64(64 - 18)).astype(np.int64))
        owner.append(word[own])
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    buckets.append(((whole * _MIX) >> np.uint64(64 - 18)).astype(np.int64))
    owner.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owner)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, ascending, and how often each occurs."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(subwords(words)[0], return_counts=True)


def known_weights(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weight of each bucket: log of (documents + 1) / (those that have it + 1), 0 for those that few have."""
    have = np.zeros(BUCKETS, np.int64)
    for buckets, _ in bags:
        have[buckets] += 1
    least = max(1, min(LEAST, len(bags) // 100))
    return np.where(have >= least, np.log((len(bags) + 1) / (have + 1)), 0).astype(np.float32)


def weighed(one: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a bag that count, and what they count in all."""
    buckets, n = one
    share = n * weight[buckets]
    return buckets[share > 0], share[share > 0]


def trained(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """For each bucket its weight times its part of the toxic logit, and its weight; and the bias."""
    weight = known_weights(bags)
    some = np.array([k for k, (b, _) in enumerate(bags) if weight[b].any()], int)
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((BUCKETS, SIZE), np.float32) * np.float32(0.1)
    softmax, bias = rng.normal(0, 0.3, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((SIZE, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(PASSES):
        for step in np.array_split(rng.permutation(some), max(1, len(some) // STEP)) if len(some) else ():
            own = [weighed(bags[k], weight) for k in step]
            flat, share = (np.concatenate([o[j] for o in own]) for j in (0, 1))
            sizes = np.array([len(o[0]) for o in own])
            start = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(step)), sizes)
            share = share / np.add.reduceat(share, start)[doc]
            mean = np.add.reduceat(vectors[flat] * share[:, None], start)
            logit = mean @ softmax + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(step)), toxic[step]] -= 1
            back = p @ softmax.T
            change = mean.T @ p / len(step)
            seen_s += change**2
            softmax -= (0.5 * change / np.sqrt(seen_s)).astype(np.float32)
            level = p.mean(0)
            seen_b += level**2
            bias -= (0.1 * level / np.sqrt(seen_b)).astype(np.float32)
            hit, place = np.unique(flat, return_inverse=True)
            down = np.stack([np.bincount(place, weights=back[doc, d] * share) for d in range(SIZE)], axis=1).astype(np.float32)
            seen_v[hit] += (down**2).mean(1)
            vectors[hit] -= 0.5 * down / np.sqrt(seen_v[hit])[:, None]
    return (vectors @ (softmax[:, 1] - softmax[:, 0]) * weight).astype(np.float32), weight, float(bias[1] - bias[0])


def logits(texts: list[str | None], part: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """The softmax's logit of each text's averaged bag."""
    words = [words_of(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words])
    if not sizes.sum():
        return np.full(len(texts), FLOOR)
    buckets, owner = subwords([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(texts)), sizes)[owner]
    total = np.bincount(doc, weights=weight[buckets], minlength=len(texts))
    mean = np.bincount(doc, weights=part[buckets], minlength=len(texts)) / np.where(total > 0, total, 1)
    return np.where(total > 0, np.maximum(mean + bias, FLOOR), FLOOR)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit (the last one is the constant), by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (weight * (p - y)) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def best_cut(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit with the largest F1 of those at or above it, halfway to the next lower one."""
    order = np.argsort(-x, kind="stable")
    x, hit, all_ = x[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = np.where(np.append(x[1:] != x[:-1], True), 2 * hit / (all_ + hit[-1]), -1)
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k])


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (at least a small one, so that scores rise with the logit) and cut."""
    return max(float(logistic(x[:, None], y, weight)[0]), 1e-3), best_cut(x, y, weight)


def bags_of(docs: DataFrame) -> list[list]:
    """Buckets, counts and mark of docs (doc_id, text, mark), by ascending id; buckets that few documents have are left out in
    Spark, where they can't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                buckets, counts = bag(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), batch.column(0)[k].as_py(), np.int64)), pa.array(buckets.astype(np.int32)), pa.array(counts.astype(np.int32))], ["doc_id", "bucket", "n"])

    least = max(1, min(LEAST, docs.count() // 100))
    rows = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bucket int, n int"), "toxic-bags")
    known = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= least).select("bucket")  # BUCKETS rows at most
    packed = rows.join(F.broadcast(known), "bucket").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("bag"))
    found = docs.select("doc_id", "mark").join(packed, "doc_id", "left").select("doc_id", "mark", "bag.bucket", "bag.n").toArrow()
    out = []
    for batch in found.to_batches():  # parts of the received arrays, not copies of them
        ends = np.cumsum(np.asarray(batch.column("bucket").value_lengths().fill_null(0)))
        buckets, n = (np.asarray(batch.column(c).flatten()) for c in ("bucket", "n"))
        for i, m, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), np.append(0, ends)[:-1].tolist(), ends.tolist()):
            out.append((i, buckets[a:b], n[a:b], m))
    return [bag_and_mark for _, *bag_and_mark in sorted(out, key=lambda x: x[0])]


def bag_logits(bags: list[tuple[np.ndarray, np.ndarray]], model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The same as `logits` from bags."""
    part, weight, bias = model
    total = np.array([(n * weight[b]).sum() for b, n in bags])
    mean = np.array([(n * part[b]).sum() for b, n in bags]) / np.where(total > 0, total, 1)
    return np.where(total > 0, np.maximum(mean + bias, FLOOR), FLOOR)


def unseen_logits(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int = 7) -> np.ndarray:
    """Logits of each half's bags by a model of the other half; where a half lacks a class, by one of all."""
    half = np.random.default_rng(seed).permutation(len(bags)) % 2
    if any(len(set(toxic[half == k].tolist())) < 2 for k in (0, 1)):
        return bag_logits(bags, trained(bags, toxic))
    out = np.empty(len(bags))
    for k in (0, 1):
        model = trained([b for b, h in zip(bags, half) if h != k], toxic[half != k])
        out[half == k] = bag_logits([b for b, h in zip(bags, half) if h == k], model)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float, float] | None:
    """What `logits` takes, slope and cut; None without both classes."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), FOLDS)).groupBy(F.col("doc_id").cast("long").alias("marked")).agg(F.max("toxic").cast("int").alias("mark"))
    usual = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    chosen = [marks.where(F.col("mark") == k).orderBy(F.xxhash64("marked"), "marked").limit(TRAIN) for k in (0, 1)]
    own = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("marked")).select("doc_id", "text", "mark")  # 2 TRAIN ids at most
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    own = own.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    found = bags_of(written(own, "labelled-texts"))
    bags, toxic = [(b, n) for b, n, _ in found], np.array([m for _, _, m in found], int)
    if len(set(toxic.tolist())) < 2:
        return None
    share = np.array([usual[k] / (toxic == k).sum() for k in (0, 1)])[toxic]
    return *trained(bags, toxic), *calibrated(unseen_logits(bags, toxic), toxic, share / share.mean())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = columns_of(docs, "doc_id", "text")
    model = fit(docs, labels.select("doc_id", "toxic"))
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                if own.value is None:
                    score = np.zeros(part.num_rows)
                else:
                    *parts, slope, cut = own.value
                    score = 1 / (1 + np.exp(-np.clip(slope * (logits(part.column(1).to_pylist(), *parts) - cut), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    done = docs.mapInArrow(run, "doc_id long, score double")
    return done.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
