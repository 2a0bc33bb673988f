"""Language of a text by a convolutional network over its bytes.

Bytes are embedded in ``SIZE`` numbers; filters of several widths run over them, the largest answer of each filter within a
window is kept (after a rectifier), and a softmax over these gives the languages. All of it is trained together in numpy, by
Adam, on windows of labelled texts: at most ``PER_LANGUAGE`` documents of each language (chosen by a hash of id and text, none
of those held out), ``WINDOWS`` windows of each, evenly spread, and one short stretch, so that short texts are known too.
This sample is the only bounded part; the driver sees its windows and no more of the texts.

A trained filter is linear in its bytes, so it is kept as tables: what a byte, or a pair of neighbouring bytes, adds at each
place. Scoring a window is then a few table rows added for each byte and a largest value; windows go through in batches.
They cover the whole text (a window begins so far before the last one's end that no filter's stretch is lost). A text's
logits are the mean of its windows', weighted by their bytes. The network travels as 17 MB of tables, whatever the corpus.

Defined cases: a null text, an empty one or one without a letter is `und` with score 0, as is every text where nothing is
labelled; with one language all texts with letters are that, with score 1; null languages and ids don't teach (a null id is
not held out); repeated rows teach once and are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of

#: The sample: documents of each language, windows of each document.
PER_LANGUAGE, WINDOWS = 600, 6
#: Held-out documents are those whose hashed id leaves this remainder.
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Bytes of a window; bytes of it that the window before has too; windows scored at once.
LENGTH, SHARED, BATCH = 256, 3, 64
#: Filter widths, filters of each width, numbers of a byte.
WIDTHS, FILTERS, SIZE = (2, 3, 4), 16, 8
PASSES, RATE = 6, 0.01


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def windows_of(text: bytes) -> list[bytes]:
    """Windows that cover the text: all of LENGTH bytes, but for the last one."""
    step = LENGTH - SHARED
    return [text[k : k + LENGTH] for k in range(0, max(1, len(text) - SHARED), step)]


def laid_out(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(LENGTH, b"\0") for w in windows), np.uint8).reshape(len(windows), LENGTH)


class Network:
    """Embedding, filters of each width, and softmax."""

    def __init__(self, classes: int, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.weights = {"bytes": rng.normal(0, 0.5, (256, SIZE)), "softmax": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), "bias": np.zeros(classes)}
        for w in WIDTHS:
            self.weights |= {f"filters{w}": rng.normal(0, 1 / np.sqrt(w * SIZE), (w * SIZE, FILTERS)), f"shift{w}": np.zeros(FILTERS)}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        self.steps = 0

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answers of all filters in each window, and where they stand."""
        own = self.weights
        flat = own["bytes"][x]
        peaks, places = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(flat, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - w + 1, w * SIZE)
            answers = view @ own[f"filters{w}"]
            places.append(answers.argmax(1))
            peaks.append(np.take_along_axis(answers, places[-1][:, None], 1)[:, 0] + own[f"shift{w}"])
        return np.concatenate(peaks, axis=1), places

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """One Adam step on a batch; its loss."""
        own = self.weights
        peaks, places = self.pooled(x)
        hidden = np.maximum(peaks, 0)
        logit = hidden @ own["softmax"] + own["bias"]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(weight * np.log(p[np.arange(len(x)), y] + 1e-12)).sum())
        p[np.arange(len(x)), y] -= 1
        back = p * weight[:, None]
        changes = {"softmax": hidden.T @ back, "bias": back.sum(0), "bytes": np.zeros_like(own["bytes"])}
        into = (back @ own["softmax"].T) * (peaks > 0)
        for k, w in enumerate(WIDTHS):
            part = into[:, k * FILTERS : (k + 1) * FILTERS]
            at = places[k][:, :, None] + np.arange(w)  # window, filter, place in the stretch
            seen = x[np.arange(len(x))[:, None, None], at]
            stretch = own["bytes"][seen].reshape(len(x), FILTERS, w * SIZE)
            changes[f"filters{w}"] = np.einsum("nf,nfs->sf", part, stretch)
            changes[f"shift{w}"] = part.sum(0)
            to_bytes = part[:, :, None] * own[f"filters{w}"].T
            np.add.at(changes["bytes"], seen.ravel(), to_bytes.reshape(-1, SIZE))
        self.steps += 1
        for name, change in changes.items():
            first, second = self.moments[name]
            first += 0.1 * (change - first)
            second += 0.001 * (change * change - second)
            own[name] -= RATE * (first / (1 - 0.9**self.steps)) / (np.sqrt(second / (1 - 0.999**self.steps)) + 1e-8)
        return loss

    def tables(self) -> dict[str, np.ndarray]:
        """The filters by byte and by pair of bytes (the first one is the higher digit): pair2, pair3 and third, front and
        back of width 4; shifts, softmax and bias."""
        own = self.weights
        places = {w: np.einsum("be,kef->kbf", own["bytes"], own[f"filters{w}"].reshape(w, SIZE, FILTERS)) for w in WIDTHS}
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))
        two, three, four = (places[w] for w in WIDTHS)
        return {
            "pair2": pair(two[0], two[1]), "pair3": pair(three[0], three[1]), "third": three[2], "front": pair(four[0], four[1]), "back": pair(four[2], four[3]),
            "shift": np.concatenate([own[f"shift{w}"] for w in WIDTHS]), "softmax": own["softmax"], "bias": own["bias"],
        }


def logits(x: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of windows, laid out in rows."""
    out = np.empty((len(x), len(tables["bias"])), np.float32)
    for at in range(0, len(x), BATCH):
        own = x[at : at + BATCH]
        pair = (own[:, :-1].astype(np.intp) << 8) | own[:, 1:]
        two = tables["pair2"].take(pair, axis=0).max(1)
        three = tables["pair3"].take(pair[:, :-1], axis=0)
        three += tables["third"].take(own[:, 2:], axis=0)
        four = tables["front"].take(pair[:, :-2], axis=0)
        four += tables["back"].take(pair[:, 2:], axis=0)
        peaks = np.concatenate([two, three.max(1), four.max(1)], axis=1) + tables["shift"]
        out[at : at + BATCH] = np.maximum(peaks, 0) @ tables["softmax"] + tables["bias"]
    return out


def trained(windows: list[bytes], y: np.ndarray, classes: int, seed: int = 13) -> dict[str, np.ndarray]:
    """Tables of a network trained on windows (LENGTH bytes or fewer); every language weighs the same in all."""
    net, x = Network(classes, seed), laid_out(windows)
    usual = np.bincount(y, minlength=classes)
    weight = (len(y) / classes / np.maximum(usual, 1)).astype(np.float32)
    for _ in range(PASSES):
        for own in np.array_split(net.rng.permutation(len(x)), -(-len(x) // BATCH)):
            net.step(x[own], y[own], weight[y[own]] / len(own))
    return net.tables()


def sample_windows(text: bytes, key: int) -> list[bytes]:
    """WINDOWS windows, evenly spread over the text, and a short stretch of it."""
    last = max(0, len(text) - LENGTH)
    starts = sorted({last * k // max(1, WINDOWS - 1) for k in range(WINDOWS)})
    short = 12 + key % 53
    begin = key % max(1, len(text) - short)
    return [text[s : s + LENGTH] for s in starts] + [text[begin : begin + short]]


def fit(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """Languages in order, and the network's tables (None with fewer than two languages)."""
    own = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    own = own.withColumn("key", F.xxhash64("doc_id", "text"))
    keys = own.select("doc_id", "lang", "key").distinct().withColumn("draw", F.pmod("key", F.lit(1 << 30)))
    usual = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # the PER_LANGUAGE smallest draws: of a common language only those are ordered that can be among them (four times as many)
    low = keys.join(usual, "lang").where(F.col("draw") * F.col("n") < F.lit(4 * PER_LANGUAGE << 30)).drop("n")
    by_draw = Window.partitionBy("lang").orderBy("draw", "key", "doc_id")
    chosen = low.withColumn("place", F.row_number().over(by_draw)).where(F.col("place") <= PER_LANGUAGE).drop("place", "draw")
    rows = own.join(F.broadcast(chosen), ["doc_id", "lang", "key"]).dropDuplicates(["doc_id", "lang", "key"])  # PER_LANGUAGE rows a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, keys, texts = (batch.column(k).to_pylist() for k in range(4))
            cut = [(lang, i, key, n, w) for i, lang, key, text in zip(ids, langs, keys, texts) for n, w in enumerate(sample_windows(text.encode("utf-8", "surrogatepass"), key & 0x7FFFFFFF)) if any(map(str.isalpha, w.decode("utf-8", "ignore")))]
            columns = list(zip(*cut)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "doc_id", "key", "n", "cut"])

    found = rows.select("doc_id", "lang", "key", "text").mapInArrow(run, "lang string, doc_id long, key long, n int, cut binary").toArrow()
    found = found.sort_by([(c, "ascending") for c in ("lang", "doc_id", "key", "n")])
    langs = found.column("lang").to_pylist()
    known = sorted(set(langs))
    if len(known) < 2:
        return known, None
    place = {lang: k for k, lang in enumerate(known)}
    return known, trained(found.column("cut").to_pylist(), np.array([place[lang] for lang in langs]), len(known))


def shares(texts: list[bytes], tables: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each text: how likely each language is."""
    cut = [windows_of(t) for t in texts]
    numbers = np.array([len(c) for c in cut])
    flat = [w for c in cut for w in c]
    weight = np.array([len(w) for w in flat], np.float32)
    first = np.cumsum(numbers) - numbers
    every = logits(laid_out(flat), tables)
    mean = np.add.reduceat(every * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
    p = np.exp(mean.astype(np.float64) - mean.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    own = columns_of(docs, "doc_id", "text", "lang").withColumn("lang", F.col("lang").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = model.value
        for whole in batches:
            for batch in (whole.slice(k, BATCH) for k in range(0, whole.num_rows, BATCH)):
                texts = batch.column(1).to_pylist()
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                some = [k for k, t in enumerate(texts) if t and known and any(map(str.isalpha, t))]
                if some:
                    p = shares([texts[k].encode("utf-8", "surrogatepass") for k in some], tables) if tables else np.ones((len(some), 1))
                    score[some] = p.max(1)
                    for k, best in zip(some, p.argmax(1)):
                        lang[k] = known[best]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    done = own.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
