"""A hidden Markov language model over words, trained by Baum-Welch on the whole corpus.

Tokens are words and one end for each document. The latent states emit tokens: every training token has an emission
probability of its own in every state, and one unseen token stands for all others, as in the smoothed unigram model (the
base). So the model is a proper distribution over the same tokens as the base.

The emissions grow with the vocabulary and never meet in one place. They stay in buckets by the word's hash; blocks of
whole documents hold their documents as numbers into a list of the block's distinct words. Passes, each a Spark job
whose result is written to the shared folder:

1. words: each block sends its distinct words (64-bit hash, training count) to their buckets.
2. counts: a bucket adds up what the blocks sent and keeps the corpus counts, with the place of every block's words.
3. shares: a bucket answers each block with its words' corpus counts and the states' shares of each word's count.
4. expected: blocks and answers meet; scaled forward and backward recursions over whole documents, from the first token
   to the last, give the expected counts. The states' shares of a word go back to its bucket, the counts of starts and
   moves (states x states) are added up for the driver. Passes 3 and 4 are a round.
5. score: shares once more; the scaled forward recursion over each whole document.

Shares travel as 16-bit fractions; the states' sums, which the driver adds up, are taken from these very fractions. A
state adds its part of what the base adds to the counts, and ``SMOOTH`` counts spread as in the base, so that every
state's emissions sum to one over the training tokens and the unseen one. A document longer than ``STEPS`` tokens goes
through the backward recursion stretch by stretch, from forward vectors kept at the stretches' edges: the counts are the
same, and memory is bounded.

Defined cases: null and empty texts are the end alone; a null doc_id is trained on; repeated rows count repeatedly;
if nothing is left to train on, N = V = 0 and both models know only the unseen token; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PART, by_bucket, in_blocks, pack, parts, unpack
from .common import columns_of, corpus_size, discard, written
from .toxicity import held_out

FOLDS, PRIOR = 10, 0.1
STATES, ROUNDS, SMOOTH, SEED = 6, 3, 50.0, 3
#: What a share of one is sent as.
WHOLE = 65_535
#: Bytes of text in a block and of a bucket; tokens of one recursion, and of a stretch of a longer document.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20
TOKENS, STEPS = 1 << 19, 1 << 18
END = b"\n"  # no word is white space
BODY, WORDS, STATE, SHARES, SUMS = 0, 1, 2, 3, 4
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def small(x: np.ndarray, top: int) -> np.ndarray:
    return x.astype(np.uint16 if top <= 1 << 16 else np.uint32)


def cut_block(table: pa.Table, block: int, buckets: int) -> list[tuple]:
    """The block as numbers (kind 0), its words ordered by bucket, and its words for each bucket."""
    number: dict[bytes, int] = {END: 0}
    documents, held = [], np.array(table.column("held").to_pylist(), bool)
    for text in table.column("text").cast(pa.binary()).to_pylist():
        own = [number.setdefault(w, len(number)) for w in (text or b"").lower().split()]
        own.append(0)
        documents.append(np.array(own, np.uint32))
    sizes = np.array([len(d) for d in documents], np.int64)
    flat = np.concatenate(documents)
    train = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(number)).astype(np.uint32)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in number), np.uint64, len(number))
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    names, counts = np.unique(bucket, return_counts=True)
    rows = [(BODY, block, -1, pickle.dumps((table.column("doc_id").to_pylist(), held, pack(small(place[flat], len(number)), sizes, names.astype(np.uint32), counts)), protocol=5))]
    for b, own in by_bucket(bucket[order]):
        rows.append((WORDS, block, b, pack(hashes[order][own], train[order][own])))
    return rows


def count_bucket(table: pa.Table) -> pa.Table:
    """The bucket's words: hash, corpus count, and each block's places and counts; with the bucket's tokens and distinct words."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
    sent = [unpack(p) for _, p in rows]
    words, place = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    count = np.bincount(place, np.concatenate([s[1] for s in sent]).astype(float), minlength=len(words)).astype(np.int64)
    payload = pack(words, count, small(place, len(words)), np.concatenate([s[1] for s in sent]), np.array([b for b, _ in rows], np.int64), np.array([len(s[0]) for s in sent], np.int64))
    return pa.table({"kind": pa.array([STATE], pa.int8()), "block": pa.array([-1], pa.int64()), "bucket": pa.array(table.column("bucket")[:1].to_pylist(), pa.int32()), "payload": pa.array([payload], pa.binary()), "tokens": pa.array([int(count.sum())]), "known": pa.array([int((count > 0).sum())])})


def first_shares(words: np.ndarray, states: int) -> np.ndarray:
    """About alike, told apart by a chance that depends on the word alone: the same in every run."""
    x = (words[:, None] ^ np.uint64(SEED)) + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    chance = 0.3 + 1.4 * (x >> np.uint64(40)).astype(np.float64) / (1 << 24)
    return chance / chance.sum(1, keepdims=True)


def as_shares(x: np.ndarray) -> np.ndarray:
    """Rows as fractions of their sums."""
    return np.rint(x * (WHOLE / np.maximum(x.sum(1, keepdims=True), 1e-300))).astype(np.uint16)


def base_of(count: np.ndarray, tokens: int, known: int) -> np.ndarray:
    return (count + PRIOR) / (tokens + PRIOR * (known + 1))


def emissions(shares: np.ndarray, count: np.ndarray, tokens: int, known: int, gathered: np.ndarray) -> np.ndarray:
    """Of words (rows) in states, from shares and counts, and `gathered`, the states' sums over all words."""
    share = gathered / max(1e-300, gathered.sum())
    own = shares * (count / WHOLE)[:, None]
    return (own + share * PRIOR + SMOOTH * base_of(count, tokens, known)[:, None]) / (gathered + share * PRIOR * (known + 1) + SMOOTH)


def answers_of(state: pa.Table, sums: pa.Table, states: int, first: bool) -> pa.Table:
    """For each block its words' shares and corpus counts; and the states' sums over the bucket's words."""
    if not state.num_rows:
        return parts([])
    words, count, place, train, of_block, sizes = unpack(state.column("payload")[0].as_py())
    ends = np.cumsum(sizes)
    if first:
        total = first_shares(words, states)
    else:
        got, total = dict(zip(sums.column("block").to_pylist(), sums.column("payload").to_pylist())), np.zeros((len(words), states))
        for block, end, n in zip(of_block.tolist(), ends.tolist(), sizes.tolist()):
            if block in got:  # a block's places differ from each other
                total[place[end - n : end]] += unpack(got[block])[0] * (train[end - n : end] / WHOLE)[:, None]
    shares, bucket = as_shares(total), state.column("bucket")[0].as_py()
    sent = small(count, int(count.max()) + 1) if count.max() < 1 << 32 else count
    rows = [(SHARES, block, bucket, pack(shares[own], sent[own])) for block, own in zip(of_block.tolist(), np.split(place, ends[:-1]))]
    return parts([*rows, (SUMS, -1, bucket, pack((shares * (count / WHOLE)[:, None]).sum(0)))])


def with_answers(block: pa.Table, answers: pa.Table) -> tuple:
    """The block's ids, held-out marks, documents (words by place), and its buckets with their numbers of words; and each
    answer's arrays, put together in the words' order."""
    ids, held, body = pickle.loads(block.column("payload")[0].as_py())
    flat, sizes, names, counts = unpack(body)
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()))
    arrays = [np.concatenate(x) for x in zip(*(unpack(got[b]) for b in names.tolist()))]
    return ids, held, np.split(flat, np.cumsum(sizes)[:-1]), names, counts, arrays


def time_major(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all documents step by step, longest document first in each step; documents in each step; their order."""
    sizes = np.array([len(d) for d in documents])
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    laid = np.empty(len(step), np.int64)
    laid[(np.cumsum(live) - live)[step] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([documents[k] for k in order])
    return laid, live, order


def groups_of(documents: list[np.ndarray]) -> Iterator[list[int]]:
    """Runs of documents of about TOKENS tokens, or one longer one."""
    own, size = [], 0
    for k, d in enumerate(documents):
        if own and size + len(d) > TOKENS:
            yield own
            own, size = [], 0
        own.append(k)
        size += len(d)
    if own:
        yield own


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document: scaled forward recursion, all documents step by step together."""
    laid, live, order = time_major(documents)
    emit, total, a, at, t = emit.astype(float), np.zeros(len(documents)), np.repeat(start[None, :], len(documents), 0), 0, 0
    steps = live.tolist()
    while t < len(steps):
        until = t + 1
        size = steps[t]
        while until < len(steps) and size + steps[until] <= STEPS:
            size += steps[until]
            until += 1
        e, own = emit[laid[at : at + size]], 0
        for n in steps[t:until]:
            a = a[:n] if t == 0 else a[:n] @ move
            a = a * e[own : own + n]
            scale = a.sum(1)
            a /= scale[:, None]
            total[:n] += np.log10(scale)
            own += n
            t += 1
        at += size
    out = np.empty_like(total)
    out[order] = total
    return out


def _ahead(first: np.ndarray, move: np.ndarray, e: np.ndarray, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors and scales of the steps, from the states' probabilities before the first emission."""
    a, scales, at = np.empty_like(e), np.empty((len(e), 1), e.dtype), 0
    now = first
    for t, n in enumerate(steps):
        now = (now[:n] @ move if t else now[:n]) * e[at : at + n]
        s = now.sum(1, keepdims=True)
        now /= s
        a[at : at + n], scales[at : at + n] = now, s
        at += n
    return a, scales


def _back(a: np.ndarray, scales: np.ndarray, e: np.ndarray, move: np.ndarray, steps: list[int], back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns forward vectors into state probabilities, in place; the sums of moves, and what the steps hand back."""
    moves, at, ones, turned = np.zeros_like(move), len(a), np.ones((steps[0], len(move)), e.dtype), np.ascontiguousarray(move.T)
    e /= scales
    for t in range(len(steps) - 1, -1, -1):
        n = steps[t]
        at -= n
        if len(back) < n:
            back = np.concatenate([back, ones[len(back) : n]])
        a[at : at + n] *= back
        ahead = e[at : at + n] * back
        if t:
            moves += a[at - steps[t - 1] : at - steps[t - 1] + n].T @ ahead
            back = ahead @ turned
    return moves, ahead


def expected(start: np.ndarray, move: np.ndarray, emit: np.ndarray, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (rows as in `emit`), over whole documents."""
    k, words = len(start), len(emit)
    kind = emit.dtype
    laid, live, _ = time_major(documents)
    now, steps = move.astype(kind), live.tolist()
    first = np.repeat(start[None, :], len(documents), 0).astype(kind)
    emits = np.zeros((words, k))
    count = lambda own, gamma: np.stack([np.bincount(own, gamma[:, j], minlength=words) for j in range(k)], 1)
    if len(documents) > 1 or len(laid) <= STEPS:
        e = emit[laid]
        a, scales = _ahead(first, now, e, steps)
        moves, _ = _back(a, scales, e, now, steps, np.ones((steps[-1], k), kind))
        return a[: steps[0]].sum(0, dtype=float), moves * move, count(laid, a)
    edges, before, lasts = list(range(0, len(laid), STEPS)), [first], [first]
    for at in edges[:-1]:
        a, _ = _ahead(before[-1], now, emit[laid[at : at + STEPS]], [1] * STEPS)
        before.append(a[-1:] @ now)
        lasts.append(a[-1:])
    moves, back, starts = np.zeros((k, k)), np.ones((1, k), kind), None
    for at, came, last in zip(reversed(edges), reversed(before), reversed(lasts)):
        own = laid[at : at + STEPS]
        e = emit[own]
        a, scales = _ahead(came, now, e, [1] * len(own))
        inside, ahead = _back(a, scales, e, now, [1] * len(own), back)
        moves += inside * move
        emits += count(own, a)
        if at:
            moves += (last.T @ ahead) * move
            back = ahead @ now.T
        starts = a[0].astype(float)
    return starts, moves, emits


def expect_block(block: pa.Table, answers: pa.Table, tokens: int, known: int, start: np.ndarray, move: np.ndarray, gathered: np.ndarray) -> pa.Table:
    """Of one block: the states' shares of its words, for their buckets, and one row of starts and moves."""
    if not block.num_rows:
        return parts([])
    _, held, documents, names, counts, (shares, count) = with_answers(block, answers)
    emit = emissions(shares, count, tokens, known, gathered).astype(np.float32)
    train = [d for d, out in zip(documents, held) if not out]
    if not train:
        return parts([])
    total = None
    for group in groups_of(train):
        own = expected(start, move, emit, [train[k] for k in group])
        total = own if total is None else tuple(x + y for x, y in zip(total, own))
    starts, moves, emits = total
    number = block.column("block")[0].as_py()
    rows = [(SHARES, number, b, pack(x)) for b, x in zip(names.tolist(), np.split(as_shares(emits), np.cumsum(counts)[:-1]))]
    return parts([*rows, (SUMS, number, -1, pack(np.concatenate([starts, moves.ravel()])))])


def added(rows: DataFrame) -> np.ndarray | None:
    """The sum of all packed arrays: first in each task, then place by place, so that the driver gets one array's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                own = unpack(payload)[0]
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "x"])

    sums = rows.select("payload").mapInArrow(run, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("s")).collect()
    return np.array([s for _, s in sorted((r["pos"], r["s"]) for r in sums)]) if sums else None


def score_block(block: pa.Table, answers: pa.Table, tokens: int, known: int, start: np.ndarray, move: np.ndarray, gathered: np.ndarray) -> pa.Table:
    fields = [f.split() for f in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    columns: list = [[]] * len(fields)
    if block.num_rows:
        ids, held, documents, _, _, (shares, count) = with_answers(block, answers)
        emit, base = emissions(shares, count, tokens, known, gathered), np.log10(base_of(count, tokens, known))
        sizes = np.array([len(d) for d in documents])
        flat, at = np.concatenate(documents), np.cumsum(sizes) - sizes
        score = np.concatenate([forward(start, move, emit, [documents[k] for k in group]) for group in groups_of(documents)])
        columns = [ids, held, sizes, np.add.reduceat((count > 0)[flat].astype(np.int64), at), np.add.reduceat(base[flat], at), score]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = columns_of(docs, "doc_id", "text").select("doc_id", "text", held_out(F.col("doc_id"), FOLDS).alias("held"))
    buckets = max(8, -(-corpus_size(docs)[1] // BUCKET_BYTES))
    table = written(in_blocks(docs, lambda t, block: cut_block(t, block, buckets), BLOCK_BYTES), "words", "kind")
    state = written(table.where(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(count_bucket, PART + ", tokens long, known long"), "word-counts")
    discard(table, f"kind={WORDS}")
    row = state.agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known")).first()
    tokens, known = row["tokens"] or 0, row["known"] or 0
    by_buckets, bodies = state.select("kind", "block", "bucket", "payload").groupBy("bucket"), table.where(F.col("kind") == BODY).groupBy("block")
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8

    def of(rows: DataFrame, kind: int) -> DataFrame:
        return rows.where(F.col("kind") == kind)

    def answered(sums: DataFrame, first: bool = False) -> tuple[DataFrame, np.ndarray]:
        found = written(by_buckets.cogroup(of(sums, SHARES).groupBy("bucket")).applyInArrow(lambda w, s: answers_of(w, s, states, first), PART), "shares")
        total = added(of(found, SUMS))
        return found, np.zeros(states) if total is None else total

    def round_of(answers: DataFrame, gathered: np.ndarray, start: np.ndarray, move: np.ndarray) -> DataFrame:
        return written(bodies.cogroup(of(answers, SHARES).groupBy("block")).applyInArrow(lambda b, a: expect_block(b, a, tokens, known, start, move, gathered), PART), "expected")

    answers, gathered = answered(state.select("kind", "block", "bucket", "payload"), True)
    for _ in range(rounds if tokens else 0):
        found = round_of(answers, gathered, start, move)
        total = added(of(found, SUMS))
        discard(answers)
        start, move = total[:states] + 1e-3, total[states:].reshape(states, states) + 1e-3
        start, move = start / start.sum(), move / move.sum(1, keepdims=True)
        answers, gathered = answered(found)
        discard(found)
    done = bodies.cogroup(of(answers, SHARES).groupBy("block")).applyInArrow(lambda b, a: score_block(b, a, tokens, known, start, move, gathered), SCHEMA)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
