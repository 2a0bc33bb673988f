"""Substring dedup by content-defined chunks.

A gear hash of the last 16 bytes rolls over the text; a chunk ends where the hash is larger than at the ``REACH`` bytes on
either side (at equal values the first counts), and at ``MAX`` bytes at the latest. So a cut depends on the bytes next to
it and on nothing else: an insertion moves the cuts around it and no others, and two copies of a passage have the same
cuts from some forty bytes on, wherever they stand. Chunks are compared by a 128-bit digest: the first one (smallest
doc_id, then place) stays, the others are repeats. Single chunks are so short that phrases of a language repeat them too;
so repeats are removed where ``LEAST`` bytes or more of them stand together, or where they are all of a text. Left in part
are passages that are one short phrase over and over, as they hold no place to tell from others. A bucket gets one digest
for each distinct chunk of a block.

Defined cases: null text is empty and has no chunk; a null doc_id comes last; of rows with one doc_id the one read
first comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import PART, by_bucket, from_ipc, ids_of, in_blocks, pack, parts, text_bytes, to_ipc, unpack
from .common import columns_of, corpus_size, written

#: Bytes on either side of a cut that have smaller hashes; bytes of a chunk at most; of repeats that are removed at least.
REACH, MAX, LEAST = 16, 256, 80
BUCKET_BYTES = 32 << 20
GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32) & np.uint32(0xFFFF0000)
SCHEMA = "doc_id long, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string"


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR[b] << distance over the last 16 bytes."""
    h = GEAR[buf]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def largest(h: np.ndarray, size: int) -> np.ndarray:
    """The largest of the `size` values from each place on."""
    h, reach = h.copy(), 1
    while reach < size:
        step = min(reach, size - reach)
        h[: len(h) - step] = np.maximum(h[: len(h) - step], h[step:])
        reach += step
    return h


def cuts(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for each document, and the chunks' lengths."""
    room = 2 * REACH  # zeros between documents, so that a cut depends on its own text alone
    at = np.arange(len(buf)) + np.repeat(np.arange(1, len(lengths) + 1) * room, lengths)
    laid = np.zeros(len(buf) + (len(lengths) + 1) * room, np.uint8)
    laid[at] = buf
    h = np.zeros(len(laid), np.uint32)
    h[at] = gear(laid)[at]
    around = largest(h, REACH)
    cut = (h[at] > around[at - REACH]) & (h[at] >= around[at + 1])
    ends = np.cumsum(lengths)
    cut[ends[lengths > 0] - 1] = True
    stops = np.flatnonzero(cut) + 1
    sizes = np.diff(np.r_[0, stops])
    pieces = -(-sizes // MAX)
    out = np.full(pieces.sum(), MAX, np.int64)
    out[np.cumsum(pieces) - 1] = sizes - (pieces - 1) * MAX
    counts = np.diff(np.r_[0, np.r_[0, np.cumsum(pieces)][np.searchsorted(stops, ends, side="right")]])
    return counts, out


def _digests(buf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    data, make = buf.tobytes(), hashlib.blake2b
    return np.frombuffer(b"".join(make(data[a:b], digest_size=16).digest() for a, b in zip((ends - sizes).tolist(), ends.tolist())), np.uint64).reshape(-1, 2)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours; nearly ascending numbers take little room that way. np.cumsum with x's type undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def cut_block(table: pa.Table, block: int, buckets: int) -> list[tuple]:
    """The block with its cuts (kind 0); for each bucket its distinct digests and the first document of each (kind 1)."""
    buf, lengths = text_bytes(table)
    ids = ids_of(table)
    counts, sizes = cuts(buf, lengths)
    digest = _digests(buf, sizes)
    doc = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((np.arange(len(doc)), ids[doc], digest[:, 1], digest[:, 0]))
    new = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(1)][: len(order)]
    first = order[new]
    first.sort()  # contents go by their first chunks' places
    bucket_of = (digest[first, 0] % np.uint64(buckets)).astype(np.uint32)
    rows = [(0, block, -1, pickle.dumps((to_ipc(table), pack(counts.astype(np.uint32), sizes.astype(np.uint16), steps(first.astype(np.uint32)), bucket_of.astype(np.uint16) if buckets <= 1 << 16 else bucket_of)), protocol=5))]
    for bucket, own in by_bucket(bucket_of.astype(np.int64)):
        rows.append((1, block, bucket, pack(digest[first[own]], steps(ids[doc[first[own]]]))))
    return rows


def resolve(table: pa.Table) -> pa.Table:
    """Of one bucket: for each digest of each block, whether that block's first chunk is the first of all."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
    sent = [unpack(p) for _, p in rows]
    digest, ids = np.concatenate([x[0] for x in sent]), np.concatenate([np.cumsum(x[1]) for x in sent])
    order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
    answer = np.empty(len(ids), bool)
    answer[order] = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(1)]
    bucket, ends = table.column("bucket")[0].as_py(), np.cumsum([len(x[1]) for x in sent])
    return parts([(2, block, bucket, pack(a)) for (block, _), a in zip(rows, np.split(answer, ends[:-1]))])


def removable(repeat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which repeats of one document stand in LEAST bytes of them or more, or are all it has."""
    if repeat.all():
        return repeat
    run = np.cumsum(np.r_[0, np.diff(repeat.astype(np.int8)) != 0])
    return repeat & (np.bincount(run, sizes)[run] >= LEAST)


def mark(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    payload, shape = pickle.loads(blocks.column("payload")[0].as_py())
    table = from_ipc(payload)
    counts, sizes, first, bucket = unpack(shape)
    first = np.cumsum(first, dtype=np.uint32)
    buf, lengths = text_bytes(table)
    stays = np.zeros(len(sizes), bool)
    places = dict(by_bucket(bucket.astype(np.int64)))
    for own, answer in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()):
        stays[first[places[own]]] = unpack(answer)[0]
    out, at, byte = [], 0, 0
    for doc_id, n, count in zip(table.column("doc_id").to_pylist(), lengths.tolist(), counts.tolist()):
        own = sizes[at : at + count].astype(np.int64)
        keep = ~removable(~stays[at : at + count], own)
        flags = np.repeat(~keep, own)
        edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2).tolist()
        rest = buf[byte : byte + n][~flags].tobytes()
        out.append((doc_id, n, count, int((~keep).sum()), int(own[~keep].sum()), [{"start": x, "length": y - x} for x, y in edges], hashlib.sha256(rest).hexdigest()))
        at, byte = at + count, byte + n
    kinds = [pa.int64()] * 5 + [pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64()})), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "spans", "kept_sha256"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """For each document its bytes, chunks, removed chunks and bytes, removed spans, and the digest of what stays."""
    docs = columns_of(docs, "doc_id", "text")
    buckets = max(8, -(-corpus_size(docs)[1] // BUCKET_BYTES))
    table = written(in_blocks(docs, lambda t, block: cut_block(t, block, buckets)), "chunks")
    answers = written(table.where("kind = 1").groupBy("bucket").applyInArrow(resolve, PART), "chunk-answers")
    return table.where("kind = 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, SCHEMA)
