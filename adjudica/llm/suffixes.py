"""Removal of repeated byte strings with run-length indexes.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document with a smaller id,
or earlier in the same one. The corpus is too large for one index, so its windows are dealt out by their anchors (see
``anchors``): fragments whose anchors have one hash meet in one bucket, and no other fragment can share a window with
them. Four passes over blocks of whole documents, each a Spark job whose result is written to the shared folder:

1. blocks: documents are read once and cut into fragments. Of equal fragments of a block, all but the first are repeats; the
   first ones' anchor hash and digest go to their bucket.
2. resolve: copies of a fragment all but the first are repeats as a whole; first ones that share their anchor with other
   contents have to be indexed.
3. index: the blocks send these fragments to their bucket. What shares neither the bytes to the left nor to the right of
   its anchor with another is set aside; of the others a run-length index is built, group by group of bounded size, and
   the matching statistics that stream from its sampled run ends tell which windows start earlier too.
4. marks: the blocks turn both answers into removed spans.

Frequent anchors (a line that a third of all documents share) are cut finer, by absolute bounds. A piece is a run of windows
at the same places around their anchor, and its key is the hash of the bytes that all windows at these places hold, which
is more than the anchor: equal windows still meet. Fragments of a bucket that more than ``FULL`` fragments go to are dealt
out as pieces of ``WIDTHS[0]`` windows, and those of a bucket that is full of pieces as pieces of ``WIDTHS[1]``. Likewise, a
group of one anchor that is larger than ``GROUP_BYTES`` is indexed piece by piece.

What travels is packed in one binary value for each block and bucket, so a pass costs bytes, not rows. A block holds
``blocks.BLOCK_BYTES`` (or one longer document) and a bucket the anchors of about ``BUCKET_BYTES`` of text.

Defined cases: null text is empty; texts under WINDOW bytes keep everything; a null doc_id comes after all others;
of rows with one doc_id the one read first comes first; an empty table gives no rows; other columns pass through
`keep` or are left out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runindex
from .anchors import GRAM, MOST, WINDOW, digests, fragments, gram_hashes_at, mixed
from .blocks import PART, by_bucket, from_ipc, ids_of, in_blocks, pack, parts, text_bytes, to_ipc, unpack
from .common import columns_of, corpus_size, written

BUCKET_BYTES, INDEX_BYTES, GROUP_BYTES = 24 << 20, 1 << 18, 1 << 22
#: Fragments of a full bucket (BUCKET_BYTES of text have about half as many), and the windows of the pieces they are cut into.
FULL, WIDTHS = 2_000_000, (8, 1)
NOTHING, COPY, INDEXED = 0, 1, 2
#: Every window holds so many bytes beside its anchor on one side.
SIDE = (MOST - 1) // 2


def six(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each value as bytes."""
    return np.ascontiguousarray((x >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])


def from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view(np.uint64).ravel()


def repeated(key: np.ndarray, content: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an earlier piece has the same key and content; those of one document stand in their order."""
    order = np.lexsort((ids, content, key))
    out = np.zeros(len(key), bool)
    out[order[1:]] = (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1])
    return out


def finer(buf: np.ndarray, start: np.ndarray, offset: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The windows [low, high) of fragments as pieces of at most `width`: each piece's fragment, its windows, its key."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    window = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    place = (offset[of] - window) // width
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1])][: len(of)])
    of, place = of[new], place[new]
    held = start[of] + offset[of] - place * width  # where the last window at these places starts
    order = np.argsort(held, kind="stable")
    key = np.empty(len(of), np.uint64)
    key[order] = digests(buf, held[order], np.full(len(of), WINDOW - width + 1))
    return of, window[new], window[new] + np.diff(np.r_[new, len(window)]), key


def messages(block: int, h: np.ndarray, d: np.ndarray, ids: np.ndarray, doc: np.ndarray, buckets: dict[int, np.ndarray]) -> Iterator[tuple]:
    for bucket, own in buckets.items():
        names, at = np.unique(doc[own], return_inverse=True)
        yield 1, block, bucket, pack(h[own], d[own], ids[names], at.astype(np.uint32))


def fullness(block: int, buckets: dict[int, np.ndarray]) -> tuple:
    """How many fragments go to each bucket (kind 5)."""
    return 5, block, -1, pack(np.array(list(buckets), np.int32), np.array([len(own) for own in buckets.values()], np.uint32))


def cut_block(table: pa.Table, block: int, buckets: int) -> list[tuple]:
    """The block itself (kind 0) and what it sends to the buckets (kind 1)."""
    buf, lengths = text_bytes(table)
    ids = ids_of(table)
    doc, start, windows, anchor, h = fragments(buf, lengths)
    d, h = digests(buf, start, windows + WINDOW - 1), six(h)
    again = repeated(from_six(h), d, ids[doc])
    shape = pack(np.bincount(doc, minlength=len(ids)).astype(np.uint32), windows.astype(np.uint8), (anchor - start).astype(np.uint8), again)
    first = np.flatnonzero(~again)
    dealt = {bucket: first[own] for bucket, own in by_bucket((from_six(h[first]) % np.uint64(buckets)).astype(np.int64))}
    return [(0, block, -1, pickle.dumps((to_ipc(table), shape), protocol=5)), fullness(block, dealt), *messages(block, h, d, ids, doc, dealt)]


def full_buckets(counts: DataFrame, buckets: int) -> np.ndarray:
    """A flag for each bucket; the numbers of full ones, one in FULL fragments at most, are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                bucket, n = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], ["bucket", "n"])

    full = np.zeros(buckets, bool)
    total = counts.where("kind = 5").select("payload").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    full[[r["bucket"] for r in total.where(F.col("n") > FULL).select("bucket").collect()]] = True
    return full


class Block:
    """A block with its fragments, as cut_block has left it. Those of full buckets are pieces: full[k] has the full buckets
    of the k-th dealing. `copies` are repeats within the block, of which nothing is sent."""

    def __init__(self, payload: bytes, buckets: int, full: tuple[np.ndarray, ...]) -> None:
        table, shape = pickle.loads(payload)
        self.table = from_ipc(table)
        self.buf, self.lengths = text_bytes(self.table)
        self.ids = ids_of(self.table)
        counts, windows, offset, again = unpack(shape)
        windows, offset = windows.astype(np.int64), offset.astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        before = np.cumsum(windows) - windows
        firsts = np.cumsum(counts, dtype=np.int64) - counts
        start = before + np.repeat((np.cumsum(self.lengths) - self.lengths) - np.append(before, 0)[np.minimum(firsts, len(before))], counts)
        h = six(gram_hashes_at(self.buf, start + offset)) if len(offset) else np.zeros((0, 6), np.uint8)
        level, sent, copies = (doc, start, windows, offset, h), [], []
        for k in range(len(full) + 1):
            copies.append((level[1][again], level[2][again]))
            level = tuple(x[~again] for x in level)
            bucket = (from_six(level[4]) % np.uint64(buckets)).astype(np.int64)
            stays = ~full[k][bucket] if k < len(full) else np.ones(len(bucket), bool)
            sent.append(tuple(x[stays] for x in level))
            if stays.all():
                break
            doc, start, windows, offset, _ = (x[~stays] for x in level)
            of, low, high, key = finer(self.buf, start, offset, np.zeros_like(windows), windows, WIDTHS[k])
            level = doc[of], start[of] + low, high - low, offset[of] - low, six(key)
            again = repeated(from_six(level[4]), digests(self.buf, level[1], level[2] + WINDOW - 1), self.ids[level[0]])
        self.newest = sent[-1] if len(sent) > len(full) else tuple(x[:0] for x in sent[-1])
        columns = [np.concatenate(x) for x in zip(*sent)]
        order = np.argsort(columns[1], kind="stable")
        self.doc, self.start, self.windows, self.offset, self.h = (x[order] for x in columns)
        self.copies = tuple(np.concatenate(x) for x in zip(*copies))
        self.buckets = dict(by_bucket((from_six(self.h) % np.uint64(buckets)).astype(np.int64)))


def newest_pieces(block: int, own: Block, buckets: int) -> list[tuple]:
    """How many pieces of the last dealing go to each bucket."""
    return [fullness(block, dict(by_bucket((from_six(own.newest[4]) % np.uint64(buckets)).astype(np.int64))))]


def all_messages(block: int, own: Block, buckets: int) -> list[tuple]:
    """What a block sends to the buckets once full ones are known."""
    return list(messages(block, own.h, digests(own.buf, own.start, own.windows + WINDOW - 1), own.ids, own.doc, own.buckets))


def of_blocks(blocks: DataFrame, what: Callable[[int, Block, int], list[tuple]], buckets: int, full: tuple[np.ndarray, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                yield from parts(what(block, Block(payload.as_py(), buckets, full), buckets)).to_batches()

    return blocks.mapInArrow(run, PART)


def resolve(table: pa.Table) -> pa.Table:
    """Of one bucket: an answer for each fragment."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
    parts_ = [unpack(p) for _, p in rows]
    h, d = from_six(np.concatenate([p[0] for p in parts_])), np.concatenate([p[1] for p in parts_])
    doc = np.concatenate([p[2][p[3]] for p in parts_])
    order = np.lexsort((doc, d, h))
    new_h = np.r_[True, h[order][1:] != h[order][:-1]]
    new_d = new_h | np.r_[True, d[order][1:] != d[order][:-1]]
    group = np.cumsum(new_h) - 1
    several = np.bincount(group, new_d)[group] > 1
    answer = np.empty(len(h), np.uint8)
    answer[order] = np.where(~new_d, COPY, np.where(several, INDEXED, NOTHING))
    bucket = table.column("bucket")[0].as_py()
    ends = np.cumsum([len(p[0]) for p in parts_])
    return parts([(2, block, bucket, pack(a)) for (block, _), a in zip(rows, np.split(answer, ends[:-1]))])


def send(blocks: pa.Table, answers: pa.Table, buckets: int, full: tuple[np.ndarray, ...]) -> pa.Table:
    """The fragments of one block that have to be indexed (kind 3), to their buckets."""
    if not blocks.num_rows:
        return parts([])
    own, out = Block(blocks.column("payload")[0].as_py(), buckets, full), []
    block = blocks.column("block")[0].as_py()
    for bucket, payload in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()):
        at = own.buckets[bucket][unpack(payload)[0] == INDEXED]
        if len(at):
            lengths = own.windows[at] + WINDOW - 1
            take = np.repeat(own.start[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            out.append((3, block, bucket, pack(own.h[at], lengths.astype(np.uint8), own.ids[own.doc[at]], own.buf[take], own.offset[at].astype(np.uint8))))
    return parts(out)


def shared(h: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Whether another fragment has the same anchor and context."""
    order = np.lexsort((context, h))
    same = (h[order][1:] == h[order][:-1]) & (context[order][1:] == context[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def sharing_windows(h: np.ndarray, text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows [low, high) of each fragment that another fragment can have.

    A window holds SIDE bytes next to its anchor on the left, or else on the right. So windows of the first kind have a
    partner only where a fragment with the same anchor has the same bytes there, and likewise those of the second.
    """
    words = np.lib.stride_tricks.as_strided(text, (max(0, len(text) - 7), 8), (1, 1))
    windows, alone = lengths - WINDOW + 1, np.arange(len(h), dtype=np.uint64)

    def side(at: np.ndarray, there: np.ndarray) -> np.ndarray:
        at, value = np.where(there, at, begin), np.zeros(len(h), np.uint64)
        for k in (0, 8, 16, SIDE - 8):
            value = mixed(value + words[at + k].copy().view("<u8").ravel())
        return shared(h, np.where(there, value, alone)) & there

    left = side(begin + offset - SIDE, offset >= SIDE)
    right = side(begin + offset + GRAM, lengths - offset - GRAM >= SIDE)
    edge = np.clip(offset - SIDE + 1, 0, windows)  # windows from here on are of the second kind
    return np.where(left, 0, edge), np.where(right, windows, edge)


def index(table: pa.Table) -> pa.Table:
    """Of one bucket: for each fragment sent, the windows that start earlier in another one. What no other fragment can
    have is left out of the indexes."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
    parts_ = [unpack(p) for _, p in rows]
    h = from_six(np.concatenate([p[0] for p in parts_]))
    lengths = np.concatenate([p[1] for p in parts_]).astype(np.int64)
    ids = np.concatenate([p[2] for p in parts_])
    text = np.frombuffer(b"".join(p[3] for p in parts_), np.uint8)
    offset = np.concatenate([p[4] for p in parts_]).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    low, high = sharing_windows(h, text, begin, lengths, offset)
    masks = np.zeros(len(h), np.uint64)
    at = np.flatnonzero(high > low)
    low, high, key = low[at], high[at], h[at]
    for width in WIDTHS:
        large = too_large(key, high - low + WINDOW - 1)
        match(text, begin, ids, masks, *(x[~large] for x in (at, low, high, key)))
        of, low, high, key = finer(text, begin[at[large]], offset[at[large]], low[large], high[large], width)
        at = at[large][of]
        again = repeated(key, digests(text, begin[at] + low, high - low + WINDOW - 1), ids[at])
        np.bitwise_or.at(masks, at[again], ((np.uint64(1) << (high - low).astype(np.uint64)) - np.uint64(1) << low.astype(np.uint64))[again])
        at, low, high, key = (x[~again] for x in (at, low, high, key))
        some = shared(key, np.zeros(len(key), np.uint64))
        at, low, high, key = (x[some] for x in (at, low, high, key))
    match(text, begin, ids, masks, at, low, high, key)
    bucket = table.column("bucket")[0].as_py()
    ends = np.cumsum([len(p[0]) for p in parts_])
    return parts([(4, block, bucket, pack(m)) for (block, _), m in zip(rows, np.split(masks, ends[:-1]))])


def too_large(key: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the pieces with this key are over GROUP_BYTES together."""
    group = np.unique(key, return_inverse=True)[1]
    return np.bincount(group, lengths, minlength=1)[group] > GROUP_BYTES


def match(text, begin, ids, masks, at, low, high, key) -> None:
    """Sets the windows [low, high) of fragments `at` that start earlier in another with the same key, by run-length indexes
    over whole groups of one key, up to INDEX_BYTES together or one larger group."""
    lengths, start = high - low + WINDOW - 1, begin[at] + low
    order = np.lexsort((ids[at], key))
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.cumsum(lengths[order])
    first = 0
    while first < len(order):
        reach = np.searchsorted(size, (size[first - 1] if first else 0) + INDEX_BYTES)
        later = new[np.searchsorted(new, max(reach, first + 1)) :]
        last = int(later[0]) if len(later) else len(order)
        own = order[first:last]
        n = lengths[own]
        end = np.cumsum(n + 1) - n - 1
        laid = np.zeros(int((n + 1).sum()), np.uint8)
        laid[np.repeat(end - (np.cumsum(n) - n), n) + np.arange(n.sum())] = text[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        np.bitwise_or.at(masks, at[own], runindex.matches(runindex.build(laid, n), n, WINDOW) << low[own].astype(np.uint64))
        first = last


def removed(own: Block, answers: pa.Table) -> np.ndarray:
    """A flag for each byte of a block."""
    edge = np.zeros(len(own.buf) + 1, np.int32)

    def gone(start: np.ndarray, windows: np.ndarray) -> None:
        np.add.at(edge, start, 1)
        np.add.at(edge, start + windows + WINDOW - 1, -1)

    gone(*own.copies)
    found = {(k, b): p for k, b, p in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("payload").to_pylist())}
    for (kind, bucket), payload in found.items():
        if kind != 2:
            continue
        answer, at = unpack(payload)[0], own.buckets[bucket]
        copies = at[answer == COPY]
        gone(own.start[copies], own.windows[copies])
        if (4, bucket) in found:
            masks = unpack(found[4, bucket])[0]
            which, bit = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            gone(own.start[at[answer == INDEXED]][which] + bit, np.ones(len(bit), np.int64))
    return np.cumsum(edge[:-1]) > 0


def whole_characters(buf: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are gone."""
    if gone.any():
        begins = np.flatnonzero((buf & 0xC0) != 0x80)
        buf = buf[~np.repeat(np.logical_and.reduceat(gone, begins), np.diff(np.r_[begins, len(buf)]))]
    return buf.tobytes().decode()


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """doc_id, the columns of `keep`, n_bytes, n_removed, spans (removed stretches: start, length), kept_sha256 and, if
    asked for, kept (the remaining text, in which a character that is only partly removed stays whole; null for null)."""
    docs = columns_of(docs, "doc_id", "text", *keep)
    rows, size = corpus_size(docs)
    buckets = max(8, -(-size // BUCKET_BYTES))

    table = written(in_blocks(docs, lambda t, block: cut_block(t, block, buckets)), "fragments")
    blocks = table.where("kind = 0")
    sent = table.where("kind = 1")
    full = (full_buckets(table, buckets),)
    if full[0].any():
        full += (full_buckets(of_blocks(blocks, newest_pieces, buckets, full), buckets),)
        sent = of_blocks(blocks, all_messages, buckets, full)
    answers = written(sent.groupBy("bucket").applyInArrow(resolve, PART), "answers")
    to_bucket = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: send(b, a, buckets, full), PART)
    matched = written(to_bucket.groupBy("bucket").applyInArrow(index, PART), "matched")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items() if n != "text") + ", n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string, kept string"

    def mark(b: pa.Table, a: pa.Table) -> pa.Table:
        own = Block(b.column("payload")[0].as_py(), buckets, full)
        gone = removed(own, a)
        out: list[tuple] = []
        ends = np.cumsum(own.lengths)
        absent = own.table.column("text").is_null().to_pylist()
        for end, n, null in zip(ends, own.lengths, absent):
            flags = gone[end - n : end]
            edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2).tolist()
            rest = own.buf[end - n : end][~flags].tobytes()
            out.append((int(n), int(n) - len(rest), [{"start": x, "length": y - x} for x, y in edges], hashlib.sha256(rest).hexdigest(), whole_characters(own.buf[end - n : end], flags) if texts and not null else None))
        spans = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64()}))
        new = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), spans, pa.string(), pa.string()))]
        own_columns = own.table.drop_columns("text")
        return pa.table([*own_columns.columns, *new], names=[*own_columns.column_names, "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    both = answers.unionByName(matched)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(mark, schema)


def summary(docs: DataFrame) -> DataFrame:
    """Counts for each document."""
    done = deduplicated(docs, texts=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
