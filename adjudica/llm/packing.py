"""Packing documents into training sequences of several context sizes.

A document's token ids, with one id 0 at the end, are cut into windows of the longest size; what is left over is routed
to the smallest tier (context size) that holds it. Each tier is packed: a long window takes a leftover of its own tier
and its gap is filled from the shorter tiers, best fit first, by cutting a piece where nothing fits. What remains at
the end of a block is cut at powers of two, so that it needs no padding. The block's sequences are then dealt to step
groups of equal token counts, longest first.

Documents are packed where they are read, block by block: no shuffle, and memory is bounded by ``BLOCK_TOKENS`` and the
longest document. Ids of sequences and groups hold the number of the task's partition.

Defined cases: a null or empty text is the single id 0; a null doc_id stays null; repeated rows are packed separately;
an empty table gives no rows; other columns are ignored. The marker ``<|endoftext|>`` inside a text keeps its special
id, as in the tokenizer's own file.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import columns_of
from .tokens import encoder

TIERS = (128, 256, 512, 1024)
#: Ids that are packed together; 64 long windows make a step group.
BLOCK_TOKENS, STEP_TOKENS = 4_000_000, 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int]  # length, document, start


class _Tiers:
    """Leftover pieces by tier, each tier sorted by length."""

    def __init__(self, tiers) -> None:
        self.tiers, self.pieces = tiers, [[] for _ in tiers]

    def put(self, piece: Piece) -> None:
        if piece[0]:
            insort(self.pieces[bisect_left(self.tiers, piece[0])], piece)

    def best(self, room: int, below: int) -> Piece | None:
        """The longest piece that fits, from the first `below` tiers."""
        for own in reversed(self.pieces[:below]):
            if own and own[0][0] <= room:
                return own.pop(bisect_right(own, (room, 1 << 62, 0)) - 1)
        return None

    def cut(self, room: int, below: int) -> Piece | None:
        """Where no piece fits: the head of a longer one, of the shortest tier that has any; its tail is routed again."""
        for own in self.pieces[:below]:
            if own:
                length, doc, start = own.pop()
                self.put((length - room, doc, start + room))
                return room, doc, start
        return None


def pack(lengths: list[int], tiers=TIERS) -> list[list[Piece]]:
    """Sequences of pieces. Every sequence but those at the end has the length of a tier."""
    longest, left, out = tiers[-1], _Tiers(tiers), []
    rest = []
    for doc, n in enumerate(lengths):
        out += [[(longest, doc, k)] for k in range(0, n - n % longest, longest)]
        if n % longest:
            rest.append((n % longest, doc, n - n % longest))
    for piece in sorted(rest):
        left.pieces[bisect_left(tiers, piece[0])].append(piece)
    for tier in range(len(tiers) - 1, -1, -1):
        own = left.pieces[tier]
        while own:
            window, room = [own.pop()], 0
            room = tiers[tier] - window[0][0]
            while room and (piece := left.best(room, tier + 1) or left.cut(room, tier + 1)):
                window.append(piece)
                room -= piece[0]
            out.append(window) if not room else out.extend(_powers(window))
    return out


def _powers(window: list[Piece]) -> list[list[Piece]]:
    """The last window of a block, cut into sequences whose lengths are powers of two."""
    total, out = sum(p[0] for p in window), []
    todo = window[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            length, doc, start = todo.pop()
            take = min(room, length)
            out[-1].append((take, doc, start))
            if take < length:
                todo.append((length - take, doc, start + take))
            room -= take
    return out


def step_groups(sizes: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: the longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(-(-sum(sizes) // tokens))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, g = groups[0]
        heapq.heapreplace(groups, (load + sizes[k], g))
        out[k] = g
    return out


def packed(docs: DataFrame, path: str | None = None, tiers=TIERS) -> DataFrame:
    """A row for each piece; offset is the place of its first id in the sequence."""

    def block(ids: list, names: list, base: int, groups: int) -> tuple[pa.RecordBatch, int, int]:
        sequences = pack([len(x) for x in ids], tiers)
        sizes = [sum(p[0] for p in s) for s in sequences]
        group = step_groups(sizes)
        rows: list[tuple] = []
        for k, pieces in enumerate(sequences):
            at = 0
            tier = tiers[min(bisect_left(tiers, sizes[k]), len(tiers) - 1)]
            for length, doc, start in pieces:
                rows.append((names[doc], start, length, zlib.crc32(ids[doc][start : start + length]), len(ids[doc]), base + k, at, tier, groups + group[k]))
                at += length
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        fields = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(columns, fields), base + len(sequences), groups + max(group) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = groups = TaskContext.get().partitionId() << 36
        ids, names, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                ids.append(own)
                names.append(doc_id)
                held += len(own)
                if held >= BLOCK_TOKENS:
                    out, base, groups = block(ids, names, base, groups)
                    ids, names, held = [], [], 0
                    yield out
        if ids:
            yield block(ids, names, base, groups)[0]

    return columns_of(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
