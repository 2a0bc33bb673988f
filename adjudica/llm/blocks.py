"""Blocks of whole documents, and what they send to buckets and get back.

A message is one row (kind, block, bucket, payload): all that a block has for a bucket, packed. Rows with kind 0 are the
blocks themselves. Every pass over them is a Spark job that groups by bucket or by block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 2 << 20
#: The place of a null doc_id in the order of ids.
LAST = np.iinfo(np.int64).max
PART = "kind byte, block long, bucket int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one or two dimensions as bytes, each led by its type, width (0 for one dimension) and length; larger
    messages are compressed. Small ones, of which there are many, stay small."""
    raw = b"".join(b"".join((struct.pack("<cBI", a.dtype.char.encode(), a.shape[1] if a.ndim > 1 else 0, len(a)), a.tobytes())) for a in arrays)
    return b"\1" + zstandard.compress(raw, 1) if len(raw) > 400 else b"\0" + raw


def unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    raw, at, out = zstandard.decompress(payload[1:]) if payload[0] else payload[1:], 0, []
    while at < len(raw):
        char, width, n = struct.unpack_from("<cBI", raw, at)
        values = n * max(1, width)
        own = np.frombuffer(raw, np.dtype(char.decode()), values, at + 6)
        out.append(own.reshape(n, width) if width else own)
        at += 6 + own.nbytes
    return tuple(out)


def parts(rows: list[tuple]) -> pa.Table:
    kind, block, bucket, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int8()), "block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "payload": pa.array(payload, pa.binary())})


def text_bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(LAST).to_numpy()


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the places of its fragments in their order."""
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[own[0]]), own


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def in_blocks(docs: DataFrame, cut: Callable[[pa.Table, int], list[tuple]], block_bytes: int | None = None) -> DataFrame:
    """What `cut` makes of each block of documents (doc_id, text, ...); `cut` gets the block's number. A block holds
    `block_bytes` (BLOCK_BYTES) of text or one longer document."""
    block_bytes = block_bytes or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(np.frombuffer(batch.column(1).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(1).offset :][: batch.num_rows + 1])
            ends, first = np.cumsum(lengths), 0
            while first < len(ends):  # as many documents as the block has room for, one at least if it is empty
                begun = ends[first] - lengths[first]
                last = max(int(np.searchsorted(ends, begun + block_bytes - size, side="right")), first + (not held))
                if last > first:
                    held.append(batch.slice(first, last - first))
                    size += int(ends[last - 1] - begun)
                if last < len(ends):
                    yield from parts(cut(pa.Table.from_batches(held), block)).to_batches()
                    block, held, size = block + 1, [], 0
                first = last
        if held:
            yield from parts(cut(pa.Table.from_batches(held), block)).to_batches()

    return docs.mapInArrow(run, PART)
