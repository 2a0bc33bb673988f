"""SimHash near-duplicates: fingerprints, linked at a small Hamming distance, grouped into components.

A fingerprint is embedded as the bit counts of its ``SEGMENTS`` two-bit segments. The Manhattan distance of two such
vectors is at most the Hamming distance, so it serves as a lower bound. The range join works on a grid: the coordinates
are dealt to B blocks, and two vectors within distance 3 agree in all coordinates of at least B - 3 blocks, so every
choice of B - 3 blocks gives a grid whose cells hold all pairs in range that agree there. Inside a cell the bound is
tested, then the exact distance. B grows with the number of distinct fingerprints, so that cells stay small. Cells are
streamed, one after another, through the tasks; one with more than ``BLOCK`` fingerprints goes on to a second pass, which
deals it out as pairs of blocks and tests these alike. Of a cell's links only a spanning forest leaves the task.
Components come from alternating star contraction, written to the shared folder after each round.

Equal fingerprints are one node, so copies cost one row each and are never paired. Fingerprints that more than one row
in ``HOT`` has (so ``HOT`` of them at most) reach their rows by broadcast, the others by a shuffle; likewise the hubs of
large components and their neighbours.

Defined cases: null or empty text has fingerprint zero and is linked like any other; a null doc_id gets a fingerprint
and links others like any row, and its component is named by the smallest doc_id in it, null if there is none; repeated
rows fall together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, written

SHINGLE, BITS, SEED = 3, 3, 42
SEGMENTS = 32
#: Fingerprints that a cell of random ones holds on average, at most; fingerprints of one task's comparison.
PER_CELL, BLOCK = 4, 8192
#: A fingerprint of more than one row in HOT is hot.
HOT = 2000
#: Rows of a group that is not dealt by its key.
LARGE = 20_000
LOW = np.uint64(0x5555555555555555)
ONE = np.uint64(1)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), ">u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            own = np.array([fingerprint(t or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def counts_in_unary(fp: np.ndarray) -> np.ndarray:
    """The 32 segment counts (0, 1, 2), each written as 00, 01, 11: Manhattan distance is then the number of unequal bits."""
    high = (fp >> ONE) & LOW
    return ((fp & LOW) | high) | (((fp & LOW) & high) << ONE)


def block_masks(blocks: int, bits: int, width: int = 2) -> list[int]:
    """Masks of `blocks` runs of whole segments, and of every choice of all but `bits` of them."""
    edges = [round(k * 64 / width / blocks) * width for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(own, blocks - bits)]


def choose_blocks(rows: int, bits: int = BITS) -> int:
    """The fewest blocks for which random fingerprints share a cell with few others; a coordinate carries 1.5 bits."""
    return next(b for b in range(bits + 2, 17) if b == 16 or rows <= PER_CELL * 2 ** (1.5 * SEGMENTS * (b - bits) / b))


def close_pairs(fp: np.ndarray, bits: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span what is linked within one cell."""
    unary, left, right = counts_in_unary(fp), [], []
    for a in range(0, len(fp), step):
        for b in range(a, len(fp), step):
            i, j = np.nonzero(np.bitwise_count(unary[a : a + step, None] ^ unary[None, b : b + step]) <= bits)
            i, j = i + a, j + b
            keep = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= bits)
            names, both = np.unique(np.concatenate([i[keep], j[keep]]), return_inverse=True)
            root = forest(both[: len(both) // 2], both[len(both) // 2 :], len(names))
            left.append(names), right.append(names[root])
    return np.concatenate(left), np.concatenate(right)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index linked with each of n, by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def cell_links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that spans what is linked inside the cells; small cells are compared lag by lag."""
    order = np.lexsort((fp, key))
    key, at = key[order], fp[order]
    unary = counts_in_unary(at)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    place = np.arange(len(key)) - np.repeat(starts, sizes)
    room = np.repeat(sizes, sizes) - place
    small = np.repeat(sizes <= 64, sizes)
    left, right = [], []
    lag = 1
    todo = np.flatnonzero(small & (room > 1))
    while len(todo):
        other = todo + lag
        near = np.bitwise_count(unary[todo] ^ unary[other]) <= bits
        a, b = todo[near], other[near]
        keep = np.bitwise_count(at[a] ^ at[b]) <= bits
        left.append(a[keep]), right.append(b[keep])
        lag += 1
        todo = todo[room[todo] > lag]
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        i, j = close_pairs(at[s : s + n], bits)
        left.append(i + s), right.append(j + s)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def spanning(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Edges (a > b) between the values of fp that connect what the pairs (i, j) do."""
    names, both = np.unique(np.concatenate([fp[i], fp[j]]).view(np.int64), return_inverse=True)
    root = forest(both[: len(i)], both[len(i) :], len(names))
    own = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], ["a", "b"])


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, bool]]:
    """From batches sorted by their first column: tables of about `rows` rows that hold whole groups of equal value, and of
    groups with more rows than that, pieces as they come (False), so that no group is ever held."""
    held, size, larger = [], 0, None
    for batch in batches:
        if larger is not None:
            n = int(np.searchsorted(batch.column(0).to_numpy(), larger, side="right"))
            if n:
                yield pa.Table.from_batches([batch.slice(0, n)]), False
            if n == batch.num_rows:
                continue
            batch, larger = batch.slice(n), None
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield table.slice(0, cut), True
                held, size = table.slice(cut).to_batches(), len(key) - cut
            else:
                yield table, False
                held, size, larger = [], 0, key[-1]
    if size:
        yield pa.Table.from_batches(held), True


def in_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same with whole groups only, for groups that are bounded: more than `rows` rows at a time if one group has more.
    Its pieces are put together once."""
    open_group: list[pa.Table] = []
    for table, whole in in_pieces(batches, rows):
        if open_group and (whole or table.column(0)[0] != open_group[0].column(0)[0]):
            yield pa.concat_tables(open_group).combine_chunks()
            open_group = []
        if whole:
            yield table
        else:
            open_group.append(table)
    if open_group:
        yield pa.concat_tables(open_group).combine_chunks()


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a > b) between the distinct fingerprints of `nodes` that differ in at most `bits` bits; what they connect is complete."""
    masks = np.array(block_masks(choose_blocks(nodes.count(), bits), bits), np.uint64)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                fp = np.asarray(part.column(0)).view(np.uint64)
                grid = counts_in_unary(fp)[:, None] & masks[None, :]
                grid = (grid ^ (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).ravel()
                again = np.repeat(np.arange(len(fp)), len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(grid.view(np.int64)), part.column(0).take(again)], ["cell", "fp"])

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the cells (cell null), and the rows of those that are larger than one block."""
        for table, whole in in_pieces(batches, 2 * BLOCK):
            cell, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[start, len(cell)])
            large = np.repeat(size > BLOCK, size) if whole else np.ones(len(cell), bool)
            found = spanning(fp[~large], *cell_links(cell[~large].view(np.uint64), fp[~large], bits))
            none = pa.nulls(found.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, found.column(0), found.column(1)], ["cell", "a", "b"])
            over = fp[large].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[large]), pa.array(over), pa.array(over)], ["cell", "a", "b"])

    def in_blocks(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("a").to_numpy()).view(np.uint64)
        return pa.Table.from_batches([spanning(fp, *close_pairs(fp, bits))])

    cells = nodes.select("fp").mapInArrow(to_cells, "cell long, fp long")
    found = written(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(in_cells, "cell long, a long, b long"), "cells")
    over = dealt_in_pairs(found.where("cell is not null").select("cell", "a"), "cell", "a", BLOCK)
    return found.where("cell is null").select("a", "b").unionByName(over.groupBy("cell", "p", "q").applyInArrow(in_blocks, "a long, b long")).distinct()


def dealt_in_pairs(members: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """members with p and q: each group of `key` is dealt to blocks of about `block` members, and a row goes to all pairs
    of blocks that hold its own."""
    count = F.ceil(F.col("_n") / block)
    mine = F.pmod(F.xxhash64(member, F.lit(1)), count)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.struct(F.least(k, mine).alias("p"), F.greatest(k, mine).alias("q")))
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return joined_with(members, sizes, key, "_n").select(*members.columns, F.explode(pairs).alias("_e")).select(*members.columns, "_e.p", "_e.q")


def joined_with(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with what `groups` says of their group (one row a key, with its size). Groups of more than LARGE rows are
    broadcast, one row for LARGE of rows at most, and their rows stay where they are; only the others are dealt by the key."""
    large = F.broadcast(groups.where(F.col(size) > LARGE))
    small = rows.join(large.select(key), key, "left_anti").join(groups.where(F.col(size) <= LARGE), key)
    return rows.join(large, key).unionByName(small)


def components(edges: DataFrame) -> DataFrame:
    """a, b: the smallest id b that a is connected with, for every a that is not itself the smallest.

    Alternating stars: each node's larger neighbours are tied to its smallest, then its smaller ones; every round is
    written, and rounds go on until the edges no longer change.
    """
    edges, mark = written(edges, "links"), None
    size = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        hub = F.broadcast(least.where(F.col("n") * HOT > 2 * size))  # HOT rows at most; a hub's neighbours stay where they are
        rare = both.where("b > a").join(hub.select("a"), "a", "left_anti").join(least, "a")
        large = both.where("b > a").join(hub, "a").unionByName(rare).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct(), "stars")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return edges
        mark, size = tuple(row), row[0]


def grouped(docs: DataFrame, width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach)."""
    own = written(fingerprints(docs, width), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "fp-nodes")
    tied = components(links(nodes, bits))
    rooted = nodes.join(tied, F.col("fp") == F.col("a"), "left").select("fp", "rows", "id", F.coalesce("b", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    labels = written(joined_with(rooted, least, "root", "members").select("fp", "rows", "component_id"), "fp-components")
    often = F.col("rows") * HOT > own.count()
    hot = F.broadcast(labels.where(often).select("fp", "component_id"))  # HOT rows at most
    rare = own.join(hot.select("fp"), "fp", "left_anti").join(labels.where(~often).select("fp", "component_id"), "fp")
    return own.join(hot, "fp").unionByName(rare).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
