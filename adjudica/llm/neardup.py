"""Near-duplicates by exact Jaccard similarity: sets of 5-word shingles that share 4 in 5 or more are linked.

The method is that of ``simhash``, with a fingerprint that tells such texts apart: 64 majority bits differ in about 10
places at this similarity, which no grid of a few blocks can find. Here the fingerprint has one bit for each hashed
shingle, and it is embedded as the bit counts of its segments. The Manhattan distance of two such vectors is at most the
number of unequal bits, and that is at most (a + b) / 9 for sets of a and b shingles with a similarity of 0.8.

1. Grid: texts are dealt to classes by the size of their sets (a class spans a ratio of 5 to 4, and a text is also laid
   into the class below, so that all sizes in range meet). A class has a number of grids; each looks at a share of the
   segments, chosen by chance, and a cell holds the texts whose counts agree there. The share is so small that a pair in
   range agrees in one grid with the probability ``p``, and there are ``SURE / p`` grids: a pair right at 0.8 is missed in
   all of them once in e**SURE times, closer pairs far less. Shares shrink and grids grow with the number of texts, so that
   cells of texts that have nothing in common stay small.
2. Bound: within a cell the Manhattan distances of segment counts are tested, of 64 segments or more (see ``coarse``);
   what no bound connects is parted.
3. Exact: what is left is verified on the whole sets, first every text once, in the largest group that it is in; then the
   groups that still hold texts of different components.

Equal sets are one node and never paired. Cells of more than ``BLOCK`` nodes are dealt out as pairs of blocks. In a group
each node is compared with what no link has reached yet, so a group of copies costs one comparison a node, and of its
links only a spanning forest leaves the task.

Defined cases: words are cut and lower-cased as in op1; a text of fewer than 5 words is one shingle; texts without words
are one node; nodes are numbered by their smallest doc_id, those without an id come last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, written
from .simhash import SEED, components, dealt_in_pairs, forest, in_groups, in_pieces

SHINGLE = 5
#: Similarity that links, as a fraction.
PART, WHOLE = 4, 5
#: Grids for each pair's chance; segments of the bound at least, and shingles for which these are enough; nodes of one comparison.
SURE, COARSE, ENOUGH, BLOCK = 7.0, 64, 512, 4096
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of all shingles."""
    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, len(starts)))


def content(own: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(own.tobytes())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Grids:
    """The grids for a number of texts: bits that a cell tells apart, and how many grids there are."""

    def __init__(self, texts: int) -> None:
        self.bits = max(14.0, math.log2(max(1, texts)))
        ratio = WHOLE / PART
        # sets in range in one class have (ratio + ratio**2) * lower / 9 unequal bits at most
        self.count = math.ceil(SURE / 2 ** (-self.bits / 2 * (ratio + ratio**2) * (WHOLE - PART) / (WHOLE + PART)))

    @staticmethod
    def classes(n: int) -> list[int]:
        """The class of a set of n shingles, and the one below, if sets in range can be there."""
        own = next(k for k in range(int(math.log(n) / math.log(WHOLE / PART)), -1, -1) if (WHOLE / PART) ** k <= n) if n else -1
        return [own, own - 1] if own > 0 else [own]

    def cells(self, own: np.ndarray) -> np.ndarray:
        """A number for each class and grid; equal counts in the segments that the grid looks at give equal numbers."""
        out = []
        for k in self.classes(len(own)):
            lower = (WHOLE / PART) ** max(k, 0)
            segments = np.uint64(max(256, 1 << math.ceil(math.log2(4 * lower))))
            looks = np.uint32(min(2**32 - 1, int((1 - 2 ** (-self.bits / 2 / lower)) * 2**32)))
            grid = mixed(np.arange(self.count, dtype=np.uint64) * _MIX[0] + np.uint64(k + 1))
            factor, shift, sums = (grid >> np.uint64(32)).astype(np.uint32) | np.uint32(1), grid.astype(np.uint32), grid.copy()
            segment = (own & (segments - np.uint64(1))).astype(np.uint32)
            for at in range(0, len(own), 1024):
                x = (segment[at : at + 1024, None] ^ shift) * factor
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x846CA68B)
                shingle, seen = np.nonzero(x < looks)
                np.add.at(sums, seen, mixed(segment[at + shingle] * _MIX[0] + grid[seen]))
            out.append(sums)
        return np.concatenate(out).view(np.int64)


def coarse(own: np.ndarray) -> bytes:
    """Counts of segments: COARSE of them, and four times as many for every four times ENOUGH, as long texts need more to
    be told apart. At 255 counts end, which shortens distances but makes none longer."""
    bits = COARSE.bit_length() - 1
    while len(own) >= ENOUGH << (bits - 6) and bits < 14:
        bits += 2
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(counts: list[bytes]) -> np.ndarray:
    """Counts of several texts, put together to the fewest segments that any of them has."""
    least = min(map(len, counts))
    return np.stack([np.frombuffer(c, np.uint8).reshape(least, -1).sum(1, dtype=np.int16) for c in counts])


def signatures(docs: DataFrame, grids: Grids) -> DataFrame:
    """doc_id, content (digest of the set), size, counts, cells."""
    fields = "doc_id long, content binary, size long, counts binary, cells array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            cells = [grids.cells(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *cells])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(content, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(coarse, sets), pa.binary()), lists], [f.split()[0] for f in fields.split(", ")])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, fields)


def with_content(docs: DataFrame) -> DataFrame:
    """docs with the column `_content`."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [content(shingles(t or b"")) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], [*batch.schema.names, "_content"])

    return docs.mapInArrow(run, docs.withColumn("_content", F.lit(b"")).schema)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest index that links reach, for each set. A node is compared only with those not reached before it."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    root, rest, todo, start = np.full(len(sets), -1), np.ones(len(sets), bool), [], 0
    while rest.any() or todo:
        if not todo:
            start = int(np.argmax(rest))
            rest[start], root[start] = False, start
            todo = [start]
            open_ = rest[owner]
            flat, owner = flat[open_], owner[open_]
        own = sets[todo.pop()]
        if not len(owner):
            todo = []
            continue
        place = np.minimum(np.searchsorted(own, flat), max(0, len(own) - 1))
        common = np.bincount(owner[own[place] == flat], minlength=len(sets)) if len(own) else np.zeros(len(sets), np.int64)
        near = np.flatnonzero(rest & (common > 0) & (WHOLE * common >= PART * (sizes + len(own) - common)))
        if len(near):
            rest[near], root[near] = False, start
            todo += near.tolist()
            open_ = rest[owner]
            flat, owner = flat[open_], owner[open_]
    return root


def reached(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smallest index that links reach, for each of n; near(k, rest) tells which of the indices `rest` are linked with k."""
    root, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        start, rest = int(rest[0]), rest[1:]
        root[start], todo = start, [start]
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            if hit.any():
                root[rest[hit]] = start
                todo += rest[hit].tolist()
                rest = rest[~hit]
    return root


def in_bound(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a Manhattan distance of the counts allows the similarity of sets with a and b shingles."""
    return (WHOLE + PART) * distance <= (WHOLE - PART) * (a + b)


def within_bound(size: np.ndarray, counts: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda k, rest: in_bound(np.abs(counts[rest] - counts[k]).sum(1, dtype=np.int64), size[rest], size[k])


def bounded_roots(size: np.ndarray, counts: list[bytes], group: np.ndarray) -> np.ndarray:
    """The smallest index that the bound connects each row with, inside the groups (starts of runs of rows, of up to 64
    rows each): all groups are compared together, neighbours at growing distances."""
    ends = np.r_[group[1:], len(size)]
    room = np.repeat(ends, ends - group) - np.arange(len(size))
    least = np.minimum.reduceat(np.array([len(c) for c in counts]), group)
    wide = np.repeat(least, ends - group)
    left, right = [], []
    for width in np.unique(least):
        own = np.flatnonzero(wide == width)
        vector = np.stack([np.frombuffer(counts[k], np.uint8).reshape(width, -1).sum(1, dtype=np.int16) for k in own])
        place = np.zeros(len(size), np.int64)
        place[own] = np.arange(len(own))
        lag, todo = 1, own[room[own] > 1]
        while len(todo):
            near = in_bound(np.abs(vector[place[todo]] - vector[place[todo + lag]]).sum(1, dtype=np.int64), size[todo], size[todo + lag])
            left.append(todo[near]), right.append(todo[near] + lag)
            lag += 1
            todo = todo[room[todo] > lag]
    none = np.zeros(0, np.int64)
    return forest(np.concatenate([none, *left]), np.concatenate([none, *right]), len(size))


def part_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, counts) in the order of their keys: what the bound connects within a key, as groups of two
    nodes or more, each with a name that its nodes decide."""
    for table in in_groups(batches, 20_000):
        key, node, size = (table.column(k).to_numpy() for k in range(3))
        counts = table.column(3).to_pylist()
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        root = np.arange(len(key))
        few = np.flatnonzero(np.repeat(n <= 64, n))
        if len(few):
            begin = np.cumsum(n[n <= 64]) - n[n <= 64]
            root[few] = few[bounded_roots(size[few], [counts[k] for k in few], begin)]
        for a, m in zip(start[n > 64].tolist(), n[n > 64].tolist()):
            root[a : a + m] = a + reached(m, within_bound(size[a : a + m], folded(counts[a : a + m])))
        name = np.zeros(len(key), np.uint64)
        np.add.at(name, root, mixed(node.view(np.uint64) + _MIX[0]))
        members = np.bincount(root, minlength=len(key))[root]
        own = members > 1
        yield pa.RecordBatch.from_arrays([pa.array(name[root][own].view(np.int64)), pa.array(members[own]), pa.array(node[own])], ["cell", "n", "node"])


def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, node, root, size, counts) in the order of their keys: the nodes of each key that the bound allows a
    link with one of another component."""
    for table in in_groups(batches, 5_000):
        key = table.column(0).to_numpy()
        for a, b in zip(cut := np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), np.r_[cut[1:], len(key)]):
            part = table.slice(a, b - a)
            cell, node, root, size = (part.column(k).to_numpy() for k in range(1, 5))
            counts = folded(part.column(5).to_pylist())
            names, component = np.unique(root, return_inverse=True)
            own = np.zeros(len(node), bool)
            largest = np.bincount(component).argmax()
            near = within_bound(size, counts)
            for k in np.flatnonzero(component != largest):  # every pair of components has one side here
                hit = near(k, np.arange(len(node))) & (component != component[k])
                own |= hit
                own[k] |= hit.any()
            yield pa.RecordBatch.from_arrays([pa.array(cell[own]), pa.array(node[own])], ["cell", "node"])


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, text) in the order of their keys: verified links of each key."""
    for table in in_groups(batches, 200):
        key = table.column(0).to_numpy()
        for a, b in zip(cut := np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), np.r_[cut[1:], len(key)]):
            yield from _link_group(table.slice(a, b - a)).to_batches()


def _link_group(table: pa.Table) -> pa.Table:
    """Verified links: a forest that spans them."""
    node, sets = table.column("node").to_numpy(), [shingles(t or b"") for t in table.column("text").cast(pa.binary()).to_pylist()]
    sizes = np.array([len(s) for s in sets])
    begin, flat = np.cumsum(sizes) - sizes, np.concatenate([np.zeros(0, np.uint64), *sets])

    def near(k: int, rest: np.ndarray) -> np.ndarray:
        own, out = sets[k], np.zeros(len(rest), bool)
        fit = np.flatnonzero((PART * sizes[rest] <= WHOLE * len(own)) & (PART * len(own) <= WHOLE * sizes[rest]) & (sizes[rest] > 0))
        if len(fit):
            n = sizes[rest[fit]]
            ends = np.cumsum(n)
            other = flat[np.repeat(begin[rest[fit]] - (ends - n), n) + np.arange(ends[-1])]
            same = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            common = np.add.reduceat(same.astype(np.int64), ends - n)
            out[fit] = WHOLE * common >= PART * (n + len(own) - common)
        return out

    root = reached(len(node), near)
    own = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": node[own], "b": node[root[own]]})


def numbered(docs: DataFrame) -> DataFrame:
    """node, id (smallest doc_id, null if no row has one), content, size, counts, cells: one row for each distinct set."""
    own = written(signatures(docs, Grids(docs.count())), "signatures")
    one = own.groupBy("content").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("size", "counts", "cells")])
    return written(one.sort(F.col("id").asc_nulls_last(), "content").select(F.monotonically_increasing_id().alias("node"), "id", "content", "size", "counts", "cells"), "near-nodes")


def shared_cells(nodes: DataFrame) -> DataFrame:
    """cell, node: the cells that hold two nodes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in in_pieces(batches, 100_000):
            if not whole:
                yield from table.to_batches()
                continue
            cell = table.column(0).to_numpy()
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[start, len(cell)])
            yield from table.filter(pa.array(np.repeat(size > 1, size))).to_batches()

    cells = nodes.select(F.explode("cells").alias("cell"), "node")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, node long")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text for each node."""
    some = docs.select("doc_id", "text")
    named = with_content(some.join(nodes.where("id is not null").select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi"))
    named = named.join(nodes, (F.col("doc_id") == F.col("id")) & (F.col("_content") == F.col("content"))).select("node", "text")
    bare = with_content(some.where("doc_id is null").dropDuplicates(["text"])).join(nodes.where("id is null"), F.col("_content") == F.col("content")).select("node", "text")
    return written(named.unionByName(bare).dropDuplicates(["node"]), "near-texts")


def sorted_by_key(rows: DataFrame, *key: str) -> DataFrame:
    """rows with `key`, a hash of these columns, first; dealt and sorted by it, so that a task streams through whole groups."""
    own = rows.select(F.xxhash64(*key).alias("key"), *[c for c in rows.columns if c != "p" and c != "q"])
    return own.repartition("key").sortWithinPartitions("key")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a > b) between nodes; what they connect is what verified candidates connect."""
    vectors = nodes.select("node", "size", "counts")
    cells = dealt_in_pairs(written(shared_cells(nodes), "near-cells"), "cell", "node", BLOCK)
    parted = sorted_by_key(cells.join(vectors, "node").select("node", "size", "counts", "cell", "p", "q"), "cell", "p", "q").drop("cell")
    groups = written(parted.mapInArrow(part_cells, "cell long, n long, node long").dropDuplicates(["cell", "node"]), "near-groups")
    texts = texts_of(docs, groups.select("node").distinct().join(nodes.select("node", "id", "content"), "node"))

    def verified(members: DataFrame) -> DataFrame:
        dealt = dealt_in_pairs(written(members, "near-members"), "cell", "node", BLOCK).join(texts, "node").select("node", "text", "cell", "p", "q")
        return sorted_by_key(dealt, "cell", "p", "q").drop("cell").mapInArrow(link_groups, "a long, b long").distinct()

    once = groups.groupBy("node").agg(F.max(F.struct("n", "cell")).alias("m")).select("m.cell", "node")
    first = written(verified(once), "near-links")
    tied = components(first)
    rooted = groups.join(tied, F.col("node") == F.col("a"), "left").select("cell", "node", F.coalesce("b", "node").alias("root"))
    several = rooted.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("cell")
    left = dealt_in_pairs(written(rooted.join(several, "cell"), "near-left"), "cell", "node", BLOCK).join(vectors, "node").select("cell", "node", "root", "size", "counts", "p", "q")
    still = written(sorted_by_key(left, "cell", "p", "q").mapInArrow(open_cells, "cell long, node long").distinct(), "near-open")
    return first.unionByName(verified(still))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group, with its own columns; of rows with that id one stays. A group
    without any id keeps one row."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    nodes = numbered(docs)
    first = nodes.join(components(links(docs, nodes)), F.col("node") == F.col("a"), "left_anti").select("id", "content")
    named = docs.where("doc_id is not null").join(first.where("id is not null").select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"])
    bare = with_content(docs.where("doc_id is null").dropDuplicates(["text"])).join(first.where("id is null").select(F.col("content").alias("_content")), "_content", "left_semi")
    return named.unionByName(bare.dropDuplicates(["_content"]).drop("_content"))
