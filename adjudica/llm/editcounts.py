"""Token counts that follow edits.

A document is cut into pre-tokens; a segment tree over runs of them holds the sums of characters and of token ids. An
edit replaces a stretch of characters: the tree finds the pre-tokens it touches, these and one more on the left (whose
cut may look two characters ahead) are cut anew, and cutting goes on to the right until a cut falls on an old one.
Only those pre-tokens are encoded, only the sums above them change. A run that grows beyond ``SPLIT`` pre-tokens is split,
with the sums that are known.

``built`` makes each document's tree once; it travels and is stored as a column (the pre-tokens' lengths and counts).
``edited`` takes text, tree and edits, and gives the new text and tree, so that a later batch of edits starts from there
and encodes nothing but what it touches. ``counted`` does both.

Edits stand in one array a document, are made one after another, and are given in characters of the text as the edits
before have left it; places and lengths beyond the text are clipped.

Defined cases: a null or empty text is the empty text, and can be edited; null edits are none, a null in an edit counts
as 0 or as the empty string; a null doc_id stays null; repeated rows are counted separately; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .tokens import MARK, PATTERN, encoder

EDIT = "struct<start: long, removed: long, inserted: string>"
EDITED = "doc_id long, text string, tree binary, tokens_before long, tokens_after long, pretokens long, recounted long"
#: Pre-tokens of a leaf when the tree is laid, and at most; characters that are cut anew at a time; distinct pre-tokens remembered.
LEAF, SPLIT, AHEAD, REMEMBERED = 64, 256, 256, 400_000


class CountTree:
    """Pre-tokens of one text with sums of characters and token ids."""

    def __init__(self, text: str, cut: Callable[[str], list[str]], count: Callable[[str], int], stored: bytes | None = None) -> None:
        self.cut, self.count = cut, count
        if stored is None:
            pieces = cut(text)
            tokens = [count(p) for p in pieces]
        else:
            lengths, tokens = (x.tolist() for x in unpack(stored))
            pieces, at = [], 0
            for n in lengths:
                pieces.append(text[at : at + n])
                at += n
        self._lay(pieces, tokens)
        self.recounted = 0

    def _lay(self, pieces: list[str], tokens: list[int]) -> None:
        self.leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.counts = [tokens[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (leaf, own) in enumerate(zip(self.leaves, self.counts)):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(map(len, leaf)), sum(own)
        for k in range(self.width - 1, 0, -1):
            self._add(k)
        self.pretokens = len(pieces)

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def stored(self) -> bytes:
        """Lengths and counts of the pre-tokens, in the smallest types that hold them."""
        lengths, tokens = [len(p) for leaf in self.leaves for p in leaf], [n for own in self.counts for n in own]
        kind = np.uint8 if max(lengths, default=0) < 256 else np.uint32
        return pack(np.array(lengths, kind), np.array(tokens, kind))

    def _add(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf and pre-token that hold character `at`, and where the pre-token begins; the place behind the last at the end."""
        if at >= self.chars[1]:
            k = len(self.leaves) - 1
            return k, len(self.leaves[k]), self.chars[1]
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        leaf = node - self.width
        for k, piece in enumerate(self.leaves[leaf]):
            if at < begin + len(piece):
                return leaf, k, begin
            begin += len(piece)
        raise AssertionError("sums do not fit the leaves")

    def read(self, leaf: int, piece: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            own = self.leaves[leaf]
            while piece < len(own):
                yield leaf, piece, own[piece]
                piece += 1
            leaf, piece = leaf + 1, 0

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = min(max(start, 0), self.chars[1])
        stop = min(start + max(removed, 0), self.chars[1])
        # a cut looks at most two characters beyond a pre-token: go back to the first that ends after start - 2
        leaf, piece, begin = self.find(max(0, start - 2))
        if begin and begin + 2 > start - 2:
            leaf, piece, begin = self.find(begin - 1)
        rest = self.read(leaf, piece)
        old, end, last = "", begin, (leaf, piece)  # text of the old pre-tokens so far, where it ends, the place behind
        while end < stop:
            a, b, own = next(rest)
            old, end, last = old + own, end + len(own), (a, b + 1)
        new, ends = old[: start - begin] + inserted + old[stop - begin :], {end}
        shift = len(inserted) - (stop - start)
        while True:
            ahead = 0
            for a, b, own in rest:
                new, end, last = new + own, end + len(own), (a, b + 1)
                ends.add(end)
                ahead += len(own)
                if ahead >= AHEAD:
                    break
            at, pieces, met = begin, [], None
            safe = end + shift - 2 if ahead >= AHEAD else end + shift  # cuts nearer to the end of what was read could still move
            for own in self.cut(new):
                if at + len(own) > safe:
                    break
                pieces.append(own)
                at += len(own)
                if at - shift >= stop and at - shift in ends and at >= start + len(inserted):
                    met = at - shift
                    break
            if met is not None or ahead < AHEAD:
                break
        if met is None:
            met = end
        self.recounted += len(pieces)
        self._replace(leaf, piece, begin, met, pieces)

    def _replace(self, leaf: int, piece: int, begin: int, stop: int, pieces: list[str]) -> None:
        """Puts `pieces` in the place of the pre-tokens from `begin` to `stop`."""
        left, k, fresh = stop - begin, leaf, [self.count(p) for p in pieces]
        while left > 0 or k == leaf:
            own, counts, at = self.leaves[k], self.counts[k], piece if k == leaf else 0
            until = at
            while until < len(own) and left > 0:
                left -= len(own[until])
                until += 1
            new, numbers = (pieces, fresh) if k == leaf else ([], [])
            gone, lost = own[at:until], counts[at:until]
            own[at:until], counts[at:until] = new, numbers
            self.pretokens += len(new) - len(gone)
            node = self.width + k
            self.chars[node] += sum(map(len, new)) - sum(map(len, gone))
            self.tokens[node] += sum(numbers) - sum(lost)
            while node > 1:
                node //= 2
                self._add(node)
            k += 1
        if len(self.leaves[leaf]) > SPLIT:
            self._lay([p for own in self.leaves for p in own], [n for own in self.counts for n in own])


def cutter() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(f"{regex.escape(MARK)}|{PATTERN}").findall


def counter(path: str | None) -> Callable[[str], int]:
    """Token ids of a pre-token; frequent ones are remembered."""
    encode, sizes = encoder(path), {}

    def count(piece: str) -> int:
        n = sizes.get(piece)
        if n is None:
            if len(sizes) >= REMEMBERED:
                sizes.clear()
            n = sizes[piece] = len(encode(piece))
        return n

    return count


def built(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of `keep`, tree, tokens: each document's tree, made once."""
    own = docs.select(F.col("`doc_id`").cast("long"), F.col("`text`").cast("string"), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(path), cutter()
        for batch in batches:
            trees, tokens = [], []
            for text in batch.column(1).to_pylist():
                tree = CountTree(text or "", cut, count)
                trees.append(tree.stored())
                tokens.append(tree.total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.binary()), pa.array(tokens, pa.int64())], [*batch.schema.names, "tree", "tokens"])

    return own.mapInArrow(run, own.withColumns({"tree": F.lit(b""), "tokens": F.lit(0).cast("long")}).schema)


def edited(trees: DataFrame, path: str | None = None) -> DataFrame:
    """trees: doc_id, text, tree (as `built` or this function gives them), edits (array of start, removed, inserted). The
    text and tree after the edits, counts before and after, pre-tokens after, and how many the edits had encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(path), cutter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for doc_id, text, stored, edits in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    tree = CountTree(text or "", cut, count, stored)
                    before = tree.total
                    for e in edits or []:
                        if e:
                            tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                    rows.append((doc_id, tree.text, tree.stored(), before, tree.total, tree.pretokens, tree.recounted))
                kinds = [pa.int64(), pa.string(), pa.binary()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in EDITED.split(", ")])

    own = trees.select(F.col("`doc_id`").cast("long"), F.col("`text`").cast("string"), F.col("`tree`"), F.col("`edits`").cast(f"array<{EDIT}>"))
    return own.mapInArrow(run, EDITED)


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs: doc_id, text, edits. Counts before and after, pre-tokens after, and how many pre-tokens the edits had encoded.
    Trees are made where the documents are read, and edited in the same stage."""
    own = docs.select("`doc_id`", "`text`", F.col("`edits`").cast(f"array<{EDIT}>").alias("edits"))
    return edited(built(own, path, ("edits",)), path).drop("text", "tree")


def with_edits(docs: DataFrame) -> DataFrame:
    """Three edits for every document, made from its own text: a replacement at three tenths, an insertion at eight
    tenths, and the last characters removed."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    piece = F.coalesce(F.substring(F.col("text"), 1, 12), F.lit(""))
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return docs.select("doc_id", "text", F.array(edit(F.floor(n * 3 / 10), 7, F.reverse(piece)), edit(F.floor(n * 8 / 10), 0, F.concat(F.lit("\n\n 1234's"), piece)), edit(F.greatest(n - 3, F.lit(0)), 1 << 40, F.lit(""))).alias("edits"))
