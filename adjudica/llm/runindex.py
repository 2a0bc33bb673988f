"""A run-length index of a collection of byte strings.

The strings are laid end to end, each closed by a separator of its own below all bytes. Of the suffix array only the
Burrows-Wheeler transform is kept, as runs, with the text positions at both ends of each run sampled, and for each run
the number of bytes that its first suffix shares with the last one of the run before.

These samples give the matching statistics of every position. The suffix before that of a run's head, in the order of
suffixes, is the tail of the run before; and where a position's suffix doesn't begin a run, the suffix before it is one
further than that of the position to the left, and shares one byte less. So one stream over the text, which takes up the
sample at each run's head and counts on from it, knows for each position which other one matches it best among the smaller
suffixes, and how far. Positions that share ``depth`` bytes are chains of such matches; the earliest of a chain is the first
occurrence, and all others are repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RunIndex:
    run_char: np.ndarray  # the runs' characters, -1 for a separator
    head: np.ndarray  # text position at the run's first row
    tail: np.ndarray  # and at its last
    shared: np.ndarray  # bytes that the suffix at the head shares with the tail of the run before
    size: int  # length of the text, separators included


def _suffixes(text: np.ndarray, left: np.ndarray, string: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from 7 bytes.

    left: bytes before the separator of the position's string (0 at the separator); string: its number.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    short = np.minimum(left, 7).astype(np.uint64)
    drop = (np.uint64(8) - short) * np.uint64(8)  # what lies after the separator counts as zero
    key = np.where(short == 0, np.uint64(0), (key >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63))) | short
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, np.diff(np.r_[head, n]))
    size, longest = 7, int(left.max(initial=0))
    active = np.flatnonzero(np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n])))
    while len(active):
        here = sa[active]
        # a suffix that ended within `size` bytes ties only with others of its length: their strings' order decides
        second = np.where(left[here] < size, string[here], rank[np.minimum(here + size, n - 1)])
        group = rank[here]
        order = np.lexsort((second, group)) if n >= 1 << 31 else np.argsort(group * (1 << 31) + second)
        here, group, second = here[order], group[order], second[order]
        sa[active] = here
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(here)])
        rank[here] = np.repeat(active[starts], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        size *= 2
        if size > 2 * longest + 14:
            break
    return sa


def _shared(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the strings at a and at b have in common, up to the end of the shorter one."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    words = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    most, out = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
    todo = np.flatnonzero(most > 0)
    while len(todo):
        at = out[todo]
        unlike = words[a[todo] + at] != words[b[todo] + at]
        stop = unlike.any(1)
        out[todo] = np.minimum(at + np.where(stop, unlike.argmax(1), 8), most[todo])
        todo = todo[~stop & (out[todo] < most[todo])]
    return out


def build(text: np.ndarray, lengths: np.ndarray) -> RunIndex:
    """text: the strings, each followed by one byte (of any value) in the separator's place."""
    n, ends = len(text), np.cumsum(lengths + 1) - 1
    string = np.repeat(np.arange(len(lengths)), lengths + 1)
    left = ends[string] - np.arange(n)
    sa = _suffixes(text, left, string)
    symbols = text.astype(np.int16)
    symbols[ends] = -1
    bwt = symbols[sa - 1]  # position 0 wraps to the last separator
    start = np.flatnonzero(np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)][:n])  # no two separators are alike
    head, tail = sa[start], sa[np.r_[start[1:], n][: len(start)] - 1]
    shared = np.zeros(len(start), np.int64)
    shared[1:] = _shared(text, left, head[1:], tail[:-1])
    return RunIndex(bwt[start], head, tail, shared, n)


def statistics(index: RunIndex) -> tuple[np.ndarray, np.ndarray]:
    """For each text position the best match among the smaller suffixes, and its length."""
    run = np.zeros(index.size, np.int64)
    run[index.head] = np.arange(len(index.head))
    at = np.zeros(index.size, np.int64)
    at[index.head] = index.head
    at = np.maximum.accumulate(at)  # the last head at or before each position
    run = run[at]
    on = np.arange(index.size) - at
    return np.r_[0, index.tail[:-1]][run] + on, np.maximum(index.shared[run] - on, 0)


def matches(index: RunIndex, lengths: np.ndarray, depth: int) -> np.ndarray:
    """For each string, a long whose bit p is set if the `depth` bytes from p start earlier in the collection too."""
    bits = np.zeros(len(lengths), np.uint64)
    if not index.size:
        return bits
    other, length = statistics(index)
    linked = np.flatnonzero(length >= depth)
    root = np.arange(index.size)
    root[linked] = other[linked]
    while len(linked):  # to the chain's end, the jumps doubling
        further = root[root[linked]]
        moved = further != root[linked]
        root[linked] = further
        linked = linked[moved]
    linked = np.flatnonzero(length >= depth)
    first = np.arange(index.size)
    np.minimum.at(first, root[linked], linked)
    repeats = np.union1d(linked, root[linked])
    repeats = repeats[first[root[repeats]] < repeats]
    begin = np.cumsum(lengths + 1) - lengths - 1
    string = np.searchsorted(begin, repeats, side="right") - 1
    np.bitwise_or.at(bits, string, np.uint64(1) << (repeats - begin[string]).astype(np.uint64))
    return bits
