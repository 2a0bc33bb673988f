"""Anchors of byte strings: every window of ``WINDOW`` bytes has one, chosen by its content alone.

A window's anchor is the leftmost of its ``GRAM``-byte strings with the smallest hash. Consecutive windows mostly share
an anchor; such a stretch (at most ``WINDOW - GRAM + 1`` windows) is a fragment. Equal windows have equal anchors at
equal offsets, so all occurrences of a window lie in fragments whose anchors have one hash.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 100, 40
#: Windows that one fragment can have: they fit the bits of a long.
MOST = WINDOW - GRAM + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A value for each byte, and the base, of two polynomial digests.
_TABLES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95))
_STRETCH = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position (those at the end, that would run over it, are of zeros)."""
    padded = np.zeros(len(buf) + GRAM + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.lib.stride_tricks.as_strided(padded, (len(buf) + GRAM, 8), (1, 1)).copy().view("<u8").ravel()
    h = words[: len(buf)] * _A
    for at in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h *= _B
        h += words[at : at + len(buf)] * _A
    return mixed(h)


def gram_hashes_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """gram_hashes(buf)[at], for positions with GRAM bytes after them."""
    word = lambda k: np.lib.stride_tricks.as_strided(buf, (max(0, len(buf) - 7), 8), (1, 1))[at + k].copy().view("<u8").ravel()
    h = word(0) * _A
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h *= _B
        h += word(k) * _A
    return mixed(h)


def fragments(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of whole documents laid end to end: each fragment's document, first byte, windows, anchor and the anchor's hash."""
    out: list[tuple] = []
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):  # stretches of whole documents that fit the processor's cache
        start = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, start + _STRETCH)))
        out.append(_fragments(buf[start : ends[last - 1]], lengths[first:last], first, start))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))


def _fragments(buf, lengths, first, start):
    n = len(buf)
    h = gram_hashes(buf)
    low = np.uint64(0xFFFFFFFF)  # the same bits for every stretch: equal windows then tie alike, and the leftmost wins in each
    best = (h & ~low) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= MOST:
        best[: max(0, n - size)] = np.minimum(best[: max(0, n - size)], best[size:])
        size *= 2
    rest = MOST - size
    best[: max(0, n - rest)] = np.minimum(best[: max(0, n - rest)], best[rest:])
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - (WINDOW - 1), 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(len(doc)) + np.repeat(ends - lengths - (np.cumsum(counts) - counts), counts)
    anchor = (best[at] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])][: len(at)])
    return doc[new] + first, at[new] + start, np.diff(np.r_[new, len(at)]), anchor[new] + start, h[anchor[new]]


def digests(buf: np.ndarray, start: np.ndarray, length: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit digest of buf[start : start + length] for each pair, the same wherever the bytes stand; starts ascend.
    `which` chooses one of two functions."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # stretches that fit the processor's cache
        low = start[at]
        last = int(np.searchsorted(start, low + _STRETCH))
        own, n = start[at:last] - low, length[at:last]
        out[at:last] = _digests(buf[low : low + int((own + n).max())], own, n, which)
        at = last
    return out


def _digests(buf: np.ndarray, start: np.ndarray, length: np.ndarray, which: int) -> np.ndarray:
    power = np.cumprod(np.full(len(buf) + 1, _BASES[which]), dtype=np.uint64)
    back = np.cumprod(np.full(len(buf) + 1, pow(int(_BASES[which]), -1, 1 << 64), np.uint64), dtype=np.uint64)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLES[which][buf] * power[: len(buf)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[start + length] - sums[start]) * back[start] + length.astype(np.uint64))
