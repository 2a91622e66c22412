"""Sampled suffixes of texts, in numpy.

Of the 32-byte strings inside a window of 100 bytes, that with the smallest hash is its anchor, wherever the window
stands.  Windows that begin next to each other mostly share an anchor: a run.  So equal windows begin at equal places
of runs with equal anchors, and the suffixes that begin at anchors, one in 35, find all matches of 100 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from boreline.llm.blocks import U64, prefix_hash, span_hash

WINDOW = 100
ANCHOR = 32
#: Window starts in a piece of a text; pieces overlap, so no window is lost.
PIECE = 1 << 19
_PLACE = U64((1 << 28) - 1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in that row, bytes, offsets) of a block; a text above PIECE bytes comes in pieces."""
    if len(data) <= PIECE + WINDOW:
        yield 0, 0, data, offsets
        return
    for i in range(len(offsets) - 1):
        own = data[offsets[i]: offsets[i + 1]]
        for at in range(0, max(len(own) - WINDOW + 1, 0), PIECE):
            part = own[at: at + PIECE + WINDOW - 1]
            yield i, at, part, np.array([0, len(part)])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor key, key of all bytes of the run, row, first window's start in its row, number of windows."""
    empty = np.zeros(0, np.int64)
    size = len(data) - WINDOW + 1
    if size <= 0:
        return empty.view(U64), empty.view(U64), empty, empty, empty
    prefix = prefix_hash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    low = span_hash(prefix, at, at + ANCHOR)
    low = (low & ~_PLACE) | at.astype(U64)  # equal hashes: the first place wins
    span = 1
    while 2 * span <= WINDOW - ANCHOR + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = WINDOW - ANCHOR + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:])
    anchor = (low & _PLACE).astype(np.int64)
    start = np.arange(size)
    row = np.searchsorted(offsets, start, side="right") - 1
    ok = start + WINDOW <= offsets[row + 1]
    first = ok.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    count = np.bincount(group[ok], minlength=len(begin)) if len(begin) else empty
    key = span_hash(prefix, anchor[begin], anchor[begin] + ANCHOR)
    whole = span_hash(prefix, begin, begin + count + WINDOW - 1)
    return key, whole, row[begin], begin - offsets[row[begin]], count
