"""Numpy views of text columns inside Arrow tasks: bytes, words, word hashes, shingle sets.

An Arrow batch is walked in blocks of a few megabytes of text, so a task holds the arrays of one block, whatever
the batch size.  A block ends at a document border; a document above the block size is a block of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from boreline.llm.shared import per_worker

BLOCK_BYTES = 1 << 20

#: Bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_BASE, _BASE_INV = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(256, dtype=U64)) | U64(1)


def powers(n: int, sign: int = 1) -> np.ndarray:
    """base**i (or its inverse) mod 2**64 for i < n."""
    kept = per_worker("powers", dict)
    have = kept.get(sign, np.ones(1, U64))
    if len(have) < n:
        size = max(n, 2 * len(have))
        step = np.full(size, _BASE if sign > 0 else _BASE_INV, U64)
        step[0] = U64(1)
        have = kept[sign] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums with a leading zero: the bytes [a, b) have hash (out[b] - out[a]) * base**-a."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of byte spans; equal bytes give equal values at every place of every block."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), -1)[start] + (end - start).astype(U64))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at the end of a row."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each row the index of its first word (one more entry at the end)."""
    start, end, row = word_spans(data, offsets)
    h = span_hash(prefix_hash(LOWER[data] if lower else data), start, end)
    return h, np.searchsorted(row, np.arange(len(offsets)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of `width`-word shingles (lower-cased A-Z) of every row, and the rows' bounds in them.
    A row with fewer words has one shingle, its whole sequence; a row without words has none."""
    word, first = word_hashes(data, offsets)
    count = np.diff(first)
    rows = len(count)
    n = len(word)
    full = np.zeros(max(n - width + 1, 0), U64)
    for j in range(width):
        full = mix(full ^ word[j: j + len(full)])
    # a shingle may start at a word with at least width - 1 more words in its row
    owner = np.repeat(np.arange(rows), count)
    at = np.arange(n)
    ok = at[: len(full)] + width <= first[1:][owner[: len(full)]]
    h, row = full[ok], owner[: len(full)][ok]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(width - 1):
            has = count[short] > j
            extra[has] = mix(extra[has] ^ word[first[short[has]] + j])
        extra = mix(extra + count[short].astype(U64))
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    bound = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(rows + 1))
