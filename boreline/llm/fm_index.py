"""FM-index of a shard of documents, in numpy: the Burrows-Wheeler transform of its words in a wavelet matrix.

The text of a shard is a row of pieces (documents, or parts of long ones), each closed by a separator; separators differ
from each other, so no match crosses one.  Suffixes are sorted whole by prefix doubling over the groups that are still
tied.  Positions are sampled every SAMPLE words of a piece, its first word included, so a walk back to a sample never
meets a separator.  Words are 64-bit hashes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 8
MAGIC = b"FMW1"
HEAD = "<4sIIIB"


class Bits:
    """A bit vector with ranks: the packed words are what is stored, the running counts are made on loading."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:], dtype=np.int64)

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """One word more than needed, so that the rank at the end has a word to look at."""
        raw = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
        some = np.packbits(bits, bitorder="little")
        raw[: len(some)] = some
        return raw.view("<u8")

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ranks below 2**21, of which the last is found nowhere else."""
    n = len(rank)
    key = rank.astype(np.uint64) << np.uint64(42)
    key[:-1] |= rank[1:].astype(np.uint64) << np.uint64(21)
    key[:-2] |= rank[2:].astype(np.uint64)
    sa = np.argsort(key)
    key, width = key[sa], 3
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    place = np.empty(n, np.int64)
    slot = np.arange(n)
    place[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slot = slot[~alone]
        if not len(slot):
            return sa
        tied = sa[slot]
        key = (place[tied] << 32) | place[np.minimum(tied + width, n - 1)]
        order = np.argsort(key)
        sa[slot], key = tied[order], key[order]
        new = np.ones(len(slot), bool)
        new[1:] = key[1:] != key[:-1]
        place[sa[slot]] = np.maximum.accumulate(np.where(new, slot, 0))
        width *= 2


@dataclass
class FmIndex:
    """vocab: the words in order, symbols 1 and up; first: the first row of every symbol; starts: where pieces begin."""
    vocab: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    levels: list[Bits]
    marks: Bits
    samples: np.ndarray

    def _down(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The place to which the levels of the matrix bring a row that looks for a symbol."""
        for k, bits in enumerate(self.levels):
            ones, n = bits.rank(row), self.length
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            row = np.where(one, n - bits.before[-1] + ones, row - ones)
        return row

    @property
    def length(self) -> int:
        return int(self.starts[-1])

    def count(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row behind the last of every window's suffixes; windows: word hashes, aligned to the right."""
        rows, width = windows.shape
        lo, hi = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        if not len(self.vocab):
            return lo, hi
        alive = np.flatnonzero(sizes > 0)
        for step in range(width):
            word = windows[alive, width - 1 - step]
            at = np.minimum(np.searchsorted(self.vocab, word), len(self.vocab) - 1)
            known = self.vocab[at] == word
            hi[alive[~known]] = lo[alive[~known]]
            alive, symbol = alive[known], at[known] + 1
            if step:
                base = self._down(symbol, np.zeros(len(alive), np.int64))
                lo[alive] = self.first[symbol] + self._down(symbol, lo[alive]) - base
                hi[alive] = self.first[symbol] + self._down(symbol, hi[alive]) - base
            else:
                lo[alive], hi[alive] = self.first[symbol], self.first[symbol + 1]
            alive = alive[(lo[alive] < hi[alive]) & (sizes[alive] > step + 1)]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text until a sampled one."""
        out, walk = np.zeros(len(rows), np.int64), np.arange(len(rows))
        row, steps = rows.astype(np.int64), 0
        while len(walk):
            hit = self.marks.at(row)
            out[walk[hit]] = self.samples[self.marks.rank(row[hit])] + steps
            walk, row = walk[~hit], row[~hit]
            symbol = np.zeros(len(row), np.int64)
            at, base = row, np.zeros(len(row), np.int64)
            for bits in self.levels:
                one, zeros = bits.at(at), self.length - bits.before[-1]
                ones, ones0 = bits.rank(at), bits.rank(base)
                at, base = np.where(one, zeros + ones, at - ones), np.where(one, zeros + ones0, base - ones0)
                symbol = symbol * 2 + one
            row = self.first[symbol] + at - base
            steps += 1
        return out


def build(words: np.ndarray, sizes: np.ndarray) -> FmIndex:
    """Index of pieces with `sizes` word hashes each, laid one after the other in `words`."""
    pieces, n = len(sizes), len(words) + len(sizes)
    starts = np.zeros(pieces + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    close = starts[1:] - 1
    vocab, symbol = np.unique(words, return_inverse=True)
    if pieces + len(vocab) >= 1 << 21:
        raise ValueError("the shard is too large")
    own = np.ones(n, bool)
    own[close] = False
    text = np.zeros(n, np.int64)
    text[own] = symbol + 1
    rank = np.empty(n, np.int64)
    rank[close] = np.arange(pieces)
    rank[own] = symbol + pieces
    sa = suffix_array(rank) if n >= 3 else np.argsort(rank)
    first = np.r_[0, pieces, pieces + np.cumsum(np.bincount(symbol, minlength=len(vocab)))].astype(np.int64)
    seq = text[sa - 1]
    levels = []
    for k in reversed(range(int(len(vocab)).bit_length())):
        bit = (seq >> k) & 1 == 1
        levels.append(Bits(Bits.pack(bit)))
        seq = np.concatenate([seq[~bit], seq[bit]])
    inside = np.arange(n) - np.repeat(starts[:-1], sizes + 1)
    sampled = own & (inside % SAMPLE == 0)
    mark = sampled[sa]
    return FmIndex(vocab, first, starts, levels, Bits(Bits.pack(mark)), sa[mark])


def to_bytes(f: FmIndex) -> bytes:
    """Header (magic, pieces, words of the vocabulary, samples, levels), then the arrays in order."""
    head = struct.pack(HEAD, MAGIC, len(f.starts) - 1, len(f.vocab), len(f.samples), len(f.levels))
    return head + b"".join([f.starts.astype("<u4").tobytes(), f.vocab.astype("<u8").tobytes(), f.first.astype("<u4").tobytes(),
                            f.samples.astype("<u4").tobytes(), f.marks.packed.tobytes(), *[b.packed.tobytes() for b in f.levels]])


def from_bytes(data: bytes) -> FmIndex:
    magic, pieces, vocab, samples, levels = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not an index")
    at = struct.calcsize(HEAD)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    starts = take("<u4", pieces + 1).astype(np.int64)
    words, first, places = take("<u8", vocab), take("<u4", vocab + 2).astype(np.int64), take("<u4", samples).astype(np.int64)
    size = int(starts[-1]) // 64 + 1
    bits = [Bits(take("<u8", size)) for _ in range(levels + 1)]
    return FmIndex(words, first, starts, bits[1:], bits[0], places)
