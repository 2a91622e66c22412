"""Re-Pair grammars of token ids, in numpy: frequent pairs of ids become nonterminals, round by round.

A block holds the ids of consecutive documents.  In a round every symbol is left or right by a bit of a hash of its id, so
pairs of a left and a right symbol never overlap and all frequent ones are replaced at once; runs of one symbol are
halved in every RUNS-th round.  Rounds go on until no pair is left that is found LEAST times.  No pair crosses a document's end, so each document is a slice of the final sequence and can be
decoded alone; the stored expansion lengths give the place of any token without decoding what is before it."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MAGIC = b"RPG1"
#: Every so many rounds, the first included, runs of one symbol are halved instead.
RUNS = 4
#: A pair that is found less often does not pay for its rule.
LEAST = 16
#: Pairs are first counted in this many cells by a hash, at most; only those in cells with LEAST are counted exactly.
CELLS = 1 << 20
HEAD = "<4sBIIIIQ"


@dataclass
class Grammar:
    """first[r] is the first nonterminal of round r; rule i is nonterminal base + i; spans has one more entry than documents."""
    base: int
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    keys: np.ndarray
    spans: np.ndarray
    tokens: np.ndarray


def _side(symbols: np.ndarray, turn: int) -> np.ndarray:
    h = (symbols.astype(np.uint32) + np.uint32(turn * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(31)).astype(bool)


def _run_pairs(at: np.ndarray, a: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether each pair of one symbol (at ascending places) is every other one of its run."""
    begin = np.ones(len(at), bool)
    begin[1:] = (after[at[:-1]] != at[1:]) | (a[1:] != a[:-1])
    place = np.arange(len(at))
    return (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << np.int64(32)) | b


def _perhaps_often(key: np.ndarray) -> np.ndarray:
    """False only where a key is found less than LEAST times."""
    cells = min(CELLS, 1 << (4 * len(key)).bit_length())
    cell = ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & np.int64(cells - 1)
    return np.bincount(cell, minlength=cells)[cell] >= LEAST


def build(ids: np.ndarray, keys: np.ndarray, tokens: np.ndarray) -> Grammar:
    """Grammar of documents with `tokens` ids each, laid one after the other in ids.

    Symbols keep their places and are linked by `after` and `before`.  A pair that is found too seldom stays so, as new pairs
    hold a symbol of the round before: a round looks only at `at`, the places of all pairs that may still be frequent."""
    n = len(ids)
    base = int(ids.max()) + 1 if n else 0
    seq = np.append(ids, 0).astype(np.int32)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    last = np.zeros(n + 1, bool)
    last[np.cumsum(tokens)[tokens > 0] - 1] = True
    alive = np.ones(n + 1, bool)
    alive[n] = False
    left, right, lengths, first, nxt = [], [], [np.ones(0, np.int64)], [], base

    def size_of(symbols: np.ndarray) -> np.ndarray:
        table = np.concatenate(lengths)
        return np.where(symbols < base, 1, table[np.maximum(symbols - base, 0)] if len(table) else 1)

    at = np.flatnonzero(~last[:n])
    at = at[_perhaps_often(_key(seq[at], seq[at + 1]))]
    open_ = np.zeros(n + 1, bool)
    open_[at] = True
    turn = 0
    while len(at):
        if turn % RUNS == 0:  # runs of one symbol: every other pair of a run
            some = np.sort(at[seq[at] == seq[after[at]]])
            some = some[_run_pairs(some, seq[some], after)]
        else:
            some = at[~_side(seq[at], turn)]
            some = some[_side(seq[after[some]], turn)]
        open_[some] = False
        fresh = some[:0]
        pairs = pa.array(_key(seq[some], seq[after[some]])).dictionary_encode()
        inverse, found = pairs.indices.to_numpy(), pairs.dictionary.to_numpy()
        good = np.flatnonzero(np.bincount(inverse, minlength=len(found)) >= LEAST)
        if len(good):
            good = good[np.argsort(found[good])]
            rule = np.full(len(found), -1, np.int32)
            rule[good] = nxt + np.arange(len(good), dtype=np.int32)
            new = rule[inverse]
            some, new = some[new >= 0], new[new >= 0]
            l, r = found[good] >> np.int64(32), found[good] & np.int64(0xFFFFFFFF)
            first.append(nxt)
            size = size_of(l) + size_of(r)
            left.append(l)
            right.append(r)
            lengths.append(size)
            nxt += len(l)
            gone = after[some]
            alive[gone] = open_[gone] = False
            seq[some], last[some] = new, last[gone]
            after[some] = after[gone]
            before[after[some]] = some
            # the pairs on both sides of a new symbol, each place once
            ahead = before[some[some > 0]]
            open_[ahead] = False
            open_[some] = True
            fresh = np.r_[some, ahead[~open_[ahead]]]
            open_[some] = False
            fresh = fresh[~last[fresh]]
            fresh = fresh[_perhaps_often(_key(seq[fresh], seq[after[fresh]]))]
        at = np.r_[at[open_[at]], fresh]
        open_[fresh] = True
        turn += 1
    seq, last = seq[alive], last[alive]
    spans = np.zeros(len(tokens) + 1, np.int64)
    spans[1:][tokens > 0] = np.flatnonzero(last) + 1
    spans = np.maximum.accumulate(spans)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Grammar(base, np.array(first, np.int64), cat(left), cat(right), np.concatenate(lengths), seq, np.asarray(keys, np.int64), spans, np.asarray(tokens, np.int64))


def expand(g: Grammar, seq: np.ndarray) -> np.ndarray:
    """The ids of a slice of the sequence: the rules of the last round first."""
    for f in g.first[::-1]:
        hit = seq >= f
        if hit.any():
            out = np.repeat(seq, hit.astype(np.int8) + np.int8(1))
            at = np.flatnonzero(hit)
            rule = seq[at] - g.base
            at += np.arange(len(at))
            out[at], out[at + 1] = g.left[rule], g.right[rule]
            seq = out
    return seq


def expand_all(g: Grammar) -> np.ndarray:
    """The ids of the whole sequence: the rules are expanded once, the first round first, and laid out as often as they are found."""
    at = np.cumsum(g.lengths) - g.lengths
    flat = np.zeros(int(g.lengths.sum()), np.int32)

    def lay(symbols: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(symbols >= g.base)
        rule = symbols[hit] - g.base
        size = np.ones(len(symbols), np.int64)
        size[hit] = n = g.lengths[rule]
        out = np.repeat(symbols, size)
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((np.cumsum(size) - size)[hit], n) + shift] = flat[np.repeat(at[rule], n) + shift]
        return out

    for f, t in zip(g.first - g.base, np.r_[g.first[1:] - g.base, len(g.left)]):
        flat[at[f]: at[t - 1] + g.lengths[t - 1]] = lay(np.stack([g.left[f:t], g.right[f:t]], 1).ravel())
    return lay(g.sequence)


def document(g: Grammar, i: int) -> np.ndarray:
    """The ids of document i, decoded alone."""
    return expand(g, g.sequence[g.spans[i]: g.spans[i + 1]])


def token(g: Grammar, i: int, n: int) -> int:
    """Token n of document i, by the expansion lengths, down the rules."""
    seq = g.sequence[g.spans[i]: g.spans[i + 1]]
    size = np.where(seq < g.base, 1, g.lengths[np.maximum(seq - g.base, 0)] if len(g.lengths) else 1)
    upto = np.cumsum(size)
    k = int(np.searchsorted(upto, n, side="right"))
    s, n = int(seq[k]), n - int(upto[k] - size[k])
    while s >= g.base:
        a = int(g.left[s - g.base])
        size_a = 1 if a < g.base else int(g.lengths[a - g.base])
        s, n = (a, n) if n < size_a else (int(g.right[s - g.base]), n - size_a)
    return s


def to_bytes(g: Grammar) -> bytes:
    """Header (magic, bytes a symbol, base, rounds, rules, documents, symbols), then the arrays in order."""
    wide = 2 if g.base + len(g.left) <= 1 << 16 else 4
    kind = "<u2" if wide == 2 else "<u4"
    head = struct.pack(HEAD, MAGIC, wide, g.base, len(g.first), len(g.left), len(g.tokens), len(g.sequence))
    return head + b"".join(x.astype(t).tobytes() for x, t in (
        (g.first, "<u4"), (g.left, kind), (g.right, kind), (g.lengths, "<u4"), (g.keys, "<i8"), (g.tokens, "<u4"), (g.spans, "<u4"), (g.sequence, kind)))


def count_tokens(data: bytes) -> int:
    """The tokens of a block, without reading its sequence."""
    _, wide, _, rounds, rules, docs, _ = struct.unpack_from(HEAD, data)
    return int(np.frombuffer(data, "<u4", docs, struct.calcsize(HEAD) + 4 * rounds + (2 * wide + 4) * rules + 8 * docs).sum(dtype=np.int64))


def from_bytes(data: bytes) -> Grammar:
    magic, wide, base, rounds, rules, docs, symbols = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at, kind = struct.calcsize(HEAD), "<u2" if wide == 2 else "<u4"
    out: list[np.ndarray] = []
    for n, t in ((rounds, "<u4"), (rules, kind), (rules, kind), (rules, "<u4"), (docs, "<i8"), (docs, "<u4"), (docs + 1, "<u4"), (symbols, kind)):
        out.append(np.frombuffer(data, t, n, at).astype(np.int32 if t == kind else np.int64))
        at += n * np.dtype(t).itemsize
    first, left, right, lengths, keys, tokens, spans, sequence = out
    return Grammar(base, first, left, right, lengths, sequence, keys, spans, tokens)
