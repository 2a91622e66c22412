"""HyperMinHash sketches in numpy: registers, densification, band keys, similarity estimates.

A shingle hash gives its bucket by its top bits.  Of the smallest remaining value in a bucket the register keeps the count
of leading zeros (ZERO_BITS, saturating) and the MANTISSA bits that follow the leading one: a byte in all.  A bucket
without a shingle borrows the register of the first filled bucket on its own probe sequence, the same for every
document, so every register of two documents agrees with a chance near their Jaccard similarity, for short ones too."""

from __future__ import annotations

import numpy as np

from boreline.llm.blocks import U64, mix

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
ZERO_BITS, MANTISSA = 4, 4
REST_BITS = 64 - BUCKET_BITS
#: Registers in a band.  Two documents of similarity 0.75 share a band with a chance of 1 - 1e-6 or more, two of
#: similarity 0.25 with 0.07.
BAND_ROWS = 5
BANDS = BUCKETS // BAND_ROWS


def sketches(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Registers (rows x BUCKETS, uint8) of rows' sorted distinct hashes h[bound[i]:bound[i + 1]]; zeros for rows without."""
    rows = len(bound) - 1
    row = np.repeat(np.arange(rows), np.diff(bound))
    cell = row * BUCKETS + (h >> U64(REST_BITS)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    cell, rest = cell[first], h[first] & U64((1 << REST_BITS) - 1)
    # the exponent of a double is the place of the leading one, its fraction what follows; adding one keeps zero apart
    bits = (rest + U64(1)).astype(np.float64).view(U64)
    zeros = (REST_BITS + 1023 - (bits >> U64(52)).astype(np.int64)).clip(0, (1 << ZERO_BITS) - 1)
    part = (bits >> U64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    out = np.zeros(rows * BUCKETS, np.uint8)
    out[cell] = (zeros << MANTISSA) | part
    filled = np.zeros(rows * BUCKETS, bool)
    filled[cell] = True
    some = np.diff(bound) > 0
    missing = np.flatnonzero(~filled & np.repeat(some, BUCKETS))
    probe = 0
    while len(missing):
        probe += 1
        column = missing % BUCKETS
        at = missing - column + (mix((column + BUCKETS * probe).astype(U64)) >> U64(REST_BITS)).astype(np.int64)
        hit = filled[at]
        out[missing[hit]] = out[at[hit]]
        missing = missing[~hit]
    return out.reshape(rows, BUCKETS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit keys (rows x BANDS); the band number is part of the key."""
    rows = regs[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS).astype(U64)
    packed = rows[:, :, 0]
    for j in range(1, BAND_ROWS):
        packed = (packed << U64(8)) | rows[:, :, j]
    return mix(mix(packed) + np.arange(BANDS, dtype=U64)[None, :])


#: Chance that the registers of two different minima agree: leading zeros (1/3) and mantissa.
COLLISION = 1.0 / (3 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of row pairs, corrected for registers that agree by chance."""
    same = (a == b).mean(axis=-1)
    return ((same - COLLISION) / (1 - COLLISION)).clip(0, 1)
