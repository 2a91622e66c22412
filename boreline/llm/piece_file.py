"""Reads the parts of a SentencePiece model file that encoding needs: pieces, scores, kinds and the normaliser's switches.

The file is a protocol-buffer message.  Fixed values, from its public schema: field 1 lists pieces (1 text, 2 score, 3
kind), field 2 trainer settings (3 model type: 1 unigram, 2 BPE; 35 byte fallback), field 3 normaliser settings (2 rules, 3 dummy prefix, 4 removal of
extra spaces, 5 escaping of spaces)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: bytes for nested ones and texts, int for varints, float for 32-bit values."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at: at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    bpe: bool
    byte_fallback: bool
    dummy_prefix: bool


def read_model(path: str) -> PieceModel:
    """Refuses models with normaliser rules, removal of extra spaces or unescaped spaces."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer = [], {}
    norm: dict[int, object] = {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            norm = dict(fields(value))
    if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
        raise ValueError(f"{path} changes texts before encoding; only identity normalisation is supported")
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError(f"{path} is neither a unigram nor a BPE model")
    return PieceModel(pieces, trainer.get(3, 1) == 2, bool(trainer.get(35, 0)), bool(norm.get(3, 1)))
