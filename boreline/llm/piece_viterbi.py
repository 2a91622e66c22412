"""SentencePiece encoding by one pass of an Aho-Corasick automaton over the pieces, and decoding.

At every end position the automaton's output links give all pieces that end there, the longest first.  For a unigram
file each relaxes the best score from its start, as the library's Viterbi does: the earlier start wins a tie,
user-defined pieces have a bonus, unknown characters a penalty.

The scores of a BPE file are priorities of merges, so their best sum is not what the library gives.  There the relaxed
state is the last piece of the prefix, which is unique: a piece ends the encoding of a prefix if merging it with the
last piece at its start leaves the two as they are, and every prefix has one such piece.  Verdicts on pairs are kept.

Where no piece has a space mark after another character, texts are split before the marks and every different word is
segmented once.  Unknown characters become bytes where the file has byte fallback."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.llm.chunks import default_path
from boreline.llm.piece_file import BYTE, NORMAL, USER, read_model
from boreline.llm.shared import per_worker

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters of cached words after which a worker forgets them and starts anew.
CACHE_CHARS = 10_000_000
#: Kept verdicts on pairs of pieces, likewise.
CACHE_PAIRS = 250_000
ROWS = 256


class PieceCoder:
    def __init__(self, path: str):
        import ahocorasick
        model = read_model(path)
        self.byte_fallback, self.dummy_prefix = model.byte_fallback, model.dummy_prefix
        normal = [s for _, s, kind in model.pieces if kind == NORMAL]
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        self.unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == 2)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.scores = [s for _, s, _ in model.pieces]
        self.bpe = model.bpe
        if self.bpe and any(kind == USER for _, _, kind in model.pieces):
            raise ValueError(f"{path} is a BPE model with user-defined pieces")
        self.automaton = ahocorasick.Automaton()
        self.splits = True
        for piece, i in self.ids.items():
            score = self.scores[i]
            if model.pieces[i][2] == USER:
                score = len(piece.encode()) * max(normal) - 0.1
            if not self.bpe or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), score, i))
                self.splits = self.splits and MARK not in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.names = {i: p for p, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: What every id stands for; None for bytes, which join their neighbours.
        self.texts = [p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if kind == BYTE
                      else " ⁇ ".encode() if kind == 2 else b"" for p, _, kind in model.pieces]
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def merged(self, s: str) -> list[str]:
        """Plain merging: of all neighbours that form a piece, those with the best score first, then the leftmost."""
        parts = list(s)
        while True:
            found = [(-self.scores[i], at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None]
            if not found:
                return parts
            at = min(found)[1]
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces as they are."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        self.pairs[a, b] = ok = self.merged(x + y) == [x, y]
        return ok

    def segment_merged(self, s: str) -> list[int]:
        """Ids as by merging: one pass that finds the last piece of every prefix; unknown characters have the unknown id."""
        n, unknown, pairs = len(s), self.unknown, self.pairs
        last, size, done = [unknown] * (n + 1), [1] * (n + 1), 0
        for end, (length, _, i) in self.automaton.iter(s):
            end += 1
            if done == end:
                continue
            start = end - length
            a = last[start]
            if start == 0 or a == unknown or (pairs[a, i] if (a, i) in pairs else self._follows(a, i)):
                last[end], size[end], done = i, length, end
        out: list[int] = []
        at = n
        while at > 0:
            i = last[at]
            if i != unknown:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[x] for x in reversed(s[at - 1: at].encode()))
            else:
                out.append(i)
            at -= size[at]
        return out[::-1]

    def segment(self, s: str) -> tuple[list[int], float]:
        """Ids and score of the best path over s, in which spaces are marks; unknown characters have the unknown id."""
        n = len(s)
        best, start, piece, single = [0.0] * (n + 1), [-1] * (n + 1), [self.unknown] * (n + 1), bytearray(n + 1)
        done, unknown = 0, self.unknown_score
        for end, (length, score, i) in self.automaton.iter(s):
            while done < end:  # positions before this end have all their pieces now
                done += 1
                if not single[done] and (start[done] < 0 or best[done - 1] + unknown > best[done]):
                    best[done], start[done], piece[done] = best[done - 1] + unknown, done - 1, self.unknown
            end += 1
            if length == 1:
                single[end] = 1
            score += best[end - length]
            if start[end] < 0 or score > best[end]:
                best[end], start[end], piece[end] = score, end - length, i
        while done < n:
            done += 1
            if not single[done] and (start[done] < 0 or best[done - 1] + unknown > best[done]):
                best[done], start[done], piece[done] = best[done - 1] + unknown, done - 1, self.unknown
        path, at = [], n
        while at > 0:
            path.append((piece[at], start[at], at))
            at = start[at]
        out: list[int] = []
        for i, a, b in reversed(path):
            if i != self.unknown:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[x] for x in s[a:b].encode())
            else:
                out.append(i)
        return out, best[n]

    def _segmented(self, s: str) -> bytes:
        return np.array(self.segment_merged(s) if self.bpe else self.segment(s)[0], "<i4").tobytes()

    def _ids(self, word: str) -> bytes:
        got = self._segmented(word)
        self.known[word] = got
        self.chars += len(word) + 8
        return got

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; null and empty texts have none."""
        if not text:
            return b""
        if self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        s = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        known = self.known
        if self.splits:
            words = _WORD.findall(s) if MARK + MARK in s or not self.dummy_prefix else [MARK + w for w in s[1:].split(MARK)]
            ids = b"".join([known[w] if w in known else self._ids(w) for w in words])
        else:
            ids = self._segmented(s)
        if not self.byte_fallback:  # neighbouring unknown characters are one unknown piece
            a = np.frombuffer(ids, "<i4")
            ids = a[np.r_[True, (a[1:] != self.unknown) | (a[:-1] != self.unknown)]].tobytes()
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space in front that encoding adds goes."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def coder(path: str) -> PieceCoder:
    """The worker's coder for a file."""
    return per_worker(("pieces", path), lambda: PieceCoder(path))


def encode_texts(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, ids array<int>, n_pieces, round_trip for every row: the ids of its whole text and whether decoding gives it
    back (a space mark in the text itself comes back as a space).

    Null and empty texts: no ids, round_trip true.  Repeated rows and null keys: one row each.  Texts of any length are
    encoded whole.  Other columns are ignored."""
    path = model or default_path("piece_bpe_32k.model")
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                ids = [own.encode(t) for t in texts]
                back = [own.decode(np.frombuffer(i, "<i4")) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts)]
                size = np.array([len(i) // 4 for i in ids], np.int32)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("key"), arrays, pa.array(size.astype(np.int64)), pa.array(back)],
                                                 ["key", "ids", "n_pieces", "round_trip"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")) \
        .mapInArrow(encode, f"key {kind}, ids array<int>, n_pieces long, round_trip boolean").withColumnRenamed("key", key)


def decode_ids(coded: DataFrame, model: str | None = None, key: str = "doc_id") -> DataFrame:
    """`key`, text from `key`, ids; null ids give an empty text."""
    path = model or default_path("piece_bpe_32k.model")
    kind = coded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [own.decode(np.array(i or [], "<i4")) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return coded.select(F.col(key).alias("key"), "ids").mapInArrow(decode, f"key {kind}, text string").withColumnRenamed("key", key)
