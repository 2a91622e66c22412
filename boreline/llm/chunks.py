"""Token ids of whole texts from a byte-level BPE file, through the tokenizers library.

The pre-tokenizer never joins what stands on both sides of a single space between two characters that are not white
space: its patterns take a space only at their front.  So a text can be cut before every such space, the library can
encode each different chunk once, and the ids of the text are the ids of its chunks in order.  A special token's
string has no space in it and stays within its chunk.  `check_cuts` refuses files for which this does not hold."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from boreline.llm.shared import per_worker

_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s")
#: White space at an end or side by side, for Arrow, whose \s is ASCII only: the characters that \s is in Python.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_APART = rf"\A{_SPACE}|{_SPACE}{{2}}|{_SPACE}\z"
#: Characters of cached chunks after which a worker forgets them and starts anew.
CACHE_CHARS = 16_000_000
#: Chunks that go to the library at a time.
TOGETHER = 4096


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def check_cuts(path: str) -> None:
    """Only byte-level BPE without normaliser, prefix space or post-processor may be cut at spaces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
            or not pre.get("use_regex", True) or any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is no plain byte-level BPE file")


def cut(text: str) -> list[str]:
    """Chunks; all but the first lack the single space in front of them."""
    if _WIDE.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _CUT.split(text)
    return text.split(" ")


def cut_all(texts: pa.Array) -> pa.ListArray:
    """The chunks of every text without a null; an empty one has none."""
    apart = pc.or_(pc.match_substring_regex(texts, _APART), pc.equal(pc.binary_length(texts), 0))
    lists = pc.split_pattern(texts.filter(pc.invert(apart)), " ")
    if not apart.true_count:
        return lists
    rest = pa.array([cut(t) if t else [] for t in texts.filter(apart).to_pylist()], lists.type)
    return pa.concat_arrays([lists, rest]).take(pa.array(np.argsort(np.argsort(apart.to_numpy(zero_copy_only=False), kind="stable"))))


class ChunkEncoder:
    """Counts per distinct chunk, kept by a Python worker within a bound of characters; or ids, in a table by the chunks' numbers."""

    def __init__(self, path: str, counts_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        check_cuts(path)
        self.library = Tokenizer.from_file(path)
        self.counts_only = counts_only
        vocabulary, added = self.library.get_vocab(), self.library.get_added_tokens_decoder()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120") and i not in added]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[object, int] = {}
        #: Numbers of the chunks without and with a space in front; number n has size[n] ids from begin[n] on.
        self.numbers: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.begin, self.size, self.table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.chars = 0

    def _learn(self, new: list[str], front: str) -> None:
        for at in range(0, len(new), TOGETHER):
            part = new[at: at + TOGETHER]
            for key, e in zip(part, self.library.encode_batch_fast([front + c for c in part], add_special_tokens=False)):
                self.known[key] = len(e.ids)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Sizes and ids of chunks whose one space is in front: of one text of them all, each begins at an id that begins with a space.
        None where these are not as many (a file that lacks the id of a space)."""
        ids, = self._ids([" " + " ".join(chunks)])
        begin = np.flatnonzero(self.spaced[ids])
        return (np.diff(begin, append=len(ids)), ids) if len(begin) == len(chunks) and begin[0] == 0 else None

    def _add(self, new: list[str], front: str) -> None:
        """Number new chunks and keep their ids."""
        alone, together = [], []
        for c in new:
            (together if front and " " not in c and not c[0].isspace() and not c[-1].isspace() else alone).append(c)
        sizes, tables = [self.size], [self.table]
        for chunks, joined in ((together, True), (alone, False)):
            for at in range(0, len(chunks), TOGETHER):
                part = chunks[at: at + TOGETHER]
                got = self._joined(part) if joined else None
                if got is None:
                    ids = self._ids([front + c for c in part])
                    got = np.array([len(i) for i in ids], np.int64), np.concatenate(ids)
                sizes.append(got[0])
                tables.append(got[1])
        self.numbers[front].update(zip(together + alone, range(len(self.size), len(self.size) + len(new))))
        self.size, self.table = np.concatenate(sizes), np.concatenate(tables)
        self.begin = np.cumsum(self.size) - self.size
        self.chars += sum(map(len, new)) + 8 * len(new)

    def _number(self, chunks: pa.Array, front: str) -> np.ndarray:
        coded = chunks.dictionary_encode()
        distinct, numbers = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.numbers[front]
        number = np.array([numbers.get(c, -1) for c in distinct], np.int64)
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self._add([distinct[i] for i in new], front)
            number[new] = [numbers[distinct[i]] for i in new]
        return number[coded.indices.to_numpy()]

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has; null is empty."""
        if self.chars > CACHE_CHARS:
            self._forget()
        lists = cut_all(texts.fill_null(""))
        chunks, length = lists.flatten(), lists.value_lengths().to_numpy()
        stop = np.cumsum(length, dtype=np.int64)
        head = np.zeros(len(chunks), bool)
        head[(stop - length)[length > 0]] = True
        number = np.zeros(len(chunks), np.int64)
        # first chunks have no space in front
        for front, which in (("", head), (" ", ~head)):
            number[which] = self._number(chunks.filter(pa.array(which)), front)
        size = self.size[number]
        upto = np.r_[0, np.cumsum(size)]
        ids = self.table[np.repeat(self.begin[number] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(upto[stop], prepend=0)

    def values(self, texts: list[str | None]) -> Iterator:
        """The count, or the little-endian 32-bit ids, of every text; null is empty."""
        if not self.counts_only:
            ids, size = self.arrays(pa.array(texts, pa.string()))
            yield from (i.astype("<u4").tobytes() for i in np.split(ids, np.cumsum(size)[:-1]))
            return
        if self.chars > CACHE_CHARS:
            self._forget()
        lists = [cut(t) if t else [] for t in texts]
        # first chunks have no space in front and are kept under pairs
        heads = {c[0] for c in lists if c}
        wanted = set()
        for c in lists:
            wanted.update(c[1:])
        for new, front in (([c for c in wanted if c not in self.known], " "), ([c for c in heads if (" ", c) not in self.known], "")):
            self.chars += sum(map(len, new)) + 8 * len(new)
            if front:
                self._learn(new, front)
            elif new:
                kept, self.known = self.known, {}
                self._learn(new, front)
                kept.update(((" ", c), v) for c, v in self.known.items())
                self.known = kept
        get = self.known.__getitem__
        for c in lists:
            yield get((" ", c[0])) + sum(map(get, c[1:])) if c else 0


def encoder(path: str, counts_only: bool = False) -> ChunkEncoder:
    """The worker's encoder for a file."""
    return per_worker(("chunks", path, counts_only), lambda: ChunkEncoder(path, counts_only))
