"""What the encoder hands to the library and what a round of a grammar looks at."""

import struct

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from boreline.llm import repair
from boreline.llm.chunks import ChunkEncoder, cut, cut_all, default_path

PATH = default_path("byte_bpe_50k.json")


class Counted:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_new_chunks_share_texts():
    own = ChunkEncoder(PATH, False)
    own.library = Counted(own.library)
    text = " ".join(f"w{i * 7919}x,\ny{i}" for i in range(5000))
    ids = own.library.library.encode(text, add_special_tokens=False).ids
    assert list(own.values([text, None, text])) == [struct.pack(f"<{len(ids)}I", *ids), b"", struct.pack(f"<{len(ids)}I", *ids)]
    assert own.library.texts <= 20


PARTS = st.lists(st.sampled_from([" ", " ", " ", "  ", "\n", "\x1c", "\x85", "　", " ", "a", "Word", "'s", "12", "Ġ", "é", "日", ".", "<|endoftext|>", "<|", "​"]),
                 max_size=20).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | PARTS, max_size=12))
def test_ids_of_many_texts(texts):
    if not hasattr(test_ids_of_many_texts, "library"):
        test_ids_of_many_texts.library = ChunkEncoder(PATH, False).library
    own = ChunkEncoder.__new__(ChunkEncoder)
    own.library, own.counts_only = test_ids_of_many_texts.library, False
    own.spaced = np.zeros(own.library.get_vocab_size(), bool)
    own.spaced[[i for t, i in own.library.get_vocab().items() if t.startswith("Ġ")]] = True
    own._forget()
    want = [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        ids, size = own.arrays(pa.array(texts, kind))
        assert ids.tolist() == sum(want, []) and size.tolist() == [len(w) for w in want]
    some = pa.array([t or "" for t in texts], pa.string())
    assert cut_all(some).to_pylist() == [cut(t) if t else [] for t in some.to_pylist()]


def test_a_file_without_the_id_of_a_space_is_encoded_chunk_by_chunk():
    own = ChunkEncoder(PATH, False)
    own.spaced[:] = False
    ids = own.library.encode("one two three two", add_special_tokens=False).ids
    assert list(own.values(["one two three two"])) == [struct.pack(f"<{len(ids)}I", *ids)]


def test_rounds_look_at_frequent_pairs_only(monkeypatch):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 200_000).astype("<u4")
    ids[:20_000] = np.tile(np.arange(50, dtype="<u4"), 400)
    seen, side = [], repair._side
    monkeypatch.setattr(repair, "_side", lambda symbols, turn: seen.append(len(symbols)) or side(symbols, turn))
    g = repair.build(ids, np.arange(2), np.array([20_000, 180_000]))
    assert np.array_equal(repair.expand(g, g.sequence), ids) and np.array_equal(repair.expand_all(g), ids)
    assert sum(seen) < 2 * len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=6), st.integers(1, 8))
def test_blocks_are_laid_out_whole(docs, times):
    docs = [d * times for d in docs] + [[9] * 70]
    g = repair.build(np.array(sum(docs, []), "<u4"), np.arange(len(docs)), np.array([len(d) for d in docs]))
    assert repair.expand_all(g).tolist() == sum(docs, [])
    empty = repair.build(np.zeros(0, "<u4"), np.arange(1), np.zeros(1, np.int64))
    assert repair.expand_all(empty).tolist() == []
