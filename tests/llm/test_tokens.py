import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import DOCS, awkward, with_clashes

from boreline.llm import repair
from boreline.llm.chunks import ChunkEncoder, check_cuts, default_path
from boreline.llm.shared import new_path
from boreline.llm.token_cache import count_tokens
from boreline.llm.token_files import read_documents, read_index, write_tokens

PATH = default_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "Word", "'s", "'ll", "12", "３", "²", "é", "日本", "\U0001F600", ".", ",", "!!",
                                  "<|endoftext|>", "<|", "|>", "_", "é", "​"]), max_size=25)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_cut_texts_have_the_library_s_ids(parts):
    from tokenizers import Tokenizer
    text = "".join(parts)
    if not hasattr(test_cut_texts_have_the_library_s_ids, "own"):
        test_cut_texts_have_the_library_s_ids.own = Tokenizer.from_file(PATH), ChunkEncoder(PATH, False), ChunkEncoder(PATH, True)
    library, own, counter = test_cut_texts_have_the_library_s_ids.own
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(own.values([text])) == [struct.pack(f"<{len(ids)}I", *ids)]
    assert list(counter.values([text])) == [len(ids)]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="no plain byte-level BPE"):
        check_cuts(default_path("word_bpe_49k.json"))


def test_counts_and_cache(spark, library):
    rows = awkward()
    docs, cache = with_clashes(spark.createDataFrame(rows, DOCS)), new_path(spark, "counts")
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in count_tokens(docs, cache).collect()), key=str) == want
    texts = len({t or "" for _, t, *_ in rows})
    assert spark.read.parquet(cache).select("content").distinct().count() == texts
    # a second run finds all counts there and encodes only what is new
    more = spark.createDataFrame([*rows, (999, "quite new", None, None, None)], DOCS)
    before = spark.read.parquet(cache).count()
    assert count_tokens(more, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == before + 1
    assert count_tokens(docs.limit(0), new_path(spark, "counts")).count() == 0


def test_files_give_all_ids_back(spark, library):
    rows = [*awkward(), (None, None, None, None, None)]
    docs, path = with_clashes(spark.createDataFrame(rows, DOCS)), new_path(spark, "tokens")
    write_tokens(docs, path, block_tokens=2000)
    want, at = [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = sorted((tuple(r) for r in read_index(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    some = read_documents(spark, path, with_ids=True).filter("key = 8").collect()
    assert {struct.pack("<2I", *np.frombuffer(r.ids, "<u4")[-2:]) for r in some} == {struct.pack("<2I", library.encode(rows[8][1]).ids[-1], 2)}


def test_files_without_documents_or_keys(spark):
    path = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame([], DOCS), path)
    assert read_index(spark, path).count() == 0
    path = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame([(None, "a", None, None, None)] * 2, DOCS), path)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in read_index(spark, path).collect()) == [(None, 0, 2), (None, 2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=200), min_size=1, max_size=8), st.integers(0, 70000))
def test_grammars_give_back_every_document(docs, top):
    docs = [d * 6 for d in docs] + [[top] * 40, []]
    size = np.array([len(d) for d in docs])
    g = repair.from_bytes(repair.to_bytes(repair.build(np.array(sum(docs, []), "<u4"), np.arange(len(docs)), size)))
    assert repair.expand(g, g.sequence).tolist() == sum(docs, [])
    for i, d in enumerate(docs):
        assert repair.document(g, i).tolist() == d
        assert [repair.token(g, i, n) for n in range(0, len(d), 5)] == d[::5]
    assert len(g.sequence) < len(sum(docs, [])) or len(g.left) == 0
