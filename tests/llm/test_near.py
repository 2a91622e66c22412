import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCS, awkward, edited, near_components, prose, shingles, with_clashes, without_repeats

from boreline.llm import near_dedup, suffix_index, suffixes
from boreline.llm.blocks import shingle_sets, text_blocks
from boreline.llm.graph import components
from boreline.llm.hyperminhash import band_keys, estimate, sketches
from boreline.llm.near_dedup import link
from boreline.llm.suffix_index import SuffixIndex, remove_repeats


def linked(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def expected(rows):
    known = {k: (c, x) for k, _, c, x in near_components([(r[0], r[1]) for r in rows if r[0] is not None])}
    return sorted(((k, len(shingles(t)), *(known[k] if k is not None else (None, True))) for k, t, *_ in rows), key=str)


def crowd(n):
    """Near copies of one text, some edited too much, some linked only to each other, and texts around a common passage."""
    base, passage = prose("base", 150), prose("passage", 70)
    out = [edited(base, s, random.Random(s).choice([0.005, 0.01, 0.02, 0.05, 0.08])) for s in range(n)]
    out += [passage + " " + prose(f"v{s // 2}", 25) + (" tail" if s % 2 else "") for s in range(n)]
    return [(1000 - i, t, "en", "a", len(t)) for i, t in enumerate(out)]


def test_awkward_rows(spark):
    rows = awkward()
    assert linked(link(with_clashes(spark.createDataFrame(rows, DOCS)))) == expected(rows)
    assert link(spark.createDataFrame([], DOCS)).count() == 0
    nothing = [(1, None, None, None, None), (2, "  ", None, None, None), (None, None, None, None, None)]
    assert linked(link(spark.createDataFrame(nothing, DOCS))) == expected(nothing)


def test_rows_that_share_a_key(spark):
    rows = [(1, prose("x", 50), None, None, None), (7, prose("x", 50), None, None, None), (7, prose("y", 60), None, None, None), (9, prose("y", 60) + " more", None, None, None)]
    assert linked(link(spark.createDataFrame(rows, DOCS))) == expected(rows)


@pytest.mark.parametrize(("small", "tile"), [(2, 16), (32, 1024)])
def test_crowded_buckets_lose_nothing(spark, monkeypatch, small, tile):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = crowd(90)
    assert linked(link(spark.createDataFrame(rows, DOCS))) == expected(rows)


def test_sketches_estimate_similarity():
    texts = [edited(prose("s", 400), s, 0.004 * s) for s in range(40)] + [prose(s, 6) for s in range(10)]
    (_, _, data, offsets), = text_blocks(pa.array(texts))
    h, bound = shingle_sets(data, offsets)
    sets = [shingles(t) for t in texts]
    assert np.diff(bound).tolist() == [len(s) for s in sets]
    regs, keys = sketches(h, bound), None
    keys = band_keys(regs)
    for i in range(40):
        true = len(sets[0] & sets[i]) / len(sets[0] | sets[i])
        assert abs(estimate(regs[:1], regs[i: i + 1])[0] - true) < 0.13
        if true >= 0.75:
            assert (keys[0] == keys[i]).any()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (3001, 3000), (3001, 3000)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(1000 + i, 1000) for i in range(80)} | {(3000, 3000), (3001, 3000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect() if r.doc_id is not None)


def plain_removed(rows):
    return sorted((k, n, r, s, hashlib.sha256(b).hexdigest()) for k, n, r, s, b in without_repeats(sorted({(k, t) for k, t, *_ in rows if k is not None}, key=lambda x: x[0])))


@pytest.mark.parametrize("hot", [50_000, 5])
def test_repeated_passages_go(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_index, "HOT", hot)
    monkeypatch.setattr(suffix_index, "BATCHES", (0.25, 0.25, 0.25, 0.25))
    monkeypatch.setattr(suffix_index, "CHUNK", 2000)
    rows = awkward()
    got = remove_repeats(with_clashes(spark.createDataFrame(rows, DOCS)))
    want = plain_removed(rows)
    assert sorted(set(removed(got))) == want
    assert got.count() == len(rows) and sum(r[2] for r in want) > 5000
    keyless = got.filter("doc_id is null").first()
    assert keyless.n_removed == 0 and keyless.n_bytes == len("a text without a key " * 20)


def test_periods_cut_texts_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 500)
    r = random.Random(4)
    long = prose("long", 3000, 3000)
    at = [r.randrange(len(long) - 400) for _ in range(12)]
    rows = [(0, long), (1, "ab" * 400), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "é" * 120), (6, "".join(long[a: a + r.randrange(90, 130)] + "|" for a in at))]
    rows += [(10 + i, long[a: a + 99 + i % 3]) for i, a in enumerate(at)]
    rows = [(*x, None, None, None) for x in rows]
    got = remove_repeats(spark.createDataFrame(rows, DOCS), carry=["lang"])
    assert removed(got) == plain_removed(rows)
    kept = {k: b.decode("utf-8", "ignore") for k, _, _, _, b in without_repeats([(k, t) for k, t, *_ in rows])}
    assert {r.doc_id: r.kept_text for r in got.collect()} == kept
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_levels_merge_like_a_counter(spark):
    index, sizes = SuffixIndex(), []
    for b in range(5):
        keys = spark.createDataFrame([(b, 1), (100, 1), (200 + b // 2, 1)], "key long, c long")
        found = {r.key for r in index.add(keys).collect()}
        assert found == ({100} if b else set()) | ({200 + b // 2} if b % 2 else set())
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    assert sum(t.count() for _, t in index.levels) == len({0, 1, 2, 3, 100, 200, 201}) + 3


def test_levels_merge_in_a_whole_table(spark, monkeypatch):
    sizes, add = [], SuffixIndex.add

    def noted(index, *args, **kw):
        sizes.append([n for n, _ in index.levels])
        return add(index, *args, **kw)

    monkeypatch.setattr(SuffixIndex, "add", noted)
    rows = [(i, prose(f"own {i}", 60) + (prose("shared", 120) if i % 3 == 0 else ""), None, None, None) for i in range(40)]
    assert removed(remove_repeats(spark.createDataFrame(rows, DOCS))) == plain_removed(rows)
    assert [2] in sizes and [2, 1] in sizes


def test_texts_that_share_a_key_do_not_break(spark):
    long = prose("shared key", 300)
    rows = [(1, long), (2, "short " * 5), (2, "x " + long), (3, long[500:900])]
    got = remove_repeats(spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got) == sorted((k, len(t.encode())) for k, t in rows)
    assert all(r.n_removed == 0 for r in got if r.doc_id == 1) and all(r.n_removed == r.n_bytes for r in got if r.doc_id == 3)
