import re

import numpy as np
import pytest
from plain import DOCS, awkward, lower, prose, with_clashes
from pyspark.sql import functions as F

from boreline.llm import fm_index, leak_search
from boreline.llm.leak_search import find_leaks, without_spans

ITEMS = "item_id long, text string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def windows(items, width=10):
    out = set()
    for k, t in items:
        w = split(t)
        for i in range(max(len(w) - width + 1, 1) if w else 0):
            out.add((tuple(w[i: i + width]), "" if k is None else str(k)))
    return out


def plain(docs, items):
    """doc_id, words, spans and items of every row, by trying every place."""
    by = {}
    for w, k in windows(items):
        by.setdefault(w, set()).add(k)
    sizes, out = {len(w) for w in by}, []
    for r in docs:
        w, hit, ids = split(r[1]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                k = by.get(tuple(w[i: i + n]))
                if k:
                    hit |= set(range(i, i + n))
                    ids |= k
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((r[0], len(w), len(hit), tuple(map(tuple, spans)), tuple(sorted(ids))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple((s.a, s.b) for s in r.spans), tuple(r["items"])) for r in df.collect()), key=str)


def items():
    base = awkward()
    return [(1, base[10][1]), (2, base[19][1][:300]), (3, "one"), (4, "One, two"), (5, None), (6, "?! --"), (None, base[7][1][5000:5400]), (7, base[7][1][5000:5100]),
            (7, base[8][1]), (10, base[10][1]), (10, base[10][1]), (11, "ab " * 30), (12, "☃ é 日本 \U0001F600 " * 4), (13, prose("nowhere", 50))]


@pytest.mark.parametrize(("shard", "block"), [(leak_search.SHARD_WORDS, leak_search.BLOCK), (64, 7), (4000, 50)])
def test_awkward_rows(spark, shard, block):
    """Shards smaller than a document, and more blocks of windows than one, change nothing."""
    rows = awkward()
    docs = with_clashes(spark.createDataFrame(rows, DOCS)).repartition(3)
    bench = spark.createDataFrame(items(), ITEMS).withColumn("words", F.lit("other")).withColumn("size", F.lit(1))
    assert got(find_leaks(docs, bench, shard_words=shard, block=block)) == plain(rows, items())


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(awkward(), DOCS), spark.createDataFrame(items(), ITEMS)
    assert find_leaks(docs.limit(0), bench).count() == 0
    assert got(find_leaks(docs, bench.limit(0))) == plain(awkward(), [])
    assert got(find_leaks(docs, spark.createDataFrame([(1, None), (2, " .")], ITEMS))) == plain(awkward(), [])


def test_removed_spans(spark):
    rows = [(1, "Keep this. " + "a b c d e f g h i j k" + ", and that é", None, None, None), (2, None, None, None, None), (3, "clean text", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = find_leaks(docs, spark.createDataFrame([(1, "A b c d e f g h i j k!")], ITEMS))
    kept = {r.doc_id: r.kept_text for r in without_spans(docs.join(found, "doc_id")).collect()}
    assert kept == {1: "Keep this. , and that é", 2: None, 3: "clean text"}


@pytest.mark.parametrize("kind", ["random", "copies", "one word", "empty", "nothing"])
def test_index_against_scan(kind):
    r = np.random.default_rng(5)
    texts = {"random": [r.integers(0, 9, n) for n in (0, 1, 400, 63, 64, 65, 7)], "copies": [np.arange(40) % 7] * 30, "one word": [np.zeros(200, int)] * 3,
             "empty": [np.zeros(0, int)] * 3, "nothing": []}[kind]
    words = [np.asarray(t).astype(np.uint64) * np.uint64(1 << 59) + np.uint64(3) for t in texts]
    f = fm_index.from_bytes(fm_index.to_bytes(fm_index.build(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array([len(t) for t in texts], np.int64))))
    probe = [w[i: i + n] for w in words for n in (1, 2, 5, 6) for i in range(0, max(len(w) - n, 0), 3)] + [np.array([4, 5], np.uint64)]
    grid, size = np.zeros((len(probe), 6), np.uint64), np.array([len(p) for p in probe])
    for row, p in zip(grid, probe):
        row[6 - len(p):] = p
    lo, hi = f.count(grid, size)
    for p, a, b in zip(probe, lo, hi):
        want = [int(f.starts[k]) + i for k, w in enumerate(words) for i in range(len(w) - len(p) + 1) if (w[i: i + len(p)] == p).all()]
        assert sorted(f.locate(np.arange(a, b)).tolist()) == want
