import numpy as np
import pytest
from pyspark.sql import functions as F

from boreline.llm import gnat, hard_negatives
from boreline.llm.hard_negatives import mine
from boreline.llm.q_negatives import whole_vectors

SCHEMA = "vec_id long, label long, embedding array<long>"


def plain(rows, anchor, positives=5, negatives=5):
    rows = [r for r in rows if None not in (r[0], r[1], r[2]) and r[2] and None not in r[2]]
    one = {}
    for i, k, v in rows:
        one[i] = min(one.get(i, (k, v)), (k, v))
    dims = [len(v) for _, v in one.values()]
    dim = min(set(dims), key=lambda d: (-dims.count(d), d)) if dims else 0
    one = {i: (k, np.array(v, dtype=object)) for i, (k, v) in one.items() if len(v) == dim}
    out = []
    for a, (k, v) in one.items():
        if not anchor(a):
            continue
        scores = sorted((-int(v @ w), i, j) for i, (j, w) in one.items() if i != a)
        for ps, p, _ in [s for s in scores if s[2] == k][:positives]:
            fit = [s for s in scores if s[2] != k and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(a, p, r + 1, n, -ps, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 60, (9, dim))
    v = (centre[r.integers(0, 9, n)] + r.normal(0, 8, (n, dim))).round().astype(int)
    v[r.random(n) < 0.3] = v[0]
    return [(int(i), int(r.integers(0, 4)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize(("sample", "leaf_rows", "block", "pack"), [(1 << 14, 4096, 2048, 256), (300, 4, 7, 3), (40, 1, 50, 2)])
def test_against_brute_force(spark, sample, leaf_rows, block, pack):
    rows = clustered(700, 6, 1)
    rows += [rows[5], (None, 1, [1] * 6), (2001, None, [1] * 6), (2002, 1, None), (2003, 1, [1, 2, None, 4, 5, 6]), (2004, 1, []), (2010, 1, [9, 9]), (2020, 2, [0] * 6),
             (2030, 9, [50, 0, 0, 0, 0, 0]), (10, 3, [99] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("other")).withColumn("leaf", F.lit("other")).repartition(3)
    anchor = lambda i: i % 10 == 0
    assert got(mine(df, anchor, sample=sample, leaf_rows=leaf_rows, block=block, pack=pack)) == plain(rows, anchor)


def test_few_rows(spark):
    anchor = lambda i: i % 10 == 0
    for rows in ([], [(0, 1, None)], [(0, 1, [1, 2])], [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 4]), (3, 2, [-1, 0])], [(0, 1, [0, 0]), (1, 1, [5, 0]), (2, 2, [0, 7])]):
        assert got(mine(spark.createDataFrame(rows, SCHEMA), anchor)) == plain(rows, anchor)
    words = spark.createDataFrame([(0, "a", [3, 4]), (1, "a", [3, 4]), (2, "b", [3, 4])], "vec_id long, label string, embedding array<long>")
    assert got(mine(words, anchor)) == [(0, 1, 1, 2, 25, 25)]
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(0, 1, [1 << 27])], SCHEMA), anchor)


def test_vectors_in_whole_steps(spark):
    rows = [(0, 9, [0.5, -0.001]), (1, 3, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (8, None, [None, 1.0]), (14, 9, None)]
    out = {r.vec_id: (r.label, r.embedding) for r in whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert out == {0: (0, [128, -1]), 1: (3, None), 7: (3, None), 8: (None, None), 14: (0, None)}


def test_leaves_are_left_out():
    """In well-parted data the ranges spare most leaves, and every leaf with a vector in a window is visited."""
    r = np.random.default_rng(2)
    centre = r.normal(0, 300, (40, 5))
    x = (centre[r.integers(0, 40, 4000)] + r.normal(0, 3, (4000, 5))).round()
    tree = gnat.grow(x[:500], float((x * x).sum(1).max()), 2)

    def note(k, to, d):
        for j in np.unique(to):
            tree.nodes[k].low[:, j] = np.minimum(tree.nodes[k].low[:, j], d[to == j].min(0))
            tree.nodes[k].high[:, j] = np.maximum(tree.nodes[k].high[:, j], d[to == j].max(0))

    leaf = gnat.descend(tree, x, note)
    seen = 0
    for q in x[:60]:
        score = x @ q
        low, high = np.sort(score)[-80], np.sort(score)[-20]
        to = gnat.visit(tree, q[None], np.array([[low]]), np.array([[high]]))
        assert set(leaf[(score >= low) & (score <= high)]) <= set(to.tolist())
        seen += len(to)
    assert seen < 0.5 * 60 * tree.leaves
