"""Neighbour search, clusters and path matches against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.operators import match as X
from boreline.operators import surface as SF
from boreline.operators.knn import CROWD, _tree, knn, nearest_groups
from boreline.operators.clusters import clusters
from boreline.sources.store import materialize

RNG = np.random.default_rng(5)


def brute(q, p, k):
    out = {}
    for r in q.itertuples():
        c = p[p.grp != r.qgrp]
        d = np.hypot(c.u - r.u, c.v - r.v).to_numpy()
        order = np.lexsort((c.id.to_numpy(), d))[:k]
        out[r.qid] = list(zip(c.id.to_numpy()[order].tolist(), d[order]))
    return out


def cloud(kind):
    n = 240
    if kind == "spread":
        u, v, g = RNG.uniform(0, 1000, n), RNG.uniform(0, 700, n), RNG.integers(0, 12, n)
    elif kind == "hot_group":      # a third of the points belong to one group in one spot, others far away
        u, v, g = RNG.uniform(0, 1e4, n), RNG.uniform(0, 1e4, n), RNG.integers(1, 9, n)
        u[:80], v[:80], g[:80] = RNG.normal(50, 1, 80), RNG.normal(50, 1, 80), 0
    elif kind == "coincident":     # a third of the points share one place
        u, v, g = RNG.uniform(0, 100, n), RNG.uniform(0, 100, n), RNG.integers(0, 6, n)
        u[:80], v[:80] = 33.0, 44.0
    elif kind == "outlier":        # one point spans the square, a dense spot lies inside the rest
        u, v, g = RNG.uniform(0, 100, n), RNG.uniform(0, 100, n), RNG.integers(0, 12, n)
        u[0], v[0] = 1e7, -1e7
        u[1:60], v[1:60] = 50 + RNG.normal(0, 1e-4, 59), 50 + RNG.normal(0, 1e-4, 59)
    else:                          # fewer foreign points than k
        u, v, g = RNG.uniform(0, 10, n), RNG.uniform(0, 10, n), np.zeros(n, int)
        g[:3] = 1
    return pd.DataFrame({"id": np.arange(n), "grp": g.astype("int64"), "u": u, "v": v})


@pytest.mark.parametrize("kind", ["spread", "hot_group", "coincident", "few_foreign", "outlier"])
def test_knn_matches_brute_force(spark, kind):
    p = cloud(kind)
    q = p.rename(columns={"id": "qid", "grp": "qgrp"})
    extra = pd.DataFrame({"qid": [9001, 9002], "qgrp": [0, 99], "u": [-500.0, 2e4], "v": [3.0, 2e4]})
    q = pd.concat([q, extra], ignore_index=True)
    got = knn(spark.createDataFrame(q), spark.createDataFrame(p), 5, levels=7, crowd=20 if kind == "outlier" else CROWD).toPandas()
    want = brute(q, p, 5)
    for qid, near in want.items():
        g = got[got.qid == qid].sort_values("rank")
        assert np.allclose(g["dist"], [d for _, d in near])
        assert g["id"].tolist() == [i for i, _ in near]
    own = got.merge(q[["qid", "qgrp"]], on="qid").merge(p[["id", "grp"]], on="id")
    assert (own.qgrp != own.grp).all()


@pytest.mark.parametrize("search", [lambda q, p: knn(q, p, 3), lambda q, p: nearest_groups(q, p, 3)])
def test_cells_are_not_broadcast(spark, search):
    """Parquet packs cells to a fraction of their size in memory, so no side that grows with the points may go through the driver."""
    p = spark.createDataFrame(cloud("spread"))
    found = search(p.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v"), p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("kind", ["hot_group", "beside"])
def test_refinement_of_crowded_cells(spark, kind):
    """Queries of one group next to a dense spot of another: crowded cells are split, answers stay exact."""
    p = cloud("hot_group")
    if kind == "beside":
        p.loc[:79, "grp"] = 3
    q = p.sample(40, random_state=1).rename(columns={"id": "qid", "grp": "qgrp"})
    q["u"], q["v"] = q["u"] + 7.0, q["v"] + 5.0
    got = knn(spark.createDataFrame(q), spark.createDataFrame(p), 2, levels=10, crowd=4).toPandas()
    for qid, near in brute(q, p, 2).items():
        assert np.allclose(got[got.qid == qid].sort_values("rank")["dist"], [d for _, d in near])
    near = nearest_groups(spark.createDataFrame(q), spark.createDataFrame(p), 3, levels=10, crowd=4).toPandas()
    for r in q.itertuples():
        c = p[p.grp != r.qgrp].assign(d=lambda t: np.hypot(t.u - r.u, t.v - r.v)).sort_values(["d", "id"]).groupby("grp").head(1).head(3)
        g = near[near.qid == r.qid].sort_values("rank")
        assert g["id"].tolist() == c["id"].tolist() and g["grp"].tolist() == c["grp"].tolist()


def test_tree_is_as_deep_as_the_points_need(spark):
    p = spark.createDataFrame(cloud("outlier"))
    _, t, fine, tree, depth = _tree(p, 1, 7, 20, True)
    assert depth > 24 and fine.groupBy("fx", "fy").agg(F.sum("c").alias("c")).agg(F.max("c")).first()[0] <= 20
    assert tree.groupBy("lvl").agg(F.sum("c").alias("c")).where("c <> 240").count() == 0
    q = p.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v")
    near, pd_p = nearest_groups(q, p, 3, levels=4, crowd=8).toPandas(), p.toPandas()
    for r in pd_p.head(30).itertuples():
        c = pd_p[pd_p.grp != r.grp].assign(d=lambda t: np.hypot(t.u - r.u, t.v - r.v)).sort_values(["d", "id"]).groupby("grp").head(1).head(3)
        assert near[near.qid == r.id].sort_values("rank")["id"].tolist() == c["id"].tolist()
    even = spark.createDataFrame(cloud("spread"))
    assert _tree(even, 1, 7, CROWD, True)[4] == 7


def test_plane_with_large_ridge_is_inverse_distance(spark):
    nb = pd.DataFrame({"qid": 1, "dist": [1.0, 2.0, 3.0], "du": [1.0, 0, -3], "dv": [0.0, 2, 0], "h": [10.0, 20, 60]})
    df = spark.createDataFrame(nb)
    r = SF.local_plane(df, ["qid"], "h", 1e12).first()
    assert r.base == pytest.approx(r.plane, rel=1e-6)
    flat = SF.local_plane(df.withColumn("h", 5 + 2 * F.col("du") - F.col("dv")), ["qid"], "h", 0.0).first()
    assert flat.plane == pytest.approx(5.0)


def test_coincident_neighbour_uses_the_floor(spark):
    df = spark.createDataFrame(pd.DataFrame({"qid": 1, "dist": [0.0, 1.0], "h": [7.0, 100.0]}))
    assert SF.idw(df, ["qid"], ["h"]).first().h == pytest.approx((7e6 + 100) / (1e6 + 1))


def dbscan(p, eps, m):
    d = np.hypot(p.u.to_numpy()[:, None] - p.u.to_numpy(), p.v.to_numpy()[:, None] - p.v.to_numpy())
    core = (d <= eps).sum(1) >= m
    lab = np.where(core, p.id.to_numpy(), -1)
    while True:
        new = lab.copy()
        for i in np.where(core)[0]:
            new[i] = lab[(d[i] <= eps) & core].min()
        if (new == lab).all():
            break
        lab = new
    for i in np.where(~core)[0]:
        near = (d[i] <= eps) & core
        lab[i] = lab[near].min() if near.any() else -1
    return {int(k): int(c) for k, c in zip(*np.unique(lab, return_counts=True))}


def test_clusters_match_brute_force(spark):
    n = 150
    p = pd.DataFrame({"id": np.arange(n), "u": RNG.uniform(0, 100, n), "v": RNG.uniform(0, 100, n)})
    p.loc[:39, "u"] = 20 + RNG.normal(0, 0.5, 40)      # a hot spot
    p.loc[:39, "v"] = 20 + RNG.normal(0, 0.5, 40)
    got = clusters(spark.createDataFrame(p), 6.0, 3, lambda d: materialize(d, "t")).toPandas()
    assert dict(zip(got["cluster"].astype(int), got["size"].astype(int))) == dbscan(p, 6.0, 3)


def test_path_matches_with_many_copies(spark):
    """A third of the paths are identical, some are near-copies, all start at one place."""
    base = np.cumsum(RNG.normal(0, 30, (30, 2)), axis=0)
    paths = {}
    for w in range(36):
        if w % 3 == 0:
            xy = base.copy()
        elif w % 3 == 1:
            xy = base + RNG.normal(0, 2, base.shape) * (1 + w / 6)
        else:
            xy = np.cumsum(RNG.normal(0, 200, (30, 2)), axis=0)
        xy[0] = 0.0
        paths[w] = xy
    p = pd.concat([pd.DataFrame({"w": w, "g": np.arange(30) + (w % 2), "x": xy[:, 0], "y": xy[:, 1]}) for w, xy in paths.items()])
    got = X.path_matches(spark.createDataFrame(p), "w", 40.0, lambda d: materialize(d, "t")).toPandas().set_index("w")
    want = {}
    for a in paths:
        best = None
        for b in paths:
            if a == b:
                continue
            j = p[p.w == a].merge(p[p.w == b], on="g")
            span = 29
            if len(j) - 1 < 0.5 * span:
                continue
            d = (abs(j.x_x - j.x_y) + abs(j.y_x - j.y_y)).mean()
            if d < 40 and (best is None or d < best[1] - 1e-12):
                best = (b, d)
        if best:
            want[a] = best
    assert set(got.index) == set(want)
    for a, (b, d) in want.items():
        assert got.loc[a, "dist"] == pytest.approx(d, abs=1e-9) and got.loc[a, "match"] == b


def test_path_matches_in_small_tiles(spark):
    """One bundle in which every path is near every other, of unlike lengths and with missing places, met in many small tiles."""
    rng, paths = np.random.default_rng(5), {}
    base = np.cumsum(rng.normal(0, 30, (40, 2)), axis=0)
    for w in range(30):
        lo, hi = int(rng.integers(0, 12)), int(rng.integers(20, 40))
        xy = (base + rng.normal(0, 8, base.shape) * (1 + w / 10))[lo:hi]
        paths[f"w{w}"] = pd.DataFrame({"w": f"w{w}", "g": np.arange(lo, hi), "x": xy[:, 0], "y": xy[:, 1]})
    paths["w3"] = paths["w3"].drop(index=4)
    paths["far"] = paths["w9"].assign(w="far", g=paths["w9"].g + 1000)
    paths["short"] = paths["w9"].head(5).assign(w="short")
    p = pd.concat(paths.values(), ignore_index=True)
    got = X.path_matches(spark.createDataFrame(p), "w", 60.0, lambda d: materialize(d, "t"), pack=7).toPandas().set_index("w")
    want = {}
    for a, pa in paths.items():
        span = pa.g.max() - pa.g.min()
        for b, pb in paths.items():
            over = min(pa.g.max(), pb.g.max()) - max(pa.g.min(), pb.g.min())
            if a == b or span + 1 < 10 or over < 0.5 * span:
                continue
            j = pa.merge(pb, on="g")
            d = (abs(j.x_x - j.x_y) + abs(j.y_x - j.y_y)).mean()
            if d < 60 and (a not in want or d < want[a][1]):
                want[a] = (b, d, over / span)
    assert set(got.index) == set(want) and len(want) > 20
    for a, (b, d, c) in want.items():
        assert got.loc[a, "match"] == b and got.loc[a, "dist"] == pytest.approx(d, abs=1e-9) and got.loc[a, "cover"] == pytest.approx(c)


def test_the_cloud_does_not_broadcast_its_customers(spark):
    """Their file is small and their rows are many: joined by sorting on both sides."""
    from boreline.plans import bindings as B
    plan = B.cloud(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_clusters_of_coincident_points(spark):
    """Most points have a twin, so the median distance and eps are 0: points at one place are a cluster, others none."""
    p = spark.createDataFrame([(i, float(i % 4), 0.0) for i in range(14)] + [(20, 9.0, 9.0)], "id long, u double, v double")
    got = clusters(p, 0.0, 4, lambda d: materialize(d, "t")).toPandas().sort_values("cluster").values.tolist()
    assert got == [[-1, 7, 0], [0, 4, 4], [1, 4, 4]]


def test_long_chains_take_few_rounds(spark):
    from boreline.operators.surface import components
    rounds = []

    def counted(d):
        rounds.append(1)
        return materialize(d, "t")

    order = np.random.default_rng(3).permutation(600)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "a long, b long")
    got = components(edges, spark.range(601).withColumnRenamed("id", "node"), counted).toPandas()
    assert got[got.node < 600]["label"].eq(0).all() and got[got.node == 600]["label"].tolist() == [600]
    assert len(rounds) <= 12
