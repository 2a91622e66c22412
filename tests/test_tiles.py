"""Neighbour search in small tiles against brute force, and what it leaves on disk."""

import contextlib
import os
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.operators import tiles as T
from boreline.operators.knn import knn
from boreline.sources.store import checkpoint_dir

SF = "/root/testdata/sf0.01"


def brute(q, p, k, own=False):
    out = {}
    for r in q.itertuples():
        c = p if own else p[[(a != r.qgrp) and not (pd.isna(a) and pd.isna(r.qgrp)) for a in p.grp]]
        d = np.hypot(c.u - r.u, c.v - r.v).to_numpy()
        order = np.lexsort((c.id.rank().to_numpy(), d))[:k]
        out[r.qid] = list(zip(c.id.to_numpy()[order].tolist(), d[order]))
    return out


def points(kind, rng):
    n = 400
    p = pd.DataFrame({"id": rng.permutation(n), "grp": rng.integers(0, 9, n), "u": rng.uniform(0, 1000, n), "v": rng.uniform(0, 300, n)})
    if kind == "own_spot":       # many tiles hold one group only, so its points find nothing in their own tile
        p.loc[:200, ["u", "v"]] = 500 + rng.normal(0, 1e-2, (201, 2))
        p.loc[:200, "grp"] = 3
    elif kind == "hot_place":    # more points at one place than a tile holds
        p.loc[:200, ["u", "v"]] = 77.0
        p.loc[:100, "grp"] = 5
    elif kind == "lattice":      # many equal distances
        p["u"], p["v"] = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, n).astype(float)
    elif kind == "far":          # an outlier, a dense spot and a line
        p.loc[:60, ["u", "v"]] = 1e-7 * rng.normal(0, 1, (61, 2))
        p.loc[61:120, "v"] = 5.0
        p.loc[0, "u"] = -3e9
    elif kind == "huge":
        p[["u", "v"]] *= 1e200
    return p


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("kind", ["even", "own_spot", "hot_place", "lattice", "far", "huge"])
def test_small_tiles_match_brute_force(spark, monkeypatch, kind, own):
    monkeypatch.setattr(T, "BATCH", 40)
    p = points(kind, np.random.default_rng(7))
    q = p.rename(columns={"id": "qid", "grp": "qgrp"})
    q = pd.concat([q, pd.DataFrame({"qid": [9001, 9002, 9003], "qgrp": [0, 99, 3], "u": [-500.0, 2e4, 3.0], "v": [3.0, 2e4, 299.0]})], ignore_index=True)
    got = knn(spark.createDataFrame(q), spark.createDataFrame(p), 4, crowd=16, exclude_own=not own).toPandas()
    want = brute(q, p, 4, own)
    assert len(got) == sum(map(len, want.values()))
    got = got.sort_values(["qid", "rank"]).groupby("qid")
    for qid, near in want.items():
        g = got.get_group(qid)
        assert g["id"].tolist() == [i for i, _ in near] and g["rank"].tolist() == [1, 2, 3, 4][:len(near)]
        assert np.allclose(g["dist"], [d for _, d in near], rtol=1e-12)


def test_keys_of_any_kind_and_queries_without_a_place(spark):
    rng = np.random.default_rng(2)
    p = points("even", rng).head(150)
    p["id"], p["w"] = [f"p{i:03d}" for i in p.id], rng.normal(size=len(p))
    p["grp"] = [None if g == 4 else f"g{g}" for g in p.grp]
    q = p.rename(columns={"id": "qid", "grp": "qgrp"}).drop(columns="w").assign(mark=range(len(p)))
    sp = spark.createDataFrame(p, "id string, grp string, u double, v double, w double")
    sq = spark.createDataFrame(q, "qid string, qgrp string, u double, v double, mark long")
    lost = [("lost", "g1", None, 3.0, -1), ("nowhere", None, float("nan"), None, -2)]
    far = spark.createDataFrame([("z", "g1", None, 1.0, 0.0), ("y", "g2", float("nan"), float("inf"), 0.0)], sp.schema)
    got = knn(sq.union(spark.createDataFrame(lost, sq.schema)), sp.union(far), 3, crowd=12, values=["w"], marks=["mark"]).toPandas()
    at, rows = p.set_index("id").w, got.sort_values(["qid", "rank"]).groupby("qid")
    for r, near in zip(q.itertuples(), brute(q, p, 3).values()):
        g = rows.get_group(r.qid)
        assert g["id"].tolist() == [i for i, _ in near] and (g["mark"] == r.mark).all() and g["w"].tolist() == at[g["id"]].tolist()
    for name, grp, mark in (("lost", "g1", -1), ("nowhere", None, -2)):
        g = rows.get_group(name)
        other = p[[a != grp and not (a is None and grp is None) for a in p.grp]]
        assert g["id"].tolist() == sorted(other.id)[:3] and g["dist"].isna().all() and (g["mark"] == mark).all()


def test_no_points_and_too_few_of_other_groups(spark):
    q = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 5.0, 5.0)], "qid long, qgrp long, u double, v double")
    p = q.withColumnsRenamed({"qid": "id", "qgrp": "grp"})
    assert knn(q, p.where("id < 0"), 3).count() == 0
    assert sorted(tuple(r) for r in knn(q, p, 3).select("qid", "id", "rank").collect()) == [(1, 2, 1), (2, 1, 1)]


def files(spark):
    """Files of the shuffles and written steps of the session, with their bytes."""
    found = {}
    for top in (spark.conf.get("spark.local.dir"), checkpoint_dir(spark).removeprefix("file:")):
        for d, _, names in os.walk(top):
            for x in names:
                with contextlib.suppress(FileNotFoundError):
                    found[f"{d}/{x}"] = os.lstat(f"{d}/{x}").st_size
    return found


def disk_a_point(spark, name):
    """The most bytes that the files of a query ever held, for each point of the cloud."""
    import __spark_entry__
    before, most, done = set(files(spark)), [0], threading.Event()

    def watch():
        while not done.wait(0.1):
            most[0] = max(most[0], sum(n for f, n in files(spark).items() if f not in before))

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        __spark_entry__.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        done.set()
        thread.join()
    return most[0] / spark.read.parquet(f"{SF}/orders.parquet").count()


def test_knn_other_groups_writes_no_pairs(spark):
    """Bytes a point on disk: points and queries, not the pairs that are compared."""
    assert 0 < disk_a_point(spark, "knn_other_groups") < 500


def test_nearest_distance_writes_no_pairs(spark):
    assert 0 < disk_a_point(spark, "nearest_distance") < 500


def test_nearest_distance_matches_brute_force(spark):
    import __spark_entry__
    from boreline.plans import q_spatial
    small = "/root/testdata/sf0.001"
    p = q_spatial.pts(spark, small).toPandas()
    got = __spark_entry__.queries()["nearest_distance"](spark, small).toPandas().set_index("grp")
    d = np.hypot(p.u.to_numpy()[:, None] - p.u.to_numpy(), p.v.to_numpy()[:, None] - p.v.to_numpy())
    np.fill_diagonal(d, np.inf)
    p["any"], p["other"] = d.min(1), np.where(p.grp.to_numpy()[:, None] == p.grp.to_numpy(), np.inf, d).min(1)
    want = p.groupby("grp").agg(d_min=("other", "min"), d_mean=("other", "mean"), own_min=("any", "min"))
    assert np.allclose(got.loc[want.index, want.columns], want, atol=1e-6) and len(got) == len(want)


def test_surface_over_cloud_writes_no_pairs(spark):
    assert 0 < disk_a_point(spark, "surface_over_cloud") < 500


def test_surface_over_cloud_matches_brute_force(spark):
    import __spark_entry__
    from boreline.plans import q_spatial
    small = "/root/testdata/sf0.001"
    p = q_spatial.pts(spark, small).toPandas()
    got = __spark_entry__.queries()["surface_over_cloud"](spark, small).toPandas().set_index("qid")
    at = p.set_index("id")
    q = p.head(200).rename(columns={"id": "qid", "grp": "qgrp"})
    for qid, near in brute(q, p, q_spatial.K).items():
        ids, d = (np.array(x) for x in zip(*near))
        w = 1.0 / np.maximum(d, 1e-3) ** 2
        for h in q_spatial.HS:
            v = at.loc[ids, h].to_numpy(float)
            ok = ~np.isnan(v)
            assert got.loc[qid, h] == pytest.approx((w[ok] * v[ok]).sum() / w[ok].sum(), abs=1e-5)
        assert got.loc[qid, "nn"] == pytest.approx(d[0], abs=1e-6)
    assert len(got) == len(p)
