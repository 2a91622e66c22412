"""Robust levels and trends of long tails against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from boreline.operators import levels as LV

RNG = np.random.default_rng(21)


def tails():
    parts = []
    for w, n in ((1, 6000), (2, 3), (3, 40), (4, 1)):
        x = np.sort(RNG.uniform(-900, 0, n))
        parts.append(pd.DataFrame({"well": w, "seq": np.arange(n), "n": n, "x": x, "z": RNG.normal(size=n), "w": np.exp(x / 400),
                                   "y": 5 + 0.02 * x + RNG.normal(size=n) + 80 * (RNG.random(n) < 0.1)}))
    p = pd.concat(parts, ignore_index=True)
    p.loc[p.well == 3, "y"] = 4.0
    return p


def wmedian(v, w):
    o = np.argsort(v, kind="stable")
    c = np.cumsum(w[o])
    return v[o][np.searchsorted(c, 0.5 * c[-1])]


def test_levels(spark):
    p = tails()
    df = spark.createDataFrame(p).repartition(4).union(spark.createDataFrame([(1, 7000, 6000, 0.0, 0.0, 1.0, None)], "well long, seq long, n long, x double, z double, w double, y double"))
    got = LV.robust_levels(df, ["well"], F.col("y"), F.col("w")).toPandas().set_index("well")
    for w, g in p.groupby("well"):
        v, q = g.y.to_numpy(), g.w.to_numpy()
        lo, hi = np.quantile(v, [0.1, 0.9])
        m = (v >= lo) & (v <= hi)
        c = wmedian(v, q)
        for _ in range(15):
            r = v - c
            k = 1.345 * (1.4826 * np.median(np.abs(r)) + 1e-9)
            new = np.average(v, weights=q * np.minimum(1, k / np.maximum(np.abs(r), 1e-12)))
            if abs(new - c) < 1e-6:
                break
            c = new
        assert np.allclose(got.loc[w, ["wmedian", "mean", "trim10", "huber", "last"]].astype(float), [wmedian(v, q), np.average(v, weights=q), np.average(v[m], weights=q[m]), c, v[-1]], atol=1e-5)


def test_trend(spark):
    p = tails()
    got = LV.huber_trend(spark.createDataFrame(p), ["well"], F.col("y"), [F.col("x") / 1000, F.col("z")], F.col("w"), rounds=8, ridge=0.01).toPandas().set_index("well")
    for w, g in p[p.well != 4].groupby("well"):
        a, y, q = np.c_[np.ones(len(g)), g.x / 1000, g.z], g.y.to_numpy(), g.w.to_numpy()
        ww, beta = q.copy(), np.full(3, np.inf)
        for _ in range(8):
            b = np.linalg.solve(a.T @ (ww[:, None] * a) + np.diag([0, 0.01, 0.01]), a.T @ (ww * y))
            if np.max(np.abs(b - beta)) < 1e-8:
                break
            beta, r = b, np.abs(y - a @ b)
            ww = q * np.minimum(1, 1.345 * (1.4826 * np.median(r) + 1e-9) / np.maximum(r, 1e-12))
        assert np.allclose(got.loc[w, ["b0", "b1", "b2"]].astype(float), b, atol=1e-5)


def test_theil_sen(spark):
    p = tails()
    got = LV.theil_sen(spark.createDataFrame(p), ["well"], F.col("x"), F.col("y"), F.col("seq"), F.col("n"), points=120, min_gap=50.0, limit=0.5).toPandas().set_index("well").slope
    for w, g in p.groupby("well"):
        g = g[g.seq % int(np.ceil(len(g) / 120)) == 0]
        dx, dy = g.x.to_numpy()[:, None] - g.x.to_numpy(), g.y.to_numpy()[:, None] - g.y.to_numpy()
        s = dy[dx > 50] / dx[dx > 50]
        assert np.isclose(got[w], np.clip(np.median(s), -0.5, 0.5) if len(s) else 0.0)


def test_rounds_of_short_series_write_no_counted_values(spark, monkeypatch):
    """Medians of a round come from a window where every series is short, from counted values otherwise; levels are the same."""
    from boreline.operators import levels, quantiles
    rng, written = np.random.default_rng(5), []
    rows = [(w, i, float(x), float(np.exp((i - n) / 9))) for w, n in enumerate((40, 1, 7)) for i, x in enumerate(rng.standard_t(2, n))]
    df = spark.createDataFrame(rows, "well long, seq long, y double, wt double")
    monkeypatch.setattr(quantiles, "materialize", lambda d, name, real=quantiles.materialize: written.append(name) or real(d, name))
    out = []
    for limit in (levels.WINDOW_ROWS, 0):
        monkeypatch.setattr(levels, "WINDOW_ROWS", limit)
        written.clear()
        out.append(levels.robust_levels(df, ["well"], F.col("y"), F.col("wt")).toPandas().sort_values("well").to_numpy(float))
        assert (written.count("counts") <= 2) == (limit > 0)
    assert np.allclose(out[0], out[1], atol=1e-9)
