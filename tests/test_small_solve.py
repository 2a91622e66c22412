"""The Cholesky solver, robust polynomials and weights of several members against numpy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.functions.small_solve import solve_definite
from boreline.operators import fuse as U
from boreline.operators.robust import project
from boreline.sources.store import materialize

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("p", [1, 2, 4, 6])
def test_solver(spark, p):
    mats = [m @ m.T + 0.1 * np.eye(p) for m in RNG.normal(size=(6, p, p))]
    rhs = RNG.normal(size=(6, p))
    if p > 1:
        mats += [np.ones((p, p)), np.zeros((p, p))]
        rhs = np.vstack([rhs, np.ones((2, p))])
    rows = [{**{f"a{i}_{j}": float(m[i, j]) for i in range(p) for j in range(i + 1)}, **{f"b{i}": float(b[i]) for i in range(p)}, "k": k} for k, (m, b) in enumerate(zip(mats, rhs))]
    out = [f"x{i}" for i in range(p)]
    got = solve_definite(spark.createDataFrame(pd.DataFrame(rows)), [[f"a{i}_{j}" for j in range(i + 1)] for i in range(p)], [f"b{i}" for i in range(p)], out).toPandas().sort_values("k")
    for k in range(6):
        assert np.allclose(got[out].iloc[k].astype(float), np.linalg.solve(mats[k], rhs[k]))
    if p > 1:
        assert got[out[-1]].iloc[6:].isna().all()
    assert not [c for c in got.columns if c.startswith("__")]


def irls(x, u, degree, loss, rounds=4, cval=4.0):
    t = 2 * (x - x.min()) / (x.max() - x.min()) - 1
    v, w = np.vander(t, degree + 1), np.ones(len(t))
    for _ in range(rounds):
        beta = np.linalg.lstsq(v * w[:, None], u * w, rcond=None)[0]
        r = u - v @ beta
        s = cval * (1.4826 * np.median(np.abs(r - np.median(r))) + 1e-6)
        w = 1 / (1 + (r / s) ** 2) if loss == "cauchy" else 1 / np.maximum(1, np.abs(r) / s)
    return v @ beta


@pytest.mark.parametrize(("degree", "loss"), [(2, "cauchy"), (3, "huber"), (5, "cauchy")])
def test_projection(spark, degree, loss):
    parts = []
    for w, n in ((1, 300), (2, degree + 5), (3, degree + 4), (4, 30)):
        x = np.sort(RNG.uniform(0, 900, n)) if w < 4 else np.full(n, 5.0)
        parts.append(pd.DataFrame({"well": w, "x": x, "u": np.sin(x / 150) * 20 + RNG.normal(size=n) + 200 * (RNG.random(n) < 0.05)}))
    p = pd.concat(parts, ignore_index=True)
    p["i"] = np.arange(len(p))
    got = project(spark.createDataFrame(p), "well", "x", "u", materialize, degree=degree, loss=loss).toPandas().sort_values("i")
    for w, g in got.groupby("well"):
        if w in (1, 2):
            assert np.allclose(g.fit, irls(g.x.to_numpy(), g.u.to_numpy(), degree, loss), atol=1e-5)
        else:
            assert g.fit.isna().all()
    with pytest.raises(ValueError):
        project(spark.createDataFrame(p), "well", "x", "u", materialize, loss="other")


def test_weights_of_members(spark):
    p = 5
    s = RNG.uniform(1, 9, (20, p))
    base = np.corrcoef(RNG.normal(size=(p, 9))) * 0.5 + 0.5 * np.eye(p)
    df = spark.createDataFrame(pd.DataFrame({**{f"s{i}": s[:, i] for i in range(p)}, "k": range(20)}))
    out = [f"w{i}" for i in range(p)]
    rho = {(i, j): F.lit(float(base[i, j])) for i in range(p) for j in range(i)}
    got = U.covariance_weights_of(df, [F.col(f"s{i}") for i in range(p)], rho, out).toPandas().sort_values("k")
    for k in range(20):
        w = np.clip(np.linalg.solve(base * np.outer(s[k], s[k]), np.ones(p)), 0, None)
        assert np.allclose(got[out].iloc[k].astype(float), w / w.sum())
    three = U.covariance_weights([F.col(f"s{i}") for i in range(3)], rho[1, 0], rho[2, 0], rho[2, 1])
    some = U.covariance_weights_of(df, [F.col(f"s{i}") for i in range(3)], rho, out[:3]).select("w0", "w1", "w2", *[x.alias(f"c{i}") for i, x in enumerate(three)]).toPandas()
    assert np.allclose(some[["w0", "w1", "w2"]], some[["c0", "c1", "c2"]])
    alike = U.covariance_weights_of(df, [F.lit(2.0)] * 2, {(1, 0): F.lit(1.0)}, ["a", "b"]).first()
    assert alike.a == alike.b == 0.5


def test_convex_sse(spark):
    rows, want = [], []
    grid = [(a / 60, b / 60) for a, b in itertools.product(range(61), range(61)) if a + b <= 60]
    for k in range(30):
        r, d = RNG.normal(size=40), RNG.normal(size=(2, 40))
        r = r + RNG.normal() * 2 * d[0] + RNG.normal() * 2 * d[1]
        rows.append((k, r @ r, r @ d[0], r @ d[1], d[0] @ d[0], d[0] @ d[1], d[1] @ d[1]))
        want.append(min(((r - a * d[0] - b * d[1]) ** 2).sum() for a, b in grid))
    rows.append((30, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    want.append(5.0)
    df = spark.createDataFrame([tuple(map(float, x)) for x in rows], "k double, rr double, r1 double, r2 double, a double, b double, c double")
    got = [r.e for r in df.withColumn("e", U.convex_sse(*[F.col(c) for c in ("rr", "r1", "r2", "a", "b", "c")])).orderBy("k").collect()]
    assert (np.array(got) <= np.array(want) + 1e-9).all() and np.allclose(got, want, rtol=2e-2, atol=0.2)
