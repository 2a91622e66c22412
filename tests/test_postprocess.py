"""Damped slopes, whole-series merging, standardised weights and the post-processing grid, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.operators import fuse as U
from boreline.operators import levels as LV
from boreline.operators import metrics as M

RNG = np.random.default_rng(8)


def test_guarded_slope(spark):
    rows, want = [], {}
    for w, (n, span) in enumerate([(97, 500.0), (9, 500.0), (60, 80.0), (60, 900.0)]):
        x = np.sort(RNG.uniform(0, span, n))
        x[0], x[-1] = 0.0, span
        y = (0.004 if w else -0.05) * x + RNG.normal(0, 0.1, n)
        rows += [(w, i, n, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
        k = np.arange(n) % int(np.ceil(n / 20)) == 0
        xs, ys = x[k], y[k]
        i, j = np.triu_indices(len(xs), 1)
        s = np.clip(np.median((ys[j] - ys[i]) / (xs[j] - xs[i])), -0.006, 0.006)
        want[w] = s if len(xs) >= 10 and xs[-1] - xs[0] > 100 else 0.0
    df = spark.createDataFrame(rows, "well long, i long, n long, x double, y double")
    got = LV.guarded_slope(df, ["well"], F.col("x"), F.col("y"), F.col("i"), F.col("n"), points=20, min_rows=10)
    assert {r.well: r.slope for r in got.collect()} == pytest.approx(want)
    assert want[1] == want[2] == 0.0 and want[0] == -0.006


def test_damped(spark):
    c = LV.damped(F.lit(300.0), F.lit(0.01), 150.0)
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r["lin"], r["sat"]) == pytest.approx((3 * np.exp(-2), 1.5 * (1 - np.exp(-2))))


def test_combine_full(spark):
    cols = "a double, b double, c double, ea double, eb double, ec double, ka boolean, kb boolean, kc boolean"
    rows = [(1.0, 2.0, 6.0, 4.0, 1.0, 9.0, True, True, True),
            (1.0, 2.0, 6.0, 4.0, 1.0, 9.0, True, False, True),      # b has gaps in the unknown rows
            (1.0, None, 6.0, 4.0, 1.0, 9.0, True, True, True),      # b is missing in this known row only
            (1.0, 2.0, 6.0, 4.0, None, 9.0, False, False, False)]   # none is whole: all count; b was never scored
    df = spark.createDataFrame(rows, cols)
    got = [r.asDict() for r in df.select(*[v.alias(k) for k, v in U.combine_full(list("abc"), ["ea", "eb", "ec"], ["ka", "kb", "kc"]).items()]).collect()]
    assert got[0] == pytest.approx({"mean": 3.0, "median": 2.0, "best": 2.0, "topn": 1.5, "winv": (0.25 + 2 + 6 / 9) / (0.25 + 1 + 1 / 9),
                                    "softmax": (np.exp(-4) + 2 * np.exp(-1) + 6 * np.exp(-9)) / (np.exp(-4) + np.exp(-1) + np.exp(-9))})
    assert got[1]["best"] == 1.0 and got[1]["topn"] == got[1]["mean"] == 3.5
    assert got[2]["best"] is None and got[2]["topn"] == 1.0 and got[2]["winv"] == pytest.approx((0.25 + 6 / 9) / (0.25 + 1 + 1 / 9))
    assert got[3]["mean"] == 3.0 and got[3]["best"] == 1.0 and got[3]["topn"] == 3.5


def test_standard_softmax(spark):
    p = pd.DataFrame({"i": range(40), "x": RNG.normal(5, 2, 40), "y": 7.0})
    w = U.standard_softmax(spark.createDataFrame(p), {"x": F.col("x"), "y": F.col("y")}, {"a": [0.2, 1.5, 3.0], "b": []}).toPandas().sort_values("i")
    z = 0.2 + 1.5 * (p.x - p.x.mean()) / p.x.std(ddof=0)                 # the constant feature adds nothing
    assert np.allclose(w.w_a, 1 / (1 + np.exp(-z))) and np.allclose(w.w_a + w.w_b, 1.0)
    assert list(w.columns) == ["i", "x", "y", "w_a", "w_b"]


def test_postprocess_grid(spark):
    p = pd.DataFrame(RNG.normal(0, 3, (50, 5)), columns=["r", "a", "b", "c", "d"])
    cases = {("one", 1): (F.col("a"), F.col("b")), ("two", 2): (F.col("c"), F.col("d"))}
    got = U.postprocess_grid(spark.createDataFrame(p), cases, F.col("r"), [0.5, 1.0], [0.0, 0.3]).collect()
    assert len(got) == 8 and {r.n for r in got} == {50}
    for g in got:
        u, v = (p.a, p.b) if g.c0 == "one" else (p.c, p.d)
        assert g.rmse == pytest.approx(np.sqrt(((p.r - g.alpha * ((1 - g.share) * u + g.share * v)) ** 2).mean()))


def test_chord_direction(spark):
    df = spark.createDataFrame([(1, 3, 0.0, 5.0), (1, 1, 4.0, 1.0), (1, 2, 9.0, 9.0), (2, 1, 2.0, 2.0)], "g long, o long, x double, y double")
    got = {r.g: r.theta for r in M.chord_direction(df, ["g"], "x", "y", F.col("o")).collect()}
    assert got == pytest.approx({1: np.arctan2(4.0, -4.0), 2: 0.0})


def test_weights_of_the_smoother_are_those_of_a_cubic_fit():
    """One constant table per window size: row u holds what each value adds to the fitted cubic at place u."""
    from boreline.operators.series import _cubic_weights
    for m in (2, 3, 8):
        places = np.arange(-m, m + 1)
        v = np.vander(places, 4)
        assert np.allclose(_cubic_weights(m), v @ np.linalg.pinv(v), atol=1e-12)
