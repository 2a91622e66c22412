"""Lookups on curves against numpy: several levels of knots, wide gaps, crowded knots, ends, ties and nulls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.operators import lookup as L

RNG = np.random.default_rng(8)


def curves():
    parts = [(1, np.r_[0.0, 1.0, 2.5, 1e12, 1e12 + 1]), (2, np.sort(RNG.normal(size=300))), (3, np.array([7.0]))]
    c = pd.concat([pd.DataFrame({"well": w, "k": k, "v": RNG.normal(size=len(k))}) for w, k in parts], ignore_index=True)
    again = c[c.well == 2].head(5).assign(v=9.0)
    return pd.concat([c, again, pd.DataFrame({"well": [1, 2], "k": [np.nan, 0.1], "v": [1.0, np.nan]})], ignore_index=True)


def nulls(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return df


@pytest.mark.parametrize("fan", [2, 7, 64])
def test_lookup_and_nearest(spark, monkeypatch, fan):
    monkeypatch.setattr(L, "FAN", fan)
    c = curves()
    q = pd.DataFrame({"well": RNG.integers(1, 5, 400), "q": RNG.normal(size=400) * RNG.choice([1, 3, 1e12], 400)})
    knots = c.dropna().groupby(["well", "k"]).v.mean().reset_index()
    some = knots.sample(60, random_state=1)
    q = pd.concat([q, some[["well", "k"]].rename(columns={"k": "q"}), pd.DataFrame({"well": [1, 1], "q": [0.5, np.nan]})], ignore_index=True)
    q["i"] = np.arange(len(q))
    curve, rows = nulls(spark.createDataFrame(c), "k", "v"), nulls(spark.createDataFrame(q), "q")
    got = L.curve_lookup(rows, F.col("q"), curve, ["well"], "out").toPandas().sort_values("i").out.to_numpy()
    near = L.nearest_knot(rows, F.col("q"), curve, ["well"]).toPandas().sort_values("i").near_k.to_numpy()
    for r, g, n in zip(q.itertuples(), got, near):
        own = knots[knots.well == r.well]
        if own.empty or np.isnan(r.q):
            assert np.isnan(g) and np.isnan(n)
            continue
        assert np.isclose(g, np.interp(r.q, own.k, own.v), rtol=1e-9, atol=1e-9)
        at = min(max(r.q, own.k.min()), own.k.max())
        assert n == min(own.k, key=lambda k: (abs(k - at), k))


def test_a_million_knots_in_a_small_place(spark):
    n = 1_000_000
    curve = spark.range(n).select((F.col("id") / n).alias("k"), (F.col("id") * 2.0).alias("v")).union(spark.createDataFrame([(1e12, 5.0)], "k double, v double"))
    rows = spark.range(500).select("id", (F.col("id") * 1999.5 / n).alias("q")).union(spark.createDataFrame([(-1, 1e12 - 1.0), (-2, 5e11)], "id long, q double"))
    got = {r.id: r.out for r in L.curve_lookup(rows, F.col("q"), curve, [], "out").collect()}
    assert all(np.isclose(got[i], 2.0 * i * 1999.5) for i in range(500))
    last, end = (n - 1) / n, 2.0 * (n - 1)
    assert np.isclose(got[-1], 5.0, atol=1e-4) and np.isclose(got[-2], end + (5.0 - end) * (5e11 - last) / (1e12 - last))


def test_empty_curve(spark):
    rows = spark.createDataFrame([(1, 2.0)], "id long, q double")
    assert L.curve_lookup(rows, F.col("q"), spark.createDataFrame([], "k double, v double"), [], "out").first().out is None
