"""Order-dependent primitives with cells and blocks small enough that every series crosses many of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.operators import ordering as O
from boreline.operators import quantiles as Q

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def rows(spark):
    """One series holds most rows, its order values are dense at one end and tied."""
    parts = []
    for w, n in [(1, 400), (2, 23), (3, 1)]:
        t = np.round(RNG.exponential(30, n), 0)
        parts.append(pd.DataFrame({"sid": w, "t": t, "id": RNG.permutation(n) + 1000 * w, "v": RNG.normal(size=n).round(3)}))
    p = pd.concat(parts, ignore_index=True)
    p.loc[p.index % 5 == 0, "v"] = np.nan
    p = p.sort_values(["sid", "t", "id"]).reset_index(drop=True)
    p["seq"] = p.groupby("sid").cumcount()
    df = spark.createDataFrame(p).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).repartition(4)
    return p, df


def test_row_numbers_cross_cells(rows):
    p, df = rows
    got = O.number_rows(df.drop("seq"), ["sid"], "t", "id", cell_rows=16).toPandas().sort_values(["sid", "t", "id"]).reset_index(drop=True)
    assert (got["seq"].to_numpy() == p["seq"].to_numpy()).all()
    assert (got["n"].to_numpy() == p.groupby("sid")["id"].transform("size").to_numpy()).all()


def test_running_sum_crosses_blocks(rows):
    p, df = rows
    got = O.running_sum(df, ["sid"], {"c": F.coalesce("v", F.lit(0.0))}, block=7).toPandas().sort_values(["sid", "seq"])
    want = p.assign(c=p["v"].fillna(0)).groupby("sid")["c"].cumsum()
    assert np.allclose(got["c"], want)


def test_frames_cross_blocks(rows):
    p, df = rows
    got = O.framed(df, ["sid"], 3, lambda w: {"m": F.avg("v").over(w.rowsBetween(-3, 3)), "l": F.lag("v", 2).over(w)}, block=5)
    got = got.toPandas().sort_values(["sid", "seq"])
    assert len(got) == len(p)
    want = p.groupby("sid")["v"].transform(lambda s: s.rolling(7, center=True, min_periods=1).mean())
    assert np.allclose(got["m"], want, equal_nan=True)
    assert np.allclose(got["l"], p.groupby("sid")["v"].shift(2), equal_nan=True)


def test_gap_fill_crosses_blocks(rows, spark):
    p, df = rows
    long_gap = df.withColumn("v", F.when(~F.col("seq").between(40, 90), F.col("v")))
    got = O.fill_linear(long_gap, ["sid"], "v", "f", block=8, default=F.lit(-1.0)).toPandas().sort_values(["sid", "seq"])
    base = p["v"].where(~p["seq"].between(40, 90))
    want = base.groupby(p["sid"]).transform(lambda s: s.interpolate(limit_direction="both")).fillna(-1.0)
    assert np.allclose(got["f"], want)


def test_quantiles_cross_cells(rows):
    p, df = rows
    got = Q.group_quantiles(df, ["sid"], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.93}, cell_rows=9).toPandas().set_index("sid")
    for w, s in p.dropna().groupby("sid")["v"]:
        assert np.allclose(got.loc[w], np.quantile(s, [0.1, 0.5, 0.93]))


def test_quantiles_with_one_dominating_value(spark):
    v = np.r_[np.full(300, 2.0), np.arange(100) / 7]
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = Q.group_quantiles(df, [], F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.99}, cell_rows=5).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(v, [0.25, 0.5, 0.99]))


def test_weighted_median_and_top(spark):
    p = pd.DataFrame({"sid": [1] * 5, "v": [5.0, 1, 3, 2, 4], "q": [1.0, 1, 1, 1, 10], "id": range(5)})
    df = spark.createDataFrame(p)
    assert Q.weighted_median(df, ["sid"], F.col("v"), F.col("q"), "m").first().m == 4.0
    top = Q.top_per_group(df, ["sid"], [F.desc("v"), F.asc("id")], 2).toPandas().sort_values("rank")
    assert top["v"].tolist() == [5.0, 4.0]


@pytest.mark.parametrize("kind", ["outlier", "ties", "tail"])
def test_no_cell_is_crowded(spark, kind):
    n, cell = 4000, 200
    x = {"outlier": np.r_[np.arange(n - 1.0), 1e12], "ties": np.r_[np.full(n - 10, 5.0), np.arange(10.0)], "tail": RNG.standard_cauchy(n) ** 2}[kind]
    p = pd.DataFrame({"sid": 1, "t": x, "id": RNG.permutation(n)})
    got = O.number_rows(spark.createDataFrame(p).repartition(3), ["sid"], "t", "id", cell_rows=cell)
    want = p.sort_values(["t", "id"]).reset_index(drop=True)
    assert (got.toPandas().sort_values("seq")["id"].to_numpy() == want["id"].to_numpy()).all()
    df = spark.createDataFrame(p)
    sizes = df.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    cells = df.join(O.value_cuts(df, ["sid"], "t", sizes, "n", cell), "sid").groupBy(O.cell_of(F.col("t"), F.col("__cuts")).alias("c")).count().toPandas()
    crowded = cells[cells["count"] > 2 * cell]
    if kind == "ties":
        assert len(crowded) == 1 and (crowded["c"] % 2 == 1).all()
    else:
        assert len(crowded) == 0 and len(cells) >= n / cell
    r = Q.value_ranks(df, ["sid"], F.col("t"), cell_rows=cell).toPandas().sort_values("v")
    assert (r["r0"].to_numpy() == np.r_[0, np.cumsum(r["c"])[:-1]]).all()


def test_ties_are_cut_by_the_tie(spark):
    df = spark.range(3000).select(F.lit(1).alias("sid"), F.lit(7.0).alias("t"), (F.col("id") * 7 % 3000).alias("id"))
    got = O.number_rows(df, ["sid"], "t", "id", cell_rows=100).toPandas()
    assert (got["seq"] == got["id"]).all()


def test_large_series_may_have_columns_of_the_added_names(spark):
    """A table numbered again (permutation_importance) has seq already; above cell_rows this was an ambiguous column."""
    n = 400
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "seq": np.arange(n) // 2, "n": np.arange(n) % 7, "o": np.arange(n) % 10 * 1.0, "id": np.arange(n)}))
    small = O.number_rows(df, ["k"], "o", "id").toPandas().set_index("id")
    large = O.number_rows(df, ["k"], "o", "id", cell_rows=30).toPandas().set_index("id")
    assert sorted(large.columns) == sorted(small.columns)
    assert (large["seq"] == small.loc[large.index, "seq"]).all() and (large["n"] == n).all()
    again = O.number_rows(df.drop("n"), ["k"], "o", "seq", cell_rows=30).toPandas()
    assert sorted(again["seq"]) == list(range(n)) and again.sort_values("seq")["o"].is_monotonic_increasing
