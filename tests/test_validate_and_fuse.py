import numpy as np
import pytest
from pyspark.sql import functions as F

from boreline.operators import fuse, surface, validate


def groups(n, seed=3):
    r = np.random.default_rng(seed)
    return r.integers(5, 60, n), r.gamma(2.0, 40.0, n)


@pytest.mark.parametrize("n", [150, 20_000])
def test_bootstrap_deviation(spark, n):
    size, sse = groups(n)
    t = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(size, sse))], "idx long, n long, m double")
    draws = 2000 if n < 1000 else 200
    got = np.array([r.m for r in validate.bootstrap(t, ["m"], draws).collect()])
    r = np.random.default_rng(1)
    true = []
    for _ in range(2000):
        k = r.integers(0, n, n)
        true.append(np.sqrt(sse[k].sum() / size[k].sum()))
    assert len(got) == draws
    assert abs(got.std() / np.std(true) - 1) < (0.1 if draws == 2000 else 0.2)
    assert abs(got.mean() / np.mean(true) - 1) < 0.01


def test_draws_reach_every_group(spark):
    last = 1_500_000
    idx = spark.range(0, last, 50).select(F.col("id").alias("idx"), F.lit(1).alias("n"))
    t = validate._replicates(idx, [], 3)
    drawn = t.where(F.col("__u") >= validate.DRAW_CHANCES[0])
    share = drawn.groupBy("rep").agg((F.count(F.lit(1)) / (last / 50)).alias("s"), F.max("idx").alias("top")).collect()
    assert all(abs(r.s - 0.632) < 0.01 and r.top > 1_490_000 for r in share) and len(share) == 3


def test_subsample(spark):
    size, sse = groups(300)
    t = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(size, sse))], "idx long, n long, m double")
    got = np.array([r.m for r in validate.subsample(t, ["m"], 400, 100).collect()])
    r = np.random.default_rng(1)
    true = [np.sqrt(sse[k].sum() / size[k].sum()) for k in (r.choice(300, 100, replace=False) for _ in range(2000))]
    assert abs(got.std() / np.std(true) - 1) < 0.15
    whole = validate.subsample(t, ["m"], 2, 300).collect()
    assert all(x.m == pytest.approx(np.sqrt(sse.sum() / size.sum())) for x in whole)


def test_missing_members_are_left_out(spark):
    t = spark.createDataFrame([(1.0, 3.0, 10.0, 2.0, 1.0, 4.0), (1.0, None, 10.0, 2.0, 1.0, 4.0), (1.0, 3.0, None, 2.0, None, 4.0), (None, None, None, 1.0, 1.0, 1.0)],
                              "a double, b double, c double, ea double, eb double, ec double")
    out = [r.asDict() for r in t.select(*[v.alias(k) for k, v in fuse.combine(["a", "b", "c"], ["ea", "eb", "ec"]).items()]).collect()]
    assert out[0]["mean"] == pytest.approx(14 / 3) and out[0]["best"] == 3.0 and out[0]["top2"] == 2.0
    assert out[0]["wrmse"] == pytest.approx((1 / 2 + 3 + 10 / 4) / (1 / 2 + 1 + 1 / 4))
    assert out[1]["mean"] == 5.5 and out[1]["best"] == 1.0 and out[1]["wrmse"] == pytest.approx((1 / 2 + 10 / 4) / (3 / 4))
    assert out[2]["mean"] == 1.0 and out[2]["best"] == 1.0 and out[2]["top2"] == 1.0 and out[2]["soft"] == 1.0
    assert all(v is None for v in out[3].values())


def test_sweeps_of_any_width(spark, monkeypatch):
    monkeypatch.setattr(fuse, "SWEEP", 7)
    t = spark.range(1, 5).select(F.col("id").cast("double").alias("x"))
    got = {r.variant: (r.n, r.rmse) for r in fuse.wide_sweep(t, {f"v{i}": F.col("x") * i for i in range(20)}).collect()}
    assert got == {f"v{i}": (4, pytest.approx(np.sqrt(2.5 * i))) for i in range(20)}


def test_long_chains_have_one_label(spark, tmp_path):
    from boreline.operators.surface import components
    from boreline.sources.store import materialize
    r = np.random.default_rng(2).permutation(60)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(r[:-1], r[1:])], "a long, b long")
    got = components(edges, spark.range(61).withColumnRenamed("id", "node"), lambda d: materialize(d, "labels"))
    assert {x.node: x.label for x in got.collect()} == {**{i: 0 for i in range(60)}, 60: 60}
    assert surface.components is components


def test_long_series_are_refused_alone(spark):
    rows = [(w, i, float(i) if i < 30 else None, float(i)) for w, n in ((1, 40), (2, 80)) for i in range(n)]
    t = spark.createDataFrame(rows, "well long, seq long, tvt_input double, tvt double")
    pred = validate.evaluate(t, None, lambda known, curve, i: np.full(len(known), 1.0), max_rows=50, leave_out=True)
    assert {r.well for r in pred.collect()} == {1}
    assert [tuple(r) for r in validate.refused(t, max_rows=50).collect()] == [(2, 80)]


def test_subsample_sorts_no_more_than_it_may_need(spark, monkeypatch):
    size, sse = groups(3000)
    t = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(size, sse))], "idx long, n long, m double")
    sorted_rows = []
    write = validate.materialize
    monkeypatch.setattr(validate, "materialize", lambda df, name: sorted_rows.append((out := write(df, name)).count()) or out)
    few = {r.rep: r.m for r in validate.subsample(t, ["m"], 20, 10).collect()}
    assert 20 * 10 <= sorted_rows[0] <= 20 * 80
    # bounds that some or all replicates fall short of change nothing
    for ample in (1, 0):
        assert {r.rep: r.m for r in validate.subsample(t, ["m"], 20, 10, ample).collect()} == pytest.approx(few)
