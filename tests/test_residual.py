"""The residual model: what a fold's predictions may depend on, and stored models on new series."""

import numpy as np
import pandas as pd
import pytest

from boreline.operators import residual as R

SPEC = R.Spec(features=("dS", "dP", "nn_aniso", "md_since", "x", "well_no"), min_rows=3, trees=2)


def table(seed=1):
    r = np.random.default_rng(seed)
    n = 360
    t = pd.DataFrame({"well": np.arange(n) // 20, "seq": np.arange(n) % 20, "nn_aniso": r.uniform(0, 1200, n), "md_since": r.uniform(0, 4000, n), "x": r.normal(size=n)})
    t["well_no"] = t.well.astype(float)
    t["fold"] = (t.well % 3).astype("int64")
    truth = r.normal(0, 30, n)
    t["dS"], t["dP"] = truth + r.normal(0, 1 + t.nn_aniso / 100), truth + r.normal(0, 1 + t.md_since / 400)
    t["d"] = truth + 8 * (t.x > 0)
    return t


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    return str(tmp_path_factory.mktemp("models"))


def rows(df):
    return df.toPandas().sort_values(["well", "seq"]).reset_index(drop=True)


@pytest.mark.parametrize("target", R.TARGETS)
def test_every_row_is_predicted_once_and_better(spark, path, target):
    t = table()
    got = rows(R.out_of_fold(spark.createDataFrame(t), target, SPEC, path))
    assert len(got) == len(t) and got.pred.notna().all()
    rms = lambda c: np.sqrt(np.mean((got.d - got[c]) ** 2))
    assert rms("pred") < rms("base")
    again = rows(spark.read.parquet(f"{path}/{target}/oof"))
    assert (again.pred == got.pred).all()


def test_a_fold_is_not_seen_by_its_own_model(spark, path):
    """Another truth in fold 0 changes nothing in the predictions of fold 0, and changes those of the others."""
    t = table()
    a = rows(R.out_of_fold(spark.createDataFrame(t), "resid_adapt", SPEC, path + "/a"))
    t.loc[t.fold == 0, "d"] += 1000.0 * np.arange((t.fold == 0).sum())
    b = rows(R.out_of_fold(spark.createDataFrame(t), "resid_adapt", SPEC, path + "/b"))
    own = a.fold == 0
    assert (a.pred[own] == b.pred[own]).all() and (a.base[own] == b.base[own]).all()
    assert (a.pred[~own] != b.pred[~own]).mean() > 0.9


def test_stored_model_on_new_series(spark, path):
    t = table()
    df = spark.createDataFrame(t)
    R.fit(df.where("well < 12"), "resid_adapt", SPEC, path + "/one")
    new = df.where("well >= 12")
    got = rows(R.apply(spark, path + "/one", new.drop("d", "fold"), SPEC))
    assert len(got) == 120 and np.sqrt(np.mean((got.pred - t.d[t.well >= 12].to_numpy()) ** 2)) < np.sqrt(np.mean((got.base - t.d[t.well >= 12].to_numpy()) ** 2))
    curves = R.fit_curves(df.where("well < 12"), SPEC)
    a = t[t.well < 12]
    first = a[a.nn_aniso < 50]
    assert np.isclose(curves["near"][0], np.sqrt(np.mean((first.d - first.dS) ** 2)))
    gaps = new.drop("d", "fold").withColumn("x", new.x * float("nan")).selectExpr("well", "seq", "dS", "dP", "nn_aniso", "md_since", "CAST(NULL AS DOUBLE) AS x", "well_no")
    assert rows(R.apply(spark, path + "/one", gaps, SPEC)).pred.notna().all()
    with pytest.raises(ValueError):
        R.apply(spark, path + "/one", new, R.Spec(features=("dS",)))
    with pytest.raises(ValueError):
        R.base("other", None, SPEC)
