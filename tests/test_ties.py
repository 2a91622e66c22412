"""Scores that tie in truth are told apart by their rule, not by the last digit of a sum."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from boreline.operators import match as X
from boreline.operators.metrics import ensemble_weights
from boreline.plans import registry
from pyspark.sql import functions as F

registry.load()


def test_likelihoods_equal_but_for_rounding_rank_by_seed(spark):
    ll = pd.DataFrame({"well": [1, 1, 1], "seed": [1, 2, 3], "ll": [-0.1 - 0.2, -0.3, -5.0]})
    assert ll.ll[0] != ll.ll[1]
    got = ensemble_weights(spark.createDataFrame(ll), ["well"], [3.0], 0.5).toPandas().set_index("seed")
    assert got["rank"].to_dict() == {1: 1, 2: 2, 3: 3}


def test_correlation_far_from_zero(spark):
    o = 1e9 + np.array([1.0, 2.0, 4.0, 3.0])
    crv = 1e9 + np.arange(6) ** 2.0
    t = spark.createDataFrame(pd.DataFrame({"well": 1, "o": o, "at": [0.0, 1.0, 2.0, 3.0]})).withColumn("crv", F.array(*[F.lit(float(c)) for c in crv]))
    got = X.shift_correlations(t, ["well"], "o", F.col("at"), "crv", [0.0, 2.0, 9.0], 0.0, 1.0).toPandas().sort_values("i")
    want = [np.corrcoef(o - 1e9, crv[:4] - 1e9)[0, 1], np.corrcoef(o - 1e9, crv[2:] - 1e9)[0, 1], 0.0]
    assert np.allclose(got["r"], want, atol=1e-9)


@pytest.mark.parametrize("name", ["shift_search", "shape_scan"])
def test_constant_side_counts_as_zero_in_sql_too(spark, tmp_path, name):
    n = 40
    falls = np.array([4.0, 3.0, 2.0, 1.0] * 10)
    value = {1: falls, 2: falls + 500.0, 3: np.full(n, 7.0)}
    e = pd.concat([pd.DataFrame({"event_id": np.arange(n) + 1000 * w, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) * (300 if w == 1 else 1), "min"),
                                 "user_id": w, "event_type": "a", "value": v, "props": "{}"}) for w, v in value.items()])
    size = np.arange(1, 51)
    part = pd.DataFrame({"p_partkey": size, "p_size": size.astype("int32"), "p_retailprice": np.where(size < 20, 900.0, 900.0 + 3 * size)})
    e.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    part.to_parquet(tmp_path / "part.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    for t in ("events", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.execute(registry.SQL[name]).df()
    keys = [k for k in ("well", "win") if k in got]
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) and (got["score"] == got["score"]).all()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
