"""File sources, stores and sinks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreline.operators import validate as V
from boreline.sources import logs, store


@pytest.fixture()
def folder(tmp_path):
    for w, n, cut in [("000d7d20", 60, 40), ("00bbac68", 50, 50), ("00e12e8b", 30, 10)]:
        md = [100.0 + i for i in range(n)]
        d = pd.DataFrame({"MD": md, "X": 3e6 + pd.Series(md), "Y": 1.0, "Z": -5.0, "GR": [None if i % 6 == 0 else 50.0 + i for i in range(n)],
                          "TVT_input": [float(i) if i < cut else None for i in range(n)], "TVT": [float(i) for i in range(n)],
                          "ANCC": None, "ASTNU": 1.0, "ASTNL": 1.0, "EGFDU": 1.0, "EGFDL": 1.0, "BUDA": 7.0})
        d.to_csv(tmp_path / f"{w}__horizontal_well.csv", index=False, na_rep="NaN" if w == "00e12e8b" else "")
    pd.DataFrame({"TVT": [3.0, 1.0, None], "GR": [30.0, 10.0, 5.0], "Geology": "a"}).to_csv(tmp_path / "000d7d20__typewell.csv", index=False)
    return str(tmp_path)


def test_wells_and_curves(spark, folder):
    w = logs.read_wells(spark, folder)
    assert w.where("isnan(tvt_input)").count() == 0 and w.where("tvt_input is null").count() == 40
    n = {r.well: (r.n, r.k) for r in w.groupBy("well").agg(F.max("n").alias("n"), F.max("seq").alias("k")).collect()}
    assert n == {"000d7d20": (60, 59), "00bbac68": (50, 49), "00e12e8b": (30, 29)}
    assert logs.read_wells(spark, folder, columns=["GR"]).columns == ["well", "md", "gr", "n", "seq"]
    c = logs.read_curves(spark, folder)
    assert c.count() == 2
    k = {r.well: r.knots for r in logs.with_sidecar(w.select("well").distinct(), c).collect()}
    assert k == {"000d7d20": 2, "00bbac68": 0, "00e12e8b": 0}


def test_harness_contract(spark, folder):
    w = logs.read_wells(spark, folder).select("well", "seq", "tvt_input", "tvt", "gr")
    hold = lambda known, curve, wid: [float(known["tvt_input"].dropna().iloc[-1])] * len(known)
    r = V.score(w, V.evaluate(w, logs.read_curves(spark, folder), hold)).collect()
    # cut = n and cut < 20 are left out
    assert [(x.well, x.n_pred) for x in r] == [("000d7d20", 20)]
    assert r[0].sse == sum(i * i for i in range(1, 21))
    with pytest.raises(Exception, match="not finite"):
        V.evaluate(w, None, lambda known, curve, wid: [float("nan")] * len(known)).collect()
    with pytest.raises(Exception, match="too long"):
        V.evaluate(w, None, hold, max_rows=10).collect()


def test_template_and_append(spark, tmp_path):
    t = spark.createDataFrame([("a_1",), ("a_2",), ("b_1",)], "id string")
    p = spark.createDataFrame([("a_1", 3.0), ("b_1", 5.0)], "id string, tvt double")
    out = str(tmp_path / "sub")
    logs.write_submission(t, p, out)
    assert {r.id: float(r.tvt) for r in spark.read.option("header", True).csv(out).collect()} == {"a_1": 3.0, "a_2": 4.0, "b_1": 5.0}
    path = str(tmp_path / "store")
    store.append_missing(spark, p, path, ["id"])
    store.append_missing(spark, p.unionByName(spark.createDataFrame([("c", 1.0)], "id string, tvt double")), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a_1", "b_1", "c"]


def test_parameters_and_log_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"alpha": 0.95,\n "tau": 50.0, "sg": true}')
    r = logs.read_params(spark, str(tmp_path / "p.json"), T.StructType([T.StructField("alpha", T.DoubleType()), T.StructField("sg", T.BooleanType())])).first()
    assert (r.alpha, r.sg) == (0.95, True)
    (tmp_path / "l.txt").write_text("k=60 -> 9.5\nnoise\nk=150 -> 9.25\n")
    s = logs.read_scores(spark, str(tmp_path / "l.txt"), r"(k=\d+)\s*->\s*([\d.]+)").collect()
    assert [(x.name, x.score) for x in s] == [("k=60", 9.5), ("k=150", 9.25)]
