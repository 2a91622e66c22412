"""Collections of one file per series: written without a process per file, listed by few tasks."""

import os

import pytest
from pyspark.sql import functions as F

from boreline.sources import logs


@pytest.fixture()
def wells(spark):
    w = spark.range(700).select(F.concat(F.lit("w"), F.col("id") % 70).alias("well"), F.floor(F.col("id") / 70).alias("seq"),
                                F.when(F.col("id") % 9 > 0, F.col("id") / 7).alias("md"), F.col("id").cast("double").alias("y"))
    odd = spark.createDataFrame([("a/b", 0, 1.0, 1.0), ("x=1 %", 0, None, 2.0), ("é:", 0, float("inf"), 3.0), (None, 0, float("nan"), 4.0), ("", 0, 1e-300, 5.0)], w.schema)
    return w.unionByName(odd).select("*", *[F.lit(0.0).alias(c) for c in ("x", "z", "gr", "tvt_input")])


def rows(df):
    return sorted((tuple(r) for r in df.select("well", "md", "y").collect()), key=str)


def test_files_are_those_of_the_writer(spark, wells, tmp_path, monkeypatch):
    read = lambda p: logs.read_wells(spark, p, truth=False, columns=["MD", "Y"], order=None, files="*.csv", key=logs.folder_key(), nested=True)
    logs.write_wells(wells, f"file:{tmp_path}/own", rows=4)
    names = [f"{d}/{f}" for d, _, fs in os.walk(tmp_path / "own") for f in fs]
    # 70 series of ten rows in three pieces and 5 of a row, of which null and empty share a folder; no checksums, nothing unfinished
    assert len(names) == 215 and all(n.endswith(".csv") and "/part-" in n for n in names)
    monkeypatch.setattr(logs, "_mounted", lambda *_: None)
    logs.write_wells(wells, f"{tmp_path}/spark", rows=4)
    assert sorted(os.listdir(tmp_path / "own")) == sorted(f for f in os.listdir(tmp_path / "spark") if f.startswith("well="))
    got = rows(read(f"{tmp_path}/own"))
    assert len(got) == 705 and got == rows(read(f"{tmp_path}/spark"))


def test_folders_are_listed_by_few_tasks(spark, wells, tmp_path):
    logs.write_wells(wells.where("well like 'w%'"), f"{tmp_path}/few")
    sc, before = spark.sparkContext, spark.conf.get(logs.LISTING, None)
    sc.setJobGroup("listing", "listing")
    try:
        df = logs.read_wells(spark, f"{tmp_path}/few", truth=False, order=None, files="*.csv", key=logs.folder_key(), nested=True)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    tasks = [track.getStageInfo(s).numTasks for j in track.getJobIdsForGroup("listing") for s in track.getJobInfo(j).stageIds]
    assert len(df.inputFiles()) == 70 and max(tasks) <= 4 * sc.defaultParallelism and spark.conf.get(logs.LISTING, None) == before


def test_no_series(spark, wells, tmp_path):
    logs.write_wells(wells.limit(0), f"{tmp_path}/none")
    assert logs.read_wells(spark, f"{tmp_path}/none", truth=False, order="Y", files="*.csv", key=logs.folder_key(), nested=True).count() == 0
