"""Columnar store of candidate tables and restartable appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one takes its place only on one machine (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile
        d = tempfile.mkdtemp(prefix="boreline-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_store(df: DataFrame, path: str, split: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by `split`, rows clustered by a key range so hot series span many files."""
    df.repartitionByRange(split, "well", "seq").sortWithinPartitions("well", "seq").write.mode(mode).partitionBy(split).parquet(path)


def store_meta(df: DataFrame) -> DataFrame:
    """One row per series."""
    return df.groupBy("well").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"),
                                  F.max("seq").alias("last_seq"), F.avg("nn").alias("nn_mean"))


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in `done`."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def append_missing(spark: SparkSession, todo: DataFrame, path: str, keys: list[str]) -> None:
    """Append only what an earlier, interrupted run has not written."""
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        done = None
    new = todo if done is None else pending(todo, done, keys)
    new.write.mode("append").parquet(path)


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources with equal columns; per key the row of the first source that has it."""
    cols = sources[0].columns
    u = None
    for i, s in enumerate(sources):
        t = s.select(*cols, F.lit(i).alias("__p"))
        u = t if u is None else u.unionByName(t)
    rest = [c for c in cols if c not in keys]
    g = u.groupBy(*keys).agg(F.min(F.struct("__p", *rest)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest], F.col("__r")["__p"].alias("source"))


def coverage(expected: DataFrame, delivered: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Per group: expected rows, delivered rows, missing rows, delivered values that are not finite."""
    d = delivered.select(*keys, F.col(value).alias("__v"), F.lit(True).alias("__got"))
    t = expected.join(d, keys, "left")
    bad = F.col("__got") & (F.col("__v").isNull() | F.isnan("__v") | (F.abs("__v") == float("inf")))
    return t.groupBy(group).agg(F.count(F.lit(1)).alias("expected"), F.count("__got").alias("delivered"),
                                F.count(F.when(F.col("__got").isNull(), 1)).alias("missing"),
                                F.count(F.when(bad, 1)).alias("not_finite"))
