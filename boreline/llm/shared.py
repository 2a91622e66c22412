"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast table of cells, at most.
CELLS = 1 << 20


def per_worker(key: object, make: Callable):
    """What a Python worker makes once and keeps for its later tasks.  It is kept on the interpreter, as the globals of a
    function that is shipped by value are new in every task."""
    kept = sys.__dict__.setdefault("_boreline_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (tests) a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage at a Parquet table that survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS))


def split_by_keys(rows: DataFrame, key: str, ids: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """rows that may have a key among ids and rows that surely have none, told by cells of the keys' hashes.  At most CELLS
    rows are broadcast whatever the input; the first part still has to be joined, but the second need not be shuffled."""
    cells = F.broadcast(ids.select(_cell(F.col(id_)).alias("__cell")).distinct())
    celled = rows.withColumn("__cell", _cell(F.col(key)))
    return celled.join(cells, "__cell", "left_semi").drop("__cell"), celled.join(cells, "__cell", "left_anti").drop("__cell")


def without(rows: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """rows whose key is not among ids; a null key is a key like others."""
    some, rest = split_by_keys(rows, key, ids, id_)
    gone = ids.select(F.col(id_).alias("__id")).distinct()
    return some.join(gone, F.col(key).eqNullSafe(F.col("__id")), "left_anti").union(rest)
