"""Ranges of a numeric key with about equal numbers of rows, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(x: Column, cuts: list[float], low: int = 0) -> Column:
    """Number of cuts (in order) up to x, as a tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x < F.lit(cuts[mid]), search(x, cuts[:mid], low)).otherwise(search(x, cuts[mid + 1:], low + mid + 1))


def as_number(key: Column) -> Column:
    """Null keys come first."""
    return F.coalesce(key.cast("double"), F.lit(float("-inf")))


def begins(docs: DataFrame, key: str) -> list[float]:
    """The first key of every range, in order; as many ranges as the session has shuffle partitions, or fewer; empty for no rows.
    What comes to the driver is one number a range, as in a sort by ranges."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = docs.select(F.col(key).cast("double").alias("k"))
    cuts = sorted({float(c) for c in keys.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    k = as_number(F.col(key))
    rows = docs.select(search(k, cuts).alias("part"), k.alias("k")).groupBy("part").agg(F.min("k").alias("k")).orderBy("part").collect()
    return [r["k"] for r in rows]
