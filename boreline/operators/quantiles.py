"""Exact quantiles, ranks and top-k of groups of any size.

Equal values are counted first (map-side), the distinct values of a group are
spread over cells cut at their counted quantiles, and only cell totals are summed per group, so a
group holding a third of all rows is still ranked by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import materialize
from .ordering import CELL_ROWS, cell_of, largest, same_keys, value_cuts


def value_ranks(df: DataFrame, keys: list[str], value: Column, weight: Column | None = None,
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """Keys must not be named like the result columns.  One row per (keys, v): `c` rows, `w` weight, `r0` rows below v, `w0` weight below v, `n`, `wn` totals.

    The counted values are written once and the input is not read again; where no group has more than cell_rows distinct
    values, one window ranks them."""
    wt = F.lit(1.0) if weight is None else weight
    freq = (df.select(*keys, value.cast("double").alias("v"), wt.cast("double").alias("__w"))
            .where(F.col("v").isNotNull())
            .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"), F.sum("__w").alias("w")))
    gk = keys or ["__k"]
    if not keys:
        freq = freq.withColumn("__k", F.lit(1))
    freq = materialize(freq, "counts")
    stats = freq.groupBy(*gk).agg(F.sum("c").alias("n"), F.sum("w").alias("wn"), F.count(F.lit(1)).alias("__m"))
    if largest(stats, "__m") <= cell_rows:
        w = W.partitionBy(*gk)
        below = w.orderBy("v").rowsBetween(W.unboundedPreceding, -1)
        return freq.select(*keys, "v", "c", "w", F.coalesce(F.sum("c").over(below), F.lit(0)).alias("r0"),
                           F.coalesce(F.sum("w").over(below), F.lit(0.0)).alias("w0"), F.sum("c").over(w).alias("n"), F.sum("w").over(w).alias("wn"))
    stats = materialize(stats, "totals")
    cuts = value_cuts(freq, gk, "v", stats, "__m", cell_rows)
    placed = freq.alias("l").join(stats.alias("r"), same_keys(gk)).select("l.*", "r.n", "r.wn")
    placed = placed.alias("l").join(cuts.alias("r"), same_keys(gk), "left").select("l.*", cell_of(F.col("l.v"), F.col("__cuts")).alias("__cell"))
    placed = materialize(placed, "placed")
    cells = placed.groupBy(*gk, "__cell").agg(F.sum("c").alias("__cc"), F.sum("w").alias("__cw"))
    before = W.partitionBy(*gk).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*gk, "__cell", F.coalesce(F.sum("__cc").over(before), F.lit(0)).alias("__oc"),
                         F.coalesce(F.sum("__cw").over(before), F.lit(0.0)).alias("__ow"))
    upto = W.partitionBy(*gk, "__cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumn("__rc", F.sum("c").over(upto)).withColumn("__rw", F.sum("w").over(upto))
    out = out.alias("l").join(cells.alias("r"), same_keys([*gk, "__cell"])).select("l.*", "r.__oc", "r.__ow")
    return out.select(*keys, "v", "c", "w", (F.col("__oc") + F.col("__rc") - F.col("c")).alias("r0"),
                      (F.col("__ow") + F.col("__rw") - F.col("w")).alias("w0"), "n", "wn")


def group_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float],
                    cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name in `probs`."""
    r = value_ranks(df, keys, value, cell_rows=cell_rows)
    aggs, outs = [], []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        last = F.col("r0") + F.col("c") - 1
        aggs += [F.max(F.when((F.col("r0") <= lo) & (lo <= last), F.col("v"))).alias(f"__l_{name}"),
                 F.max(F.when((F.col("r0") <= hi) & (hi <= last), F.col("v"))).alias(f"__h_{name}"),
                 F.max(pos - lo).alias(f"__f_{name}")]
        outs.append((F.col(f"__l_{name}") + (F.col(f"__h_{name}") - F.col(f"__l_{name}"))
                     * F.col(f"__f_{name}")).alias(name))
    return r.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def weighted_median(df: DataFrame, keys: list[str], value: Column, weight: Column, out: str) -> DataFrame:
    """Smallest value whose cumulative weight reaches half of the total."""
    r = value_ranks(df, keys, value, weight)
    hit = F.col("w0") + F.col("w") >= 0.5 * F.col("wn")
    return r.groupBy(*keys).agg(F.min(F.when(hit, F.col("v"))).alias(out))


def with_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the average rank (ties share it) of `value` within its group, 1-based."""
    r = value_ranks(df, keys, F.col(value)).select(
        *keys, F.col("v").alias(value), (F.col("r0") + (F.col("c") + 1) / 2).alias(out))
    return df.join(r, [*keys, value])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """First k rows of each group; rows are first cut to k per salt, so a hot group is never sorted whole."""
    salted = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    w1 = W.partitionBy(*keys, "__s").orderBy(*order)
    w2 = W.partitionBy(*keys).orderBy(*order)
    cut = salted.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k)
    return (cut.withColumn("__r", F.row_number().over(w2)).where(F.col("__r") <= k)
            .drop("__s").withColumnRenamed("__r", "rank"))
