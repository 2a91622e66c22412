"""Sampling, folds, bootstrap, oracles and the evaluation harness."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .ordering import number_rows
from .quantiles import group_quantiles


def ranked(groups: DataFrame, order: Column, tie: str) -> DataFrame:
    """Whole-table rank (seq, n) of one row per group, without a single sorting task."""
    t = groups.withColumn("__one", F.lit(1)).withColumn("__o", order.cast("double"))
    return number_rows(t, ["__one"], "__o", tie).drop("__one", "__o", "order0")


def systematic_sample(groups: DataFrame, order: Column, tie: str, k: int) -> DataFrame:
    """k groups evenly spread over the ranking, the first and last included."""
    t = ranked(groups, order, tie)
    gap = (F.col("n") - 1) / F.lit(float(max(k - 1, 1)))
    near = F.round(F.when(gap > 0, F.col("seq") / gap).otherwise(F.lit(0.0)))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        hit = hit | ((i >= 0) & (i <= k - 1) & (F.bround(i * gap) == F.col("seq")))
    return t.where((F.col("n") <= k) | hit)


def folds(groups: DataFrame, order: Column, tie: str, k: int) -> DataFrame:
    """Fold number dealt round-robin along the ranking, so folds have alike sizes."""
    return ranked(groups, order, tie).withColumn("fold", F.col("seq") % k).drop("seq", "n")


#: Cumulative chances of 0, 1, 2, ... for the Poisson distribution with mean 1; beyond the last below 1e-12.
DRAW_CHANCES = [math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(15)]


def _uniform(rep: Column, idx: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of replicate and group; SQL can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", rep, idx).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _pooled(drawn: DataFrame, cols: list[str]) -> DataFrame:
    """RMSE per replicate of groups that count `__c` times each: sums meet in the map tasks, a row per replicate is shuffled."""
    n = F.sum(F.col("__c") * F.col("n"))
    return drawn.groupBy("rep").agg(*[F.sqrt(F.sum(F.col("__c") * F.col(c)) / n).alias(c) for c in cols])


def _replicates(sse: DataFrame, cols: list[str], draws: int) -> DataFrame:
    """Every group in every replicate with its number; the number is made in the generator, so it is made once."""
    each = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda r: F.struct(r.alias("rep"), _uniform(r.cast("string"), F.col("idx").cast("string")).alias("__u")))
    return sse.select("idx", "n", *cols, F.inline(each))


def bootstrap(sse: DataFrame, cols: list[str], draws: int) -> DataFrame:
    """Pooled RMSE per replicate of groups (idx, n, cols) drawn with replacement.

    Each group's number of draws is Poisson with mean 1, independent of the others and of their number, so no replicate
    is ever gathered; the number of groups in a replicate varies about its mean."""
    u = F.col("__u")
    count = sum((F.when(u >= c, 1).otherwise(0) for c in DRAW_CHANCES[1:]), F.when(u >= DRAW_CHANCES[0], 1).otherwise(0))
    return _pooled(_replicates(sse, cols, draws).withColumn("__c", count), cols)


def subsample(sse: DataFrame, cols: list[str], draws: int, size: int, ample: int = 4) -> DataFrame:
    """Pooled RMSE per replicate of `size` groups drawn without replacement: those with the smallest numbers.

    Only numbers up to the one below which `ample` times `size` groups are expected are sorted: where at least `size` lie
    below it, the smallest are among them.  A replicate with fewer is ranked whole."""
    order = Window.partitionBy("rep").orderBy("__u", "idx")
    every = _replicates(sse, cols, draws)
    near = F.col("__u") * F.lit(float(sse.count())) <= F.lit(float(ample * size))
    low = materialize(every.where(near), "low")
    enough = [r["rep"] for r in low.groupBy("rep").count().where(F.col("count") >= size).select("rep").collect()]  # at most one number a replicate
    taken = low.where(F.col("rep").isin(enough))
    if len(enough) < draws:
        taken = taken.unionByName(every.where(~F.col("rep").isin(enough)))
    return _pooled(taken.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size).withColumn("__c", F.lit(1)), cols)


def bootstrap_report(reps: DataFrame, model: str, base: str) -> DataFrame:
    """Mean, deviation and 95 % interval of a model, and how often it beats the base."""
    d = F.col(model) - F.col(base)
    a = reps.agg(F.avg(model).alias("mean"), F.stddev_pop(model).alias("sd"), F.avg(d).alias("delta"), F.stddev_pop(d).alias("sd_delta"),
                 F.avg((d < 0).cast("double")).alias("p_better")).withColumn("one", F.lit(1))
    q = group_quantiles(reps, [], F.col(model), {"lo": 0.025, "hi": 0.975}).withColumn("one", F.lit(1))
    return a.join(q, "one").drop("one")


def evaluate(wells: DataFrame, curves: DataFrame | None, fn: Callable[..., object], key: str = "well",
             max_rows: int = 2_000_000, leave_out: bool = False) -> DataFrame:
    """Run a user's predictor on every evaluable series as it would look at prediction time.

    `wells` has key, seq, tvt_input (null from the cut on), tvt and any visible columns.  fn(known, curve,
    series_id) gets pandas frames without `tvt` and returns one value per unknown row (or per row).  Only
    this callback sees whole series.  One above `max_rows` is an error, or with `leave_out` is left out and listed by
    `refused`, so the others have their results: use a DataFrame predictor and `score` for it.  Returns key, seq, pred."""
    import numpy as np
    cut = wells.groupBy(key).agg(F.min(F.when(F.col("tvt_input").isNull(), F.col("seq"))).alias("cut"), F.count(F.lit(1)).alias("n"))
    ok = cut.where((F.col("cut") >= 20) & (F.col("cut") < F.col("n")))
    if leave_out:
        ok = ok.where(F.col("n") <= max_rows)
    guard = F.when(F.col("n") <= max_rows, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("series too long for a callback: "), F.col(key).cast("string"))).cast("long"))
    shown = wells.drop("tvt").join(ok.select(key, guard.alias("__n")).where(F.col("__n") > 0).drop("__n"), key)
    kt = wells.schema[key].dataType.simpleString()

    def run(ids, known, curve):
        known = known.sort_values("seq").reset_index(drop=True)
        first = int(known["tvt_input"].isna().idxmax())
        pred = np.asarray(fn(known, curve, ids[0]), dtype=float)
        if len(pred) == len(known):
            pred = pred[first:]
        if len(pred) != len(known) - first:
            raise ValueError(f"{ids[0]}: {len(pred)} values for {len(known) - first} rows")
        if not np.isfinite(pred).all():
            raise ValueError(f"{ids[0]}: prediction is not finite")
        return pd.DataFrame({key: ids[0], "seq": known["seq"].to_numpy()[first:], "pred": pred})

    if curves is None:
        curves = wells.sparkSession.createDataFrame([], f"{key} {kt}")
    return shown.groupBy(key).cogroup(curves.groupBy(key)).applyInPandas(
        lambda ids, a, b: run(ids, a, b) if len(a) else pd.DataFrame({key: [], "seq": [], "pred": []}), f"{key} {kt}, seq long, pred double")


def refused(wells: DataFrame, key: str = "well", max_rows: int = 2_000_000) -> DataFrame:
    """key, n of the series that are too long for a callback."""
    return wells.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)


def score(truth: DataFrame, pred: DataFrame, key: str = "well") -> DataFrame:
    """Per-series n, sse, rmse of predictions (key, seq, pred) against truth (key, seq, tvt)."""
    e = F.col("tvt") - F.col("pred")
    g = truth.select(key, "seq", "tvt").join(pred, [key, "seq"]).groupBy(key).agg(F.count(F.lit(1)).alias("n_pred"), F.sum(e * e).alias("sse"))
    return g.withColumn("rmse", F.sqrt(F.col("sse") / F.col("n_pred")))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Two computations of one column: rows, largest difference, rows beyond tol, rows on one side only."""
    j = a.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__ha")).join(
        b.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__hb")), keys, "full_outer")
    d = F.abs(F.col("__a") - F.col("__b"))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.max(d).alias("max_diff"), F.count(F.when(d > tol, 1)).alias("beyond"),
                 F.count(F.when(F.col("__ha").isNull() | F.col("__hb").isNull(), 1)).alias("one_sided"))
