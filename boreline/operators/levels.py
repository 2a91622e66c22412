"""Robust levels and trends over any number of rows of a series, as rounds of aggregates.

`calibrate` has the same estimators for short tails, inside one row per series.  Here the rows stay rows: medians come from
counted values (`quantiles`), fits from sums, and what a round hands to the next is one written row per series.  Rounds end
when no series moves any more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.small_solve import solve_definite
from ..sources.store import materialize
from .ordering import largest
from .quantiles import group_quantiles, weighted_median

#: Up to this many rows of every series a round takes its medians in one window, which needs no counted values.
WINDOW_ROWS = 100_000

#: Huber's constant, and the ratio of a normal deviation to its median absolute one.
HUBER, MAD = 1.345, 1.4826


def _scale(dev: Column) -> Column:
    return HUBER * (MAD * dev + 1e-9)


def _rounds(rows: DataFrame, keys: list[str], state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int) -> DataFrame:
    """state: keys, its values, done.  step gives the next state of the series that are not done."""
    state = materialize(state, "state")
    for _ in range(rounds):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        new = step(rows, open_)
        state = materialize(state.where("done").unionByName(new), "state")
    return state.drop("done")


def _short(rows: DataFrame, keys: list[str]) -> bool:
    return largest(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "n") <= WINDOW_ROWS


def _with_median(rows: DataFrame, keys: list[str], value: Column, out: str, short: bool) -> DataFrame:
    """rows with the median of `value` in their series."""
    if short:
        return rows.withColumn(out, F.median(value).over(W.partitionBy(*keys)))
    return rows.join(group_quantiles(rows, keys, value, {out: 0.5}), keys)


def robust_levels(df: DataFrame, keys: list[str], value: Column, weight: Column, order: str = "seq", rounds: int = 15) -> DataFrame:
    """Weighted median, mean, 10 % trimmed mean, Huber location (from the weighted median, until it moves less than 1e-6) and last
    value.  Rows without a value go."""
    t = df.select(*keys, F.col(order).alias("__i"), value.cast("double").alias("__v"), weight.cast("double").alias("__w")).where(F.col("__v").isNotNull())
    t = materialize(t, "tail")
    v, w = F.col("__v"), F.col("__w")
    start = materialize(weighted_median(t, keys, v, w, "wmedian"), "medians")
    cuts = group_quantiles(t, keys, v, {"__lo": 0.1, "__hi": 0.9})
    kept = (v >= F.col("__lo")) & (v <= F.col("__hi"))
    sums = t.join(cuts, keys).groupBy(*keys).agg(
        (F.sum(v * w) / F.sum(w)).alias("mean"), (F.sum(F.when(kept, v * w)) / F.sum(F.when(kept, w))).alias("trim10"), F.max_by("__v", "__i").alias("last"))

    short = _short(t, keys)

    def step(rows: DataFrame, state: DataFrame) -> DataFrame:
        cur = _with_median(rows.join(state.drop("done"), keys), keys, F.abs(v - F.col("c")), "__d", short)
        k = _scale(F.col("__d"))
        ww = w * F.least(F.lit(1.0), k / F.greatest(F.abs(v - F.col("c")), F.lit(1e-12)))
        g = cur.groupBy(*keys).agg(F.first("c").alias("__c"), (F.sum(v * ww) / F.sum(ww)).alias("__n"))
        still = F.abs(F.col("__n") - F.col("__c")) < 1e-6
        return g.select(*keys, F.when(still, F.col("__c")).otherwise(F.col("__n")).alias("c"), still.alias("done"))

    huber = _rounds(t, keys, start.select(*keys, F.col("wmedian").alias("c"), F.lit(False).alias("done")), step, rounds).withColumnRenamed("c", "huber")
    return start.join(sums, keys).join(huber, keys).select(*keys, "wmedian", "mean", "trim10", "huber", "last")


def huber_trend(df: DataFrame, keys: list[str], y: Column, terms: list[Column], weight: Column | None = None, rounds: int = 20, ridge: float = 0.0) -> DataFrame:
    """keys, b0 (intercept), b1, b2 ...: weighted least squares, then Huber weights until the coefficients move less than 1e-8.

    The scale is 1.4826 times the median absolute residual, not centred.  ridge is added to the squares of the terms, not
    of the intercept.  Up to five terms; null where the sums are singular."""
    p = len(terms) + 1
    cols = [f"__x{i}" for i in range(1, p)]
    w0 = F.lit(1.0) if weight is None else weight
    t = materialize(df.select(*keys, y.cast("double").alias("__y"), w0.cast("double").alias("__w"), *[e.cast("double").alias(c) for e, c in zip(terms, cols)]), "tail")
    x = [F.lit(1.0), *[F.col(c) for c in cols]]
    names = [f"b{i}" for i in range(p)]

    def fit(rows: DataFrame, w: Column) -> DataFrame:
        sums = [F.sum(w * x[i] * x[j]).alias(f"__a{i}_{j}") for i in range(p) for j in range(i + 1)] + [F.sum(w * x[i] * F.col("__y")).alias(f"__r{i}") for i in range(p)]
        g = rows.groupBy(*keys).agg(*sums)
        if ridge:
            g = g.withColumns({f"__a{i}_{i}": F.col(f"__a{i}_{i}") + ridge for i in range(1, p)})
        return solve_definite(g, [[f"__a{i}_{j}" for j in range(i + 1)] for i in range(p)], [f"__r{i}" for i in range(p)], names).select(*keys, *names)

    short = _short(t, keys)

    def step(rows: DataFrame, state: DataFrame) -> DataFrame:
        value = F.col("b0")
        for i, c in enumerate(cols):
            value = value + F.col(f"b{i + 1}") * F.col(c)
        cur = rows.join(state.drop("done"), keys).withColumn("__r", F.abs(F.col("__y") - value))
        cur = _with_median(cur, keys, F.col("__r"), "__d", short)
        ww = F.col("__w") * F.least(F.lit(1.0), _scale(F.col("__d")) / F.greatest(F.col("__r"), F.lit(1e-12)))
        new = fit(cur.drop(*names), ww).withColumnsRenamed({n: f"__{n}" for n in names})
        both = state.drop("done").join(new, keys, "left")
        move = F.greatest(*[F.abs(F.col(f"__{n}") - F.col(n)) for n in names], F.lit(0.0))
        bad = F.col(f"__{names[-1]}").isNull()
        return both.select(*keys, *[F.when(bad, F.col(n)).otherwise(F.col(f"__{n}")).alias(n) for n in names], (bad | (move < 1e-8)).alias("done"))

    first = fit(t, F.col("__w"))
    return _rounds(t, keys, first.withColumn("done", F.col(names[-1]).isNull()), step, rounds - 1)


def theil_sen(df: DataFrame, keys: list[str], x: Column, y: Column, at: Column, rows: Column, points: int = 120, min_gap: float = 50.0, limit: float = 0.5) -> DataFrame:
    """Clipped median of the slopes between `points` rows taken at even steps of a tail of any length; pairs no farther apart than
    min_gap do not count.  at: a row's place in the tail from 0; rows: the tail's length.  What is gathered per series is
    `points` rows at most, which is the estimator's own definition."""
    step = F.ceil(rows / points)
    thin = df.where(F.pmod(at, step) == 0).select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b = (thin.select(*keys, F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}")) for s in "ab")
    pairs = a.join(b, keys).where(F.col("xb") - F.col("xa") > min_gap)
    slopes = group_quantiles(pairs, keys, (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa")), {"slope": 0.5})
    out = df.select(*keys).distinct().join(slopes, keys, "left")
    return out.select(*keys, F.when(F.col("slope").isNull(), 0.0).otherwise(F.least(F.greatest(F.col("slope"), F.lit(-limit)), F.lit(limit))).alias("slope"))


def guarded_slope(df: DataFrame, keys: list[str], x: Column, y: Column, at: Column, rows: Column, points: int = 150, min_rows: int = 20,
                  min_extent: float = 100.0, limit: float = 0.006) -> DataFrame:
    """theil_sen over all pairs of the thinned tail; 0 for a tail with fewer than min_rows of its points or no more than min_extent in x."""
    kept = F.pmod(at, F.ceil(rows / points)) == 0
    wide = (F.count(F.when(kept, x)) >= min_rows) & (F.max(F.when(kept, x)) - F.min(F.when(kept, x)) > min_extent)
    ok = df.groupBy(*keys).agg(wide.alias("__ok"))
    s = theil_sen(df, keys, x, y, at, rows, points, 0.0, limit).join(ok, keys)
    return s.select(*keys, F.when(F.col("__ok"), F.col("slope")).otherwise(0.0).alias("slope"))


def damped(far: Column, slope: Column, reach: float) -> dict[str, Column]:
    """What a slope adds at a distance: `lin` dies away again, `sat` tends to slope * reach."""
    return {"lin": slope * far * F.exp(-far / reach), "sat": slope * reach * (1 - F.exp(-far / reach))}
