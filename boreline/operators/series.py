"""Ordered-series operators.  Input rows carry a series key and a 0-based `seq`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import fill_linear, framed, neighbours_known, running_sum


def cut_of(df: DataFrame, keys: list[str], known: str) -> DataFrame:
    """First row where `known` is null; the row count when there is none."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col(known).isNull(), F.col("seq"))), F.count(F.lit(1))).alias("cut"),
        F.count(F.lit(1)).alias("n"))


def in_last_known(n: int, cut: str = "cut") -> Column:
    """Predicate: one of the last n rows before the cut."""
    return (F.col("seq") < F.col(cut)) & (F.col("seq") >= F.col(cut) - n)


def step_distance(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Add `step` (0 on the first row) and the cumulative horizontal distance `hd`."""
    t = framed(df, keys, 1, lambda w: {
        "step": F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))})
    return running_sum(t, keys, {"hd": F.col("step")})


def gradient(df: DataFrame, keys: list[str], f: str, t: str, central: str, backward: str) -> DataFrame:
    """Second-order derivative on an uneven grid (one-sided at the ends) and the backward ratio."""
    def make(w):
        hp, hn = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
        dp, dn = F.col(f) - F.lag(f).over(w), F.lead(f).over(w) - F.col(f)
        mid = (dp / hp * hn + dn / hn * hp) / (hp + hn)
        return {central: F.coalesce(mid, dn / hn, dp / hp), backward: dp / hp}
    return framed(df, keys, 1, make)


def rolling(df: DataFrame, keys: list[str], v: str, radius: int, mean: str | None = None,
            std: str | None = None, median: str | None = None) -> DataFrame:
    """Centred rolling statistics over 2*radius+1 rows, shrinking at the ends."""
    def make(w):
        fr = w.rowsBetween(-radius, radius)
        out = {}
        if mean:
            out[mean] = F.avg(v).over(fr)
        if std:
            out[std] = F.stddev_samp(v).over(fr)
        if median:
            out[median] = F.percentile(F.col(v), F.lit(0.5)).over(fr)
        return out
    return framed(df, keys, radius, make)


def reanchor(df: DataFrame, keys: list[str], v: str, first_seq: Column, level: str, out: str) -> DataFrame:
    """Shift each series so that its row `first_seq` equals `level`."""
    first = df.groupBy(*keys).agg(F.max(F.when(F.col("seq") == first_seq, F.col(v))).alias("__v0"))
    return df.join(first, keys).withColumn(out, F.col(v) - F.col("__v0") + F.col(level)).drop("__v0")


def savgol(df: DataFrame, keys: list[str], v: str, pos: Column, n: Column, out: str,
           width: int = 17) -> DataFrame:
    """savgol_many of one column."""
    return savgol_many(df, keys, {out: v}, pos, n, width)


def _doubles(row: list[float]) -> str:
    return f"array({', '.join(f'{x!r}D' for x in row)})"


def _cubic_weights(m: int) -> list[list[float]]:
    """Per place -m .. m in a window of 2m+1 rows: what each row adds to the least-squares cubic there."""
    n0, k = 2.0 * m + 1, float(m * (m + 1))
    edge = (2.0 * m - 1) * (2.0 * m + 3)
    p2 = lambda u: u * u - k / 3
    p3 = lambda u: u * u * u - u * (3 * k - 1) / 5
    return [[1 / n0 + q * u * 3 / (k * n0) + p2(q) * p2(u) * 45 / (k * n0 * edge) + p3(q) * p3(u) * 175 / (k * n0 * edge * (m - 1) * (m + 2))
             for q in map(float, range(-m, m + 1))] for u in map(float, range(-m, m + 1))]


def savgol_many(df: DataFrame, keys: list[str], columns: dict[str, str], pos: Column, n: Column, width: int = 17) -> DataFrame:
    """columns (result: input), all in one pass of the frames.  Cubic least-squares smoothing.  `pos` is the 0-based position in a run of `n` rows.

    The window shrinks to the largest odd size that fits (values pass through
    below 5); edge rows take the value of the cubic fitted to the first or last
    window.  Weights come from the discrete orthogonal polynomials of degree 0-3."""
    half = width - 1
    t = df.withColumn("__i", pos).withColumn("__n", n)
    frames = {v: f"__a{i}" for i, v in enumerate(dict.fromkeys(columns.values()))}
    t = framed(t, keys, half, lambda w: {a: F.collect_list(v).over(w.rowsBetween(-half, half)) for v, a in frames.items()})
    wl = F.least(F.lit(width), F.when(F.col("__n") % 2 == 1, F.col("__n")).otherwise(F.col("__n") - 1))
    t = t.withColumn("__wl", wl.cast("int")).withColumn("__m", ((F.col("__wl") - 1) / 2).cast("int"))
    start = F.greatest(F.lit(0), F.least(F.col("__i") - F.col("__m"), F.col("__n") - F.col("__wl")))
    t = t.withColumn("__s", start).withColumn("__u", (F.col("__i") - start - F.col("__m")).cast("double"))
    first = F.greatest(F.lit(0), F.col("__i") - half)
    # The weights of a row are the same for every column, and one constant table of them serves all rows.
    table = F.expr(f"array({', '.join('array(' + ', '.join(_doubles(w) for w in _cubic_weights(m)) + ')' for m in range(2, width // 2 + 1))})")
    t = t.withColumn("__c", F.get(F.get(table, F.col("__m") - 2), (F.col("__u") + F.col("__m")).cast("int")))

    def smooth(v):
        seg = F.slice(frames[v], (F.col("__s") - first + 1).cast("int"), F.greatest(F.col("__wl"), F.lit(1)))
        return F.aggregate(F.zip_with(seg, F.col("__c"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    t = t.withColumns({out: F.when(F.col("__wl") >= 5, smooth(v)).otherwise(F.col(v)) for out, v in columns.items()})
    return t.drop("__i", "__n", "__wl", "__m", "__s", "__u", "__c", *frames.values())


def gaussian_lowpass(df: DataFrame, keys: list[str], v: str, sigma: float, out: str) -> DataFrame:
    """Gaussian smoothing in row index, truncated at 4 sigma, end values repeated."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    wt = F.array(*[F.lit(x / sum(raw)) for x in raw])

    def make(w):
        return {"__a": F.collect_list(v).over(w.rowsBetween(-r, r)),
                "__before": F.count(F.lit(1)).over(w.rowsBetween(-r, -1))}

    t = framed(df, keys, r, make)
    last = F.size("__a") - 1

    def term(x, k):
        at = F.greatest(F.lit(0), F.least(last, k + F.col("__before").cast("int") - r))
        return x * F.get(F.col("__a"), at)

    total = F.aggregate(F.transform(wt, term), F.lit(0.0), lambda a, b: a + b)
    return t.withColumn(out, total).drop("__a", "__before")


def jumps(df: DataFrame, keys: list[str], v: str, lag: int, threshold: float) -> DataFrame:
    """Add `jump` = |v[i+lag]-v[i]| and `starts` (1 where a run of jumps above the threshold begins)."""
    t = framed(df, keys, lag, lambda w: {"jump": F.abs(F.lead(v, lag).over(w) - F.col(v))})
    t = t.withColumn("__hit", F.coalesce(F.col("jump") > threshold, F.lit(False)).cast("int"))
    return framed(t, keys, lag, lambda w: {
        "starts": F.when((F.col("__hit") == 1) & (F.coalesce(
            F.max("__hit").over(w.rowsBetween(-lag, -1)), F.lit(0)) == 0), 1).otherwise(0)}).drop("__hit")


def curvature(df: DataFrame, keys: list[str], x: str, y: str, min_step: float, min_len: float = 100.0) -> DataFrame:
    """Turning per series in degrees per 100 units; steps up to `min_step` are skipped."""
    t = framed(df, keys, 1, lambda w: {
        "__dx": F.col(x) - F.lag(x).over(w), "__dy": F.col(y) - F.lag(y).over(w)})
    t = t.withColumn("__st", F.hypot("__dx", "__dy"))
    t = t.withColumn("__az", F.when(F.col("__st") > min_step, F.atan2("__dy", "__dx")))
    t = neighbours_known(t, keys, "__az").drop("next")
    t = framed(t, keys, 1, lambda w: {"__paz": F.lag(F.col("prev")["v"]).over(w)})
    d = F.abs(F.col("__az") - F.col("__paz"))
    turn = F.when(d > math.pi, 2 * math.pi - d).otherwise(d)
    a = t.groupBy(*keys).agg(F.count("__az").alias("__k"), F.sum(turn).alias("__t"),
                             F.sum(F.when(F.col("__az").isNotNull(), F.col("__st"))).alias("__d"))
    ok = (F.col("__k") >= 5) & (F.col("__d") >= min_len)
    return a.select(*keys, F.when(ok, F.coalesce(F.col("__t"), F.lit(0.0)) * 180 / math.pi / (F.col("__d") / 100))
                    .otherwise(F.lit(0.0)).alias("curvature"))


def resample(df: DataFrame, keys: list[str], at: str, values: list[str], step: float) -> DataFrame:
    """Values on the grid of multiples of `step` between the first and last position.

    Every segment between neighbouring rows emits its own grid points, so no join is needed."""
    def make(w):
        out = {"__k1": F.lead(at).over(w)}
        out.update({f"__n_{v}": F.lead(v).over(w) for v in values})
        return out
    t = framed(df, keys, 1, make)
    lo = F.ceil(F.col(at) / step)
    hi = F.when(F.col("__k1").isNull(), F.floor(F.col(at) / step)).otherwise(F.ceil(F.col("__k1") / step) - 1)
    t = t.where(hi >= lo).withColumn("g", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    f = F.when(F.col("__k1") > F.col(at), (F.col("g") * step - F.col(at)) / (F.col("__k1") - F.col(at))).otherwise(F.lit(0.0))
    return t.select(*keys, "g", *[
        F.coalesce(F.col(v) + (F.col(f"__n_{v}") - F.col(v)) * f, F.col(v)).alias(v) for v in values])


def decimate_refill(df: DataFrame, keys: list[str], v: str, pos: Column, step: int, out: str) -> DataFrame:
    """Keep every step-th value, interpolate the rest in row index."""
    t = df.withColumn("__d", F.when(F.pmod(pos, F.lit(step)) == 0, F.col(v)))
    return fill_linear(t, keys, "__d", out).drop("__d")

