"""Error tables, binned curves, correlations and ensemble reducers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cols import bin_centers, clip, digitize
from .quantiles import group_quantiles, value_ranks

#: Added before likelihoods are rounded for ranks: averages of two-decimal values often end half way between two roundings.
TIE_NUDGE = 3.3e-9


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows without a join."""
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*ids, F.inline(items))


def sse_table(df: DataFrame, keys: list[str], y: str, preds: list[str]) -> DataFrame:
    """Squared error sums and row count per group, one pass for all predictions."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
        F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias(f"sse_{p}") for p in preds])


def pooled(sse: DataFrame, preds: list[str], where: Column | None = None) -> DataFrame:
    """Pooled RMSE per prediction from a table of (n, sse_*)."""
    keep = F.lit(True) if where is None else where
    w = sse.agg(F.sum(F.when(keep, F.col("n"))).alias("n"), F.count(F.when(keep, 1)).alias("groups"), *[
        F.sum(F.when(keep, F.col(f"sse_{p}"))).alias(p) for p in preds])
    return unpivot(w, ["n", "groups"], preds, "pred", "sse").withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))


def binned_rms(df: DataFrame, x: Column, e2: Column, edges: list[float], min_count: int) -> DataFrame:
    """RMS per [lo,hi) bin; bins with at most `min_count` rows take the nearest filled bin (lower on ties)."""
    g = (df.select(digitize(x, edges).alias("bin"), e2.alias("__e")).where(F.col("bin").isNotNull())
         .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("__e")).alias("rms")))
    row = g.agg(F.collect_list(F.struct("bin", "n", "rms")).alias("__a"))
    nb, ctr = len(edges) - 1, bin_centers(edges)
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(ctr[i]).alias("center")) for i in range(nb)])
    t = row.select("__a", F.inline(bins))
    good = F.filter("__a", lambda s: s["n"] > min_count)
    near = F.array_min(F.transform(good, lambda s: F.struct(
        F.abs(s["bin"] - F.col("bin")).alias("d"), s["bin"].alias("b"), s["rms"].alias("rms"))))
    own = F.get(F.filter("__a", lambda s: s["bin"] == F.col("bin")), F.lit(0))
    return t.select("bin", "center", F.coalesce(own["n"], F.lit(0)).alias("n"), near["rms"].alias("sigma"))


def clipped_bin(x: Column, edges: list[float]) -> Column:
    """Bin number with values outside the edges put into the end bins."""
    out = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 2)):
        out = F.when(x < float(edges[i + 1]), F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def binned_rms_2d(df: DataFrame, xr: Column, xc: Column, e2: Column, er: list[float], ec: list[float],
                  sigma_rows: DataFrame, min_count: int) -> DataFrame:
    """RMS on a grid of bins; thin cells take row sigma times the marginal ratio of their column."""
    g = df.select(clipped_bin(xr, er).alias("r"), clipped_bin(xc, ec).alias("c"), e2.alias("__e"))
    g = g.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("__e").alias("ss"))
    rows = sigma_rows.select(F.col("bin").alias("r"), F.col("sigma").alias("s1"))
    full = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(ec) - 2))))
    t = full.join(g, ["r", "c"], "left").fillna({"n": 0, "ss": 0.0})
    m = t.groupBy("c").agg(F.sum("n").alias("__n"), F.sum("ss").alias("__s"),
                           F.sum(F.col("n") * F.col("s1") * F.col("s1")).alias("__p"))
    m = m.select("c", F.when((F.col("__n") >= min_count) & (F.col("__p") > 0), F.sqrt(F.col("__s") / F.col("__p")))
                 .otherwise(1.0).alias("ratio"))
    t = t.join(m, "c")
    raw = F.when(F.col("n") >= min_count, F.sqrt(F.col("ss") / F.greatest(F.col("n"), F.lit(1))))
    mult = F.col("s1") * F.col("ratio")
    return t.select("r", "c", "n", "ratio", mult.alias("mult"), F.coalesce(raw, mult).alias("sigma"))


def pair_correlations(df: DataFrame, keys: list[str], cols: dict[str, Column], min_count: int = 2) -> DataFrame:
    """Correlation of every pair of columns per group, long form (a, b, rho); null below `min_count` rows."""
    t = df.select(*keys, *[e.alias(n) for n, e in cols.items()])
    pairs = list(combinations(cols, 2))
    g = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])
    t = g.select(*keys, "n", F.inline(items))
    return t.withColumn("rho", F.when((F.col("n") >= min_count) & ~F.isnan("rho"), F.col("rho")))


def error_by_bins(df: DataFrame, e: Column, bin_: Column) -> DataFrame:
    """Rows, share of rows, RMSE, bias and share of squared error per bin."""
    g = (df.select(bin_.alias("bin"), e.alias("__e")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("ss"), F.avg("__e").alias("bias")))
    tot = g.agg(F.sum("n").alias("__n"), F.sum("ss").alias("__s")).withColumn("__one", F.lit(1))
    t = g.withColumn("__one", F.lit(1)).join(tot, "__one")
    return t.select("bin", "n", (F.col("n") / F.col("__n")).alias("share"), F.sqrt(F.col("ss") / F.col("n")).alias("rmse"),
                    "bias", (F.col("ss") / F.col("__s")).alias("share_sse"))


def quantile_bin(df: DataFrame, x: str, probs: list[float], out: str) -> DataFrame:
    """Bin by exact pooled quantiles, (lo,hi]: number of inner edges below the value."""
    names = {f"__q{i}": p for i, p in enumerate(probs)}
    q = group_quantiles(df, [], F.col(x), names).withColumn("__one", F.lit(1))
    t = df.withColumn("__one", F.lit(1)).join(q, "__one")
    b = sum(((F.col(x) > F.col(n)).cast("int") for n in names), F.lit(0))
    return t.withColumn(out, b).drop("__one", *names)


def spearman(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rank correlation of pooled columns with average ranks for ties; all columns are ranked in one pass."""
    cols = sorted({c for p in pairs for c in p})
    long = unpivot(df, [key], cols, "col", "v").withColumn("v", F.col("v") + F.lit(0.0))
    r = value_ranks(long, ["col"], F.col("v")).select("col", "v", (F.col("r0") + (F.col("c") + 1) / 2).alias("r"))
    wide = long.join(r, ["col", "v"]).groupBy(key).agg(*[
        F.max(F.when(F.col("col") == c, F.col("r"))).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])
    return wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).select(F.inline(items))


def partial_corr(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """Correlation of x and y with the linear effect of z removed from both."""
    g = df.agg(F.corr(x, y).alias("rxy"), F.corr(x, z).alias("rxz"), F.corr(y, z).alias("ryz"))
    den = F.sqrt((1 - F.col("rxz") ** 2) * (1 - F.col("ryz") ** 2))
    return g.withColumn("partial", F.when(den > 0, (F.col("rxy") - F.col("rxz") * F.col("ryz")) / den))


def null_census(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Per column: rows, nulls, groups with a null, groups that are null throughout."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[
        F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    a = g.agg(F.sum("__n").alias("rows"), *[F.sum(c).alias(f"{c}_n") for c in cols],
              *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_s") for c in cols],
              *[F.count(F.when(F.col(c) == F.col("__n"), 1)).alias(f"{c}_w") for c in cols])
    return a.select("rows", F.inline(F.array(*[F.struct(
        F.lit(c).alias("col"), F.col(f"{c}_n").alias("nulls"), F.col(f"{c}_s").alias("groups_some"),
        F.col(f"{c}_w").alias("groups_all")) for c in cols])))


def principal_direction(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Angle of the first principal axis per group, in (-pi/2, pi/2]."""
    g = df.groupBy(*keys).agg(F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    return g.select(*keys, (0.5 * F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy"))).alias("theta"),
                    (0.5 * (F.col("vx") + F.col("vy") + F.hypot(F.col("vx") - F.col("vy"), 2 * F.col("cxy")))).alias("major"))


def chord_direction(df: DataFrame, keys: list[str], x: str, y: str, order: Column) -> DataFrame:
    """Angle from the first to the last point of each group; 0 where they coincide."""
    at = F.struct(order.alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))
    g = df.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return g.select(*keys, F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")).alias("theta"))


def ensemble_weights(ll: DataFrame, keys: list[str], scales: list[float], beta: float) -> DataFrame:
    """Member weights per group from log-likelihoods: softmax at each scale averaged, softmax at
    beta times the spread (equal when the spread is 0), and the rank by likelihood (lowest member
    first where likelihoods agree to 8 digits; sums of two-decimal values differ by the order of addition only)."""
    st = ll.groupBy(*keys).agg(F.max("ll").alias("__mx"), F.stddev_pop("ll").alias("__sd"), F.count(F.lit(1)).alias("__k"))
    t = ll.join(st, keys)
    d = F.col("ll") - F.col("__mx")
    for i, s in enumerate(scales):
        t = t.withColumn(f"__e{i}", F.exp(clip(d / float(s), -700, 0)))
    t = t.withColumn("__ea", F.when(F.col("__sd") > 0, F.exp(clip(d / (beta * F.col("__sd")), -700, 0))).otherwise(1.0))
    sums = t.groupBy(*keys).agg(*[F.sum(f"__e{i}").alias(f"__s{i}") for i in range(len(scales))], F.sum("__ea").alias("__sa"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round(F.col("ll") + TIE_NUDGE, 8)), "seed"))
    t = t.withColumn("rank", rank).join(sums, keys)
    multi = sum((F.col(f"__e{i}") / F.col(f"__s{i}") for i in range(len(scales))), F.lit(0.0)) / len(scales)
    return t.select(*keys, "seed", "ll", "rank", (F.col("__e0") / F.col("__s0")).alias("w_soft"), multi.alias("w_multi"),
                    (F.col("__ea") / F.col("__sa")).alias("w_adapt"))
