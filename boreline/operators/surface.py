"""Interpolation on neighbour rows: inverse distance, dispersion, local planes, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import clip
from ..functions.small_solve import solve3

FLOOR = 1e-3


def idw_weight(dist: Column, power: float, mode: str = "floor") -> Column:
    """1/max(d, 0.001)^p, or 1/(d^2 + 1e-6)."""
    if mode == "soft":
        return 1.0 / (dist * dist + 1e-6)
    return 1.0 / F.pow(F.greatest(dist, F.lit(FLOOR)), F.lit(float(power)))


def idw(nb: DataFrame, keys: list[str], values: list[str], power: float = 2.0, mode: str = "floor") -> DataFrame:
    """Weighted mean per query and value; a missing value leaves its own sum only."""
    w = idw_weight(F.col("dist"), power, mode)
    aggs = [(F.sum(w * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values]
    return nb.groupBy(*keys).agg(F.min("dist").alias("nn"), *aggs)


def dispersion(nb: DataFrame, keys: list[str], value: str, power: float = 2.0) -> DataFrame:
    """Weighted mean and weighted standard deviation of the neighbours."""
    w = F.when(F.col(value).isNotNull(), idw_weight(F.col("dist"), power))
    g = nb.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"),
                              (F.sum(w * F.col(value) * F.col(value)) / F.sum(w)).alias("__q"))
    return g.select(*keys, "mean", F.sqrt(F.greatest(F.col("__q") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def local_plane(nb: DataFrame, keys: list[str], value: str, lam: float, power: float = 2.0,
                limit: float | None = None) -> DataFrame:
    """Weighted plane through the neighbours (columns du, dv = offsets from the query) with ridge on the
    gradient.  Offsets are scaled by the mean distance of all neighbours of the query; lam -> infinity is
    plain inverse distance.  `limit` bounds the correction."""
    w = F.when(F.col(value).isNotNull(), idw_weight(F.col("dist"), power))
    a, b, z = F.col("du"), F.col("dv"), F.col(value)
    g = nb.groupBy(*keys).agg(
        F.greatest(F.avg(F.hypot(a, b)), F.lit(1e-6)).alias("h"), F.sum(w).alias("s"), F.sum(w * a).alias("a"),
        F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * a * b).alias("ab"), F.sum(w * b * b).alias("bb"),
        F.sum(w * z).alias("z"), F.sum(w * a * z).alias("az"), F.sum(w * b * z).alias("bz"))
    c = F.col
    h, s = c("h"), c("s")
    sol = solve3(F.lit(1.0), c("a") / h / s, c("b") / h / s, c("aa") / h / h / s + lam, c("ab") / h / h / s,
                 c("bb") / h / h / s + lam, c("z") / s, c("az") / h / s, c("bz") / h / s)
    base = c("z") / s
    out = sol[0] if limit is None else base + clip(sol[0] - base, -limit, limit)
    return g.select(*keys, base.alias("base"), F.coalesce(out, base).alias("plane"))


def neighbour_grid(nb: DataFrame, keys: list[str], value: str, ks: list[int], powers: list[float], lam: float,
                   limit: float | None = None) -> DataFrame:
    """keys, k, power, base, plane: inverse distance and local plane for every k and power, from one list of neighbours at the
    largest k (columns rank from 1, dist, du, dv).

    The sums of each power run along the ranks, so every k is a row of them; a query with fewer neighbours takes all it has.
    Sums over a list of at most max(ks) rows, nothing is searched or multiplied again per setting."""
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    v, a, b = F.col(value), F.col("du"), F.col("dv")
    cols = {"h": F.greatest(F.avg(F.hypot(a, b)).over(run), F.lit(1e-6))}
    for i, power in enumerate(powers):
        w = F.when(v.isNotNull(), idw_weight(F.col("dist"), power))
        for n, e in {"s": w, "a": w * a, "b": w * b, "aa": w * a * a, "ab": w * a * b, "bb": w * b * b, "z": w * v, "az": w * a * v, "bz": w * b * v}.items():
            cols[f"{n}{i}"] = F.sum(e).over(run)
    t = nb.where(F.col("rank") <= max(ks)).withColumn("__n", F.max("rank").over(Window.partitionBy(*keys)))
    own = F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: F.least(k, F.col("__n")) == F.col("rank"))
    t = t.select(*keys, "rank", own.alias("__k"), *[e.alias(n) for n, e in cols.items()]).where(F.size("__k") > 0).withColumn("k", F.explode("__k"))
    each = F.inline(F.array(*[F.struct(F.lit(float(power)).alias("power"), *[F.col(f"{n}{i}").alias(n) for n in ("s", "a", "b", "aa", "ab", "bb", "z", "az", "bz")])
                              for i, power in enumerate(powers)]))
    c = F.col
    t = t.select(*keys, "k", "h", each)
    h, s = c("h"), c("s")
    sol = solve3(F.lit(1.0), c("a") / h / s, c("b") / h / s, c("aa") / h / h / s + lam, c("ab") / h / h / s,
                 c("bb") / h / h / s + lam, c("z") / s, c("az") / h / s, c("bz") / h / s)
    base = c("z") / s
    out = sol[0] if limit is None else base + clip(sol[0] - base, -limit, limit)
    return t.select(*keys, "k", "power", base.alias("base"), F.coalesce(out, base).alias("plane"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them.  edges: a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, nodes: DataFrame, checkpoint) -> DataFrame:
    """Smallest reachable node per node (columns node, label), by large and small stars in turn until nothing changes.

    The rounds grow with the logarithm of the longest path and the edges never grow in number."""
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpoint(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(now)
    while was[0]:
        now = checkpoint(_small_star(_large_star(now)))
        is_ = mark(now)
        if is_ == was:
            break
        was = is_
    lab = now.select(F.col("a").alias("node"), F.col("b").alias("__l"))
    return nodes.select("node").join(lab.hint("merge"), "node", "left").select("node", F.coalesce("__l", "node").alias("label"))
