"""Levels, lines and noise estimates per series.

Fits over any number of rows are sums.  Estimators that need order statistics on
every round work on the last rows before the cut only: that tail has a fixed
length, so it is gathered as one short array per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import clip
from ..functions.small_solve import solve2, solve3


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(arr: Column, fn) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + fn(e))


def _median(arr: Column) -> Column:
    return let(F.array_sort(arr), lambda a: (
        F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2)


def _quantile(sorted_arr: Column, p: float) -> Column:
    pos = (F.size(sorted_arr) - 1) * F.lit(p)
    lo = F.get(sorted_arr, F.floor(pos).cast("int"))
    hi = F.get(sorted_arr, F.ceil(pos).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


def tail_arrays(df: DataFrame, keys: list[str], rows: int, fields: dict[str, Column], cut: str = "cut",
                seq: str = "seq") -> DataFrame:
    """One row per series with `tail`: array of structs of its last `rows` known rows, in order.  A row is as long as the tail that
    is asked for; `levels` has the same estimators for tails of any length."""
    t = df.where((F.col(seq) < F.col(cut)) & (F.col(seq) >= F.col(cut) - rows))
    st = F.struct(F.col(seq).alias("i"), *[e.cast("double").alias(n) for n, e in fields.items()])
    return t.groupBy(*keys).agg(F.array_sort(F.collect_list(st)).alias("tail"))


def robust_levels(tails: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted median, mean, 10 % trimmed mean, Huber location and last value of `tail` (fields v, w)."""
    a = F.col("tail")
    by_v = F.array_sort(F.transform(a, lambda e: F.struct(e["v"].alias("v"), e["w"].alias("w"))))
    total = _sum(a, lambda e: e["w"])
    half = F.aggregate(
        by_v, F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m")),
        lambda s, e: F.struct((s["c"] + e["w"]).alias("c"),
                              F.coalesce(s["m"], F.when(s["c"] + e["w"] >= F.col("__tw") * 0.5, e["v"])).alias("m")))
    t = tails.withColumn("__tw", total).withColumn("wmedian", half["m"])
    t = t.withColumn("mean", _sum(a, lambda e: e["v"] * e["w"]) / F.col("__tw"))
    vs = F.array_sort(F.transform(a, lambda e: e["v"]))
    t = t.withColumn("__lo", let(vs, lambda x: _quantile(x, 0.1))).withColumn("__hi", let(vs, lambda x: _quantile(x, 0.9)))
    kept = F.filter(a, lambda e: (e["v"] >= F.col("__lo")) & (e["v"] <= F.col("__hi")))
    t = t.withColumn("trim10", let(kept, lambda x: _sum(x, lambda e: e["v"] * e["w"]) / _sum(x, lambda e: e["w"])))

    def round_(s, _):
        dev = _median(F.transform(F.col("tail"), lambda e: F.abs(e["v"] - s["c"])))
        def step(k):
            def w(e):
                return e["w"] * F.least(F.lit(1.0), k / F.greatest(F.abs(e["v"] - s["c"]), F.lit(1e-12)))
            new = _sum(F.col("tail"), lambda e: e["v"] * w(e)) / _sum(F.col("tail"), w)
            return let(new, lambda c: F.struct(
                F.when(s["done"] | (F.abs(c - s["c"]) < 1e-6), s["c"]).otherwise(c).alias("c"),
                (s["done"] | (F.abs(c - s["c"]) < 1e-6)).alias("done")))
        return F.when(s["done"], s).otherwise(let(1.345 * (1.4826 * dev + 1e-9), step))

    hub = F.aggregate(F.sequence(F.lit(1), F.lit(15)),
                      F.struct(F.col("wmedian").alias("c"), F.lit(False).alias("done")), round_)
    t = t.withColumn("huber", hub["c"])
    t = t.withColumn("last", F.element_at(a, -1)["v"])
    return t.select(*keys, "wmedian", "mean", "trim10", "huber", "last")


def affine(df: DataFrame, keys: list[str], y: Column, x: Column, min_pairs: int = 40,
           lo: float = 5.0, hi: float = 60.0) -> DataFrame:
    """y ~ a*x+b per series with residual deviation clipped to [lo, hi]; a=1, b=0 below `min_pairs`."""
    ok = x.isNotNull() & y.isNotNull()
    yy, xx = F.when(ok, y), F.when(ok, x)
    g = df.groupBy(*keys).agg(F.count(yy).alias("pairs"), F.regr_slope(yy, xx).alias("__a"),
                              F.regr_intercept(yy, xx).alias("__b"), F.regr_syy(yy, xx).alias("__syy"),
                              F.regr_sxy(yy, xx).alias("__sxy"))
    good = (F.col("pairs") >= min_pairs) & F.col("__a").isNotNull()
    sse = F.greatest(F.col("__syy") - F.col("__a") * F.col("__sxy"), F.lit(0.0))
    return g.select(*keys, "pairs", F.when(good, F.col("__a")).otherwise(1.0).alias("a"),
                    F.when(good, F.col("__b")).otherwise(0.0).alias("b"),
                    F.when(good, clip(F.sqrt(sse / F.col("pairs")), lo, hi)).alias("sigma"))


def noise_sigma(df: DataFrame, keys: list[str], resid: Column, lo: float = 20.0, hi: float = 120.0,
                default: float = 30.0, min_pairs: int = 20) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(resid).alias("pairs"), F.stddev_pop(resid).alias("__s"))
    return g.select(*keys, "pairs", F.when(F.col("pairs") >= min_pairs, clip(F.col("__s"), lo, hi))
                    .otherwise(default).alias("sigma"))


def weighted_line(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least-squares intercept and slope per group."""
    g = df.groupBy(*keys).agg(F.sum(w).alias("s0"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"),
                              F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"))
    b = solve2(F.col("s0"), F.col("sx"), F.col("sxx"), F.col("sy"), F.col("sxy"))
    return g.select(*keys, b[0].alias("icpt"), b[1].alias("slope"))


def parabola(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column | None = None,
             names: tuple[str, str, str] = ("c0", "c1", "c2")) -> DataFrame:
    """Degree-2 least squares per group from power sums (weights enter once)."""
    w = F.lit(1.0) if w is None else w
    x2 = x * x
    g = df.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in {
        "a0": w, "a1": w * x, "a2": w * x2, "a3": w * x2 * x, "a4": w * x2 * x2,
        "b0": w * y, "b1": w * x * y, "b2": w * x2 * y}.items()])
    c = F.col
    sol = solve3(c("a0"), c("a1"), c("a2"), c("a2"), c("a3"), c("a4"), c("b0"), c("b1"), c("b2"))
    return g.select(*keys, *[s.alias(n) for s, n in zip(sol, names)])


def theil_sen(tails: DataFrame, keys: list[str], every: int, min_gap: float, limit: float) -> DataFrame:
    """Median of pairwise slopes of a thinned tail (fields x, y), pairs closer than `min_gap` left out.

    The tail is bounded and the pairs exist only inside the expression of its own row."""
    thin = F.filter(F.col("tail"), lambda e, i: F.pmod(i, F.lit(every)) == 0)
    t = tails.withColumn("__t", thin)

    def slopes(p, i):
        later = F.slice(F.col("__t"), i + 2, F.size("__t"))
        return F.array_compact(F.transform(later, lambda q: F.when(
            F.abs(q["x"] - p["x"]) > min_gap, (q["y"] - p["y"]) / (q["x"] - p["x"]))))

    return t.select(*keys, F.coalesce(clip(_median(F.flatten(F.transform("__t", slopes))), -limit, limit),
                                      F.lit(0.0)).alias("slope"))


def huber_trend(tails: DataFrame, keys: list[str], terms: list[str], rounds: int = 20, ridge: float = 0.0,
                robust: bool = True) -> DataFrame:
    """Intercept plus one or two slopes on the tail (fields y, w and `terms`), Huber weights applied once.

    The scale is 1.4826 * median|r| (not centred).  Stops when the coefficients move less than 1e-8."""
    a = F.col("tail")
    p = len(terms)

    def fit(wt):
        xs = [lambda e, t=t: e[t] for t in terms]
        s0, sy = _sum(a, wt), _sum(a, lambda e: wt(e) * e["y"])
        sx = [_sum(a, lambda e, x=x: wt(e) * x(e)) for x in xs]
        sxy = [_sum(a, lambda e, x=x: wt(e) * x(e) * e["y"]) for x in xs]
        sxx = [[_sum(a, lambda e, x=x, z=z: wt(e) * x(e) * z(e)) for z in xs] for x in xs]
        g = {"s0": s0, "sy": sy}
        for i in range(p):
            g[f"x{i}"], g[f"y{i}"] = sx[i], sxy[i]
            for j in range(i, p):
                g[f"q{i}{j}"] = sxx[i][j] + (ridge if i == j else 0.0)
        st = F.struct(*[e.alias(n) for n, e in g.items()])
        if p == 1:
            return let(st, lambda s: F.array(*solve2(s["s0"], s["x0"], s["q00"], s["sy"], s["y0"])))
        return let(st, lambda s: F.array(*solve3(s["s0"], s["x0"], s["x1"], s["q00"], s["q01"], s["q11"],
                                                 s["sy"], s["y0"], s["y1"])))

    def at(b, e):
        out = F.get(b, F.lit(0))
        for i, t in enumerate(terms):
            out = out + F.get(b, F.lit(i + 1)) * e[t]
        return out

    start = fit(lambda e: e["w"])
    if not robust:
        return tails.select(*keys, start.alias("beta"))

    def round_(s, _):
        dev = _median(F.transform(a, lambda e: F.abs(e["y"] - at(s["b"], e))))
        def step(k):
            new = fit(lambda e: e["w"] * F.least(F.lit(1.0), k / F.greatest(
                F.abs(e["y"] - at(s["b"], e)), F.lit(1e-12))))
            def settle(b):
                move = F.greatest(*[F.abs(F.get(b, F.lit(i)) - F.get(s["b"], F.lit(i))) for i in range(p + 1)])
                return F.struct(b.alias("b"), (move < 1e-8).alias("done"))
            return let(new, settle)
        return F.when(s["done"], s).otherwise(let(1.345 * (1.4826 * dev + 1e-9), step))

    out = F.aggregate(F.sequence(F.lit(2), F.lit(rounds)),
                      F.struct(start.alias("b"), F.lit(False).alias("done")), round_)
    return tails.select(*keys, out["b"].alias("beta"))
