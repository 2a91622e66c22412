"""Fusion of candidate predictions: weights from curves, moments, backtests and small solves."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import add, bin_centers, clip, curve_value, row_mean, row_median, softmax
from ..functions.small_solve import solve2, solve3, solve_definite

W_MIN, W_MAX = 0.05, 0.9

# Published error curves (bin edges and deviation per bin), by neighbour distance and by depth.
NN_BINS = [0, 50, 100, 200, 300, 450, 600, 800, 1000, 1500, 2500, 1e9]
MD_BINS = [0, 250, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7000, 1e9]
SIGMA_NN = [8.89919702, 9.37233619, 8.43532995, 7.87490051, 8.99296893, 11.0666257, 11.19150053, 13.82662369,
            13.9339494, 27.2295968, 50.79014789]
SIGMA_MD = [2.09432202, 4.53292334, 6.81320383, 8.70951537, 10.5740661, 12.63210315, 15.30935841, 15.98209675,
            17.81102521, 12.38879848]


def sigma_nn(nn: Column) -> Column:
    return curve_value(nn, bin_centers(NN_BINS), SIGMA_NN)


def sigma_md(md: Column) -> Column:
    return curve_value(md, bin_centers(MD_BINS), SIGMA_MD)


def inverse_variance(sa: Column, sb: Column) -> Column:
    """Weight of the first of two predictions, clipped."""
    return clip(sb * sb / (sa * sa + sb * sb), W_MIN, W_MAX)


def capped_third(sa: Column, sb: Column, sc: Column, cap: float, gate: Column | None = None) -> list[Column]:
    """Third member at most `cap` (0 where the gate is false); the first two share the rest."""
    pa, pb, pc = 1 / (sa * sa), 1 / (sb * sb), 1 / (sc * sc)
    wc = F.least(pc / (pa + pb + pc), F.lit(float(cap)))
    if gate is not None:
        wc = F.when(gate, wc).otherwise(0.0)
    wa = (1 - wc) * clip(pa / (pa + pb), W_MIN, W_MAX)
    return [wa, 1 - wc - wa, wc]


def covariance_weights(s: list[Column], rho12: Column, rho13: Column, rho23: Column) -> list[Column]:
    """Weights proportional to the row sums of the inverse covariance, negatives dropped, sum 1."""
    one = F.lit(1.0)
    w = solve3(s[0] * s[0], rho12 * s[0] * s[1], rho13 * s[0] * s[2], s[1] * s[1], rho23 * s[1] * s[2], s[2] * s[2],
               one, one, one)
    w = [F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) for x in w]
    tot = F.greatest(add(*w), F.lit(1e-12))
    return [x / tot for x in w]


def covariance_weights_of(df: DataFrame, sigma: list[Column], rho: dict[tuple[int, int], Column], out: list[str]) -> DataFrame:
    """As `covariance_weights` for any number of members: adds their weights under the names `out`.  rho: by (i, j) with j < i.
    Where the covariance is singular all members weigh the same."""
    p = len(sigma)
    t = df.withColumns({f"__s{i}": e for i, e in enumerate(sigma)} | {f"__r{i}_{j}": rho[i, j] for i in range(p) for j in range(i)})
    t = t.withColumns({f"__a{i}_{j}": F.col(f"__s{i}") * F.col(f"__s{j}") * (F.col(f"__r{i}_{j}") if j < i else F.lit(1.0)) for i in range(p) for j in range(i + 1)})
    t = t.withColumn("__b", F.lit(1.0))
    t = solve_definite(t, [[f"__a{i}_{j}" for j in range(i + 1)] for i in range(p)], ["__b"] * p, [f"__w{i}" for i in range(p)])
    t = t.withColumns({f"__w{i}": F.when(F.col("__w0").isNotNull(), F.greatest(F.col(f"__w{i}"), F.lit(0.0))).otherwise(1.0) for i in range(p)})
    total = F.greatest(add(*[F.col(f"__w{i}") for i in range(p)]), F.lit(1e-12))
    return t.select(*df.columns, *[(F.col(f"__w{i}") / total).alias(n) for i, n in enumerate(out)])


def convex_sse(rr: Column, r1: Column, r2: Column, d11: Column, d12: Column, d22: Column) -> Column:
    """Least squared error of r = w1 * d1 + w2 * d2 over w1, w2 >= 0 with w1 + w2 <= 1, from the sums of products: the inside of
    the triangle if its optimum lies there, else the best of its three sides."""
    def at(w1, w2):
        return rr - 2 * (w1 * r1 + w2 * r2) + w1 * w1 * d11 + 2 * w1 * w2 * d12 + w2 * w2 * d22

    def side(num, den):
        return F.when(den > 0, clip(num / den, 0, 1)).otherwise(0.0)

    w1, w2 = solve2(d11, d12, d22, r1, r2)
    inside = F.when((w1 >= 0) & (w2 >= 0) & (w1 + w2 <= 1), at(w1, w2))
    a, b = side(r1, d11), side(r2, d22)
    c = side(r1 - r2 - d12 + d22, d11 - 2 * d12 + d22)
    return F.coalesce(inside, F.least(at(a, F.lit(0.0)), at(F.lit(0.0), b), at(c, 1 - c)))


def moments(df: DataFrame, keys: list[str], y: str, members: list[str]) -> DataFrame:
    """Gram sums of members and target per group: n, yy, b_i, a_ij."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    for i, a in enumerate(members):
        aggs.append(F.sum(F.col(a) * F.col(y)).alias(f"b{i}"))
        for j in range(i, len(members)):
            aggs.append(F.sum(F.col(a) * F.col(members[j])).alias(f"a{i}{j}"))
    return df.groupBy(*keys).agg(*aggs)


def sse_of(weights: list[Column]) -> Column:
    """Squared error of a linear blend straight from the moments."""
    k = len(weights)
    lin = add(*[weights[i] * F.col(f"b{i}") for i in range(k)])
    quad = add(*[weights[i] * weights[j] * F.col(f"a{min(i, j)}{max(i, j)}") for i in range(k) for j in range(k)])
    return F.col("yy") - 2 * lin + quad


def optimal_weight(df: DataFrame, keys: list[str], y: str, p: str, q: str, default: float = 0.0) -> DataFrame:
    """w minimising |y - (p + w (q - p))|."""
    d, r = F.col(q) - F.col(p), F.col(y) - F.col(p)
    g = df.groupBy(*keys).agg(F.sum(r * d).alias("__n"), F.sum(d * d).alias("__d"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "n", F.when(F.col("__d") > 1e-9, F.col("__n") / F.col("__d")).otherwise(default).alias("w"))


def nnls3(m: DataFrame, keys: list[str], fallback: list[float]) -> DataFrame:
    """Non-negative least squares of three members from their moments, weights scaled to sum 1.

    All seven non-empty sets of active members are solved in closed form; the feasible one with the
    smallest residual wins (smaller set on ties).  A sum of at most 1e-9 gives the fallback weights."""
    c = F.col
    zero = F.lit(0.0)
    options = []
    for size in (1, 2, 3):
        for act in combinations(range(3), size):
            w = [zero, zero, zero]
            if size == 1:
                i = act[0]
                sol = [F.when(c(f"a{i}{i}") > 0, c(f"b{i}") / c(f"a{i}{i}"))]
            elif size == 2:
                i, j = act
                sol = solve2(c(f"a{i}{i}"), c(f"a{i}{j}"), c(f"a{j}{j}"), c(f"b{i}"), c(f"b{j}"))
            else:
                sol = solve3(c("a00"), c("a01"), c("a02"), c("a11"), c("a12"), c("a22"), c("b0"), c("b1"), c("b2"))
            for i, x in zip(act, sol):
                w[i] = x
            ok = add(*[F.when(x >= 0, 1).otherwise(0) for x in sol]) == size
            gain = add(*[x * c(f"b{i}") for i, x in zip(act, sol)])
            options.append(F.when(ok, F.struct((-gain).alias("loss"), F.lit(len(options)).alias("k"),
                                               *[w[i].alias(f"w{i}") for i in range(3)])))
    best = F.array_min(F.array_compact(F.array(*options)))
    t = m.withColumn("__b", best)
    tot = add(*[F.coalesce(c("__b")[f"w{i}"], zero) for i in range(3)])
    return t.select(*m.columns, *[F.when(tot > 1e-9, c("__b")[f"w{i}"] / tot).otherwise(fallback[i]).alias(f"w{i}")
                                  for i in range(3)])


def log_variance_model(df: DataFrame, e2: Column, f1: Column, f2: Column) -> DataFrame:
    """One row: log e2 ~ c0 + c1*f1 + c2*f2, and k scaling exp(fit) to the mean of e2."""
    t = df.select(e2.alias("e2"), F.log(F.greatest(e2, F.lit(1e-4))).alias("z"), f1.alias("u"), f2.alias("v"))
    c = F.col
    g = t.agg(*[F.sum(x).alias(n) for n, x in {
        "s": F.lit(1.0), "u": c("u"), "v": c("v"), "uu": c("u") * c("u"), "uv": c("u") * c("v"), "vv": c("v") * c("v"),
        "z": c("z"), "zu": c("z") * c("u"), "zv": c("z") * c("v")}.items()])
    sol = solve3(c("s"), c("u"), c("v"), c("uu"), c("uv"), c("vv"), c("z"), c("zu"), c("zv"))
    coef = g.select(*[x.alias(f"c{i}") for i, x in enumerate(sol)]).withColumn("one", F.lit(1))
    k = t.withColumn("one", F.lit(1)).join(coef, "one").agg(
        (F.avg("e2") / F.avg(F.exp(c("c0") + c("c1") * c("u") + c("c2") * c("v")))).alias("k"))
    return coef.join(k.withColumn("one", F.lit(1)), "one")


#: Aggregates that a task keeps at once.
SWEEP = 250


def wide_sweep(df: DataFrame, e2: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """RMSE of many variants: one sum per variant, then columns to rows; SWEEP variants share a pass."""
    if len(e2) > SWEEP:
        names = list(e2)
        parts = [wide_sweep(df, {k: e2[k] for k in names[i: i + SWEEP]}, keys) for i in range(0, len(names), SWEEP)]
        return reduce(DataFrame.unionByName, parts)
    g = df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in e2.items()])
    items = F.array(*[F.struct(F.lit(k).alias("variant"), F.sqrt(F.col(f"`{k}`") / F.col("n")).alias("rmse")) for k in e2])
    return g.select(*(keys or []), "n", F.inline(items))


def combine(names: list[str], err: list[str], temp: float = 1.0) -> dict[str, Column]:
    """Ways to merge several predictions by their known-part RMSE (columns `err`), one column each.
    A member without a prediction or an error is left out of its row; no member gives null."""
    there = [F.col(n).isNotNull() & F.col(x).isNotNull() for n, x in zip(names, err)]
    p = [F.when(t, F.col(n)) for t, n in zip(there, names)]
    e = [F.when(t, F.greatest(F.col(x), F.lit(1e-3))) for t, x in zip(there, err)]
    order = F.array_sort(F.array_compact(F.array(*[F.when(t, F.struct(F.col(x).alias("e"), F.lit(i).alias("i"), F.col(n).alias("v")))
                                                   for i, (t, x, n) in enumerate(zip(there, err, names))])))
    best, second = F.get(order, F.lit(0))["v"], F.get(order, F.lit(1))["v"]

    def mixed(w):
        w = [F.coalesce(x, F.lit(0.0)) for x in w]
        return add(*[a * F.coalesce(b, F.lit(0.0)) for a, b in zip(w, p)]) / F.nullif(add(*w), F.lit(0.0))

    lowest = F.least(*e)
    low_mse = F.greatest(lowest * lowest, F.lit(1e-6))
    return {"mean": row_mean(p), "median": row_median(p), "best": best,
            "wrmse": mixed([1 / x for x in e]), "inv2": mixed([1 / (x * x) for x in e]),
            "inv4": mixed([1 / (x * x * x * x) for x in e]), "soft": mixed([F.exp(-(x / lowest)) for x in e]),
            "softmax": mixed([F.exp(-(x * x) / (temp * low_mse)) for x in e]),
            "top2": (best + F.coalesce(second, best)) / 2}


def combine_full(names: list[str], mse: list[str], good: list[str], top: int = 2) -> dict[str, Column]:
    """Ways to merge predictions over a whole series by their mean squared error in its known part, one column each.

    good: whether a member has a value in every unknown row; members that have not are left out, unless none has, when all
    count.  Weights are of the series; a missing value of a weighted member adds nothing to its row (the other weights stay),
    means and medians are of the values there are."""
    none = ~reduce(lambda a, b: a | b, [F.col(g) for g in good])
    ok = [none | F.col(g) for g in good]
    p = [F.when(k, F.col(n)) for k, n in zip(ok, names)]
    e = [F.when(k, F.col(x)) for k, x in zip(ok, mse)]
    order = F.array_sort(F.array_compact(F.array(*[F.when(x.isNotNull(), F.struct(x.alias("e"), F.lit(i).alias("i"), F.col(n).alias("v")))
                                                   for i, (x, n) in enumerate(zip(e, names))])))
    best = [F.get(order, F.lit(i))["v"] for i in range(top)]

    def weighted(w):
        w = [F.coalesce(x, F.lit(0.0)) for x in w]
        return add(*[a * F.coalesce(F.col(n), F.lit(0.0)) for a, n in zip(w, names)]) / F.nullif(add(*w), F.lit(0.0))

    low = F.greatest(F.least(*e), F.lit(1e-6))
    return {"mean": row_mean(p), "median": row_median(p), "best": best[0], "topn": row_mean(best),
            "winv": weighted([1 / F.greatest(x, F.lit(1e-6)) for x in e]), "softmax": weighted([F.exp(-x / low) for x in e])}


def standard_softmax(rows: DataFrame, features: dict[str, Column], theta: dict[str, list[float]], out: str = "w_") -> DataFrame:
    """Weights w_<member> from linear scores of features scaled to mean 0 and deviation 1 over all rows.

    theta: per member an intercept and one coefficient a feature; a member with an empty list scores 0.  Means and
    deviations are one row, joined on a constant; a constant feature scales to 0."""
    z = rows.withColumns({f"__{k}": v.cast("double") for k, v in features.items()})
    st = z.agg(*[f(f"__{k}").alias(f"__{t}_{k}") for k in features for t, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = z.withColumn("__one", F.lit(1)).join(st.withColumn("__one", F.lit(1)), "__one")
    scaled = [F.when(F.col(f"__s_{k}") > 0, (F.col(f"__{k}") - F.col(f"__m_{k}")) / F.col(f"__s_{k}")).otherwise(0.0) for k in features]
    score = [add(F.lit(float(c[0])), *[b * x for b, x in zip(c[1:], scaled)]) if c else F.lit(0.0) for c in theta.values()]
    w = softmax(score)
    return z.withColumns({f"{out}{m}": x for m, x in zip(theta, w)}).select(*rows.columns, *[f"{out}{m}" for m in theta])


def postprocess_grid(df: DataFrame, cases: dict[tuple, tuple[Column, Column]], base: Column, alphas: list[float], shares: list[float]) -> DataFrame:
    """RMSE of alpha * ((1 - share) * a + share * b) against `base` for every case (a, b) and every alpha and share.

    case names become columns c0, c1 ...  The error is a quadratic form of a, b and the truth, so six sums a case are taken
    in one pass over the rows and the settings are worked out on one row."""
    sums = {}
    for i, (a, b) in enumerate(cases.values()):
        sums |= {f"aa{i}": a * a, f"bb{i}": b * b, f"ab{i}": a * b, f"ra{i}": base * a, f"rb{i}": base * b}
    g = df.agg(F.count(F.lit(1)).alias("n"), F.sum(base * base).alias("rr"), *[F.sum(v).alias(k) for k, v in sums.items()])
    rows = F.array(*[F.struct(*[F.lit(c).alias(f"c{j}") for j, c in enumerate(name)], *[F.col(f"{s}{i}").alias(s) for s in ("aa", "bb", "ab", "ra", "rb")])
                     for i, name in enumerate(cases)])
    settings = F.array(*[F.struct(F.lit(float(al)).alias("alpha"), F.lit(float(w)).alias("share")) for al in alphas for w in shares])
    g = g.select("n", "rr", F.inline(rows)).select("*", F.inline(settings))
    u, v = F.col("alpha") * (1 - F.col("share")), F.col("alpha") * F.col("share")
    sse = F.col("rr") - 2 * u * F.col("ra") - 2 * v * F.col("rb") + u * u * F.col("aa") + 2 * u * v * F.col("ab") + v * v * F.col("bb")
    return g.withColumn("rmse", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n"))).drop("rr", "aa", "bb", "ab", "ra", "rb")
