"""Fusion queries: blends, weights, selections."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions.cols import add, clip, curve_value, bin_centers, ramp_up, sigmoid_gate, softmax
from ..operators import fuse as U
from ..operators import metrics as M
from ..operators import series as S
from . import bindings as B
from .q_stats import MD_EDGES, MIN_BIN, NN_EDGES, binned_sql, sq, sql_bins
from .registry import query
from .sql_solve import sql_solve

# Three members that vary inside a series: line g, flat layer l, jittered mean m.
MIX = B.CAND + """, mix AS (SELECT *, f + z0 - z AS l, p + (event_id * 7919 % 201 - 100) / 20.0 AS m FROM cand)"""
MEM = ["g", "l", "m"]
W_GLOBAL = [0.45, 0.45, 0.1]


def mix(spark, sf, s=None):
    c = B.cand(spark, sf, s)
    return c.withColumn("l", F.col("f") + F.col("z0") - F.col("z")).withColumn(
        "m", F.col("p") + (F.col("event_id") * 7919 % 201 - 100) / 20.0)


def one(df):
    return df.withColumn("one", F.lit(1))


def blend(ws, members=MEM):
    return add(*[w * F.col(m) for w, m in zip(ws, members)])


def err2(pred):
    return (F.col("y") - pred) * (F.col("y") - pred)


def final(df, keys, pred, extra=()):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err2(pred))).alias("rmse"), *extra)


GRID3 = [(a / 4, b / 4, (4 - a - b) / 4) for a in range(5) for b in range(5 - a)]


@query("blend_sweep", "F1", "wg:d wl:d wm:d rmse:d", f"""
WITH {MIX}, w(wg, wl, wm) AS (VALUES {', '.join(f'({a}, {b}, {c})' for a, b, c in GRID3)})
SELECT wg, wl, wm, sqrt(avg((y - wg * g - wl * l - wm * m) ** 2)) AS rmse FROM mix, w GROUP BY wg, wl, wm""", digits=5)
def blend_sweep(spark, sf):
    """Every convex blend on a grid scored from one set of cross moments."""
    mo = U.moments(mix(spark, sf), [], "y", MEM)
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(["wg", "wl", "wm"], w)]) for w in GRID3])
    t = mo.select("*", F.inline(grid))
    return t.withColumn("rmse", F.sqrt(U.sse_of([F.col(c) for c in ("wg", "wl", "wm")]) / F.col("n")))


GATES = list(product([100, 300, 600], [50, 200], [0.3, 0.8]))


@query("gated_weight_sweep", "F2", "variant:s n:l rmse:d", f"""
WITH {MIX}, w(d0, s0, wmax) AS (VALUES {', '.join(f'({a}, {b}, {c})' for a, b, c in GATES)}),
e AS (SELECT d0, s0, wmax, y, wmax / (1 + exp(least(greatest((nn - d0) / s0, -50), 50))) * (1 - exp(-md_since / 500)) AS w, g, m FROM mix, w)
SELECT d0 || '_' || s0 || '_' || wmax AS variant, count(*) AS n, sqrt(avg((y - w * g - (1 - w) * m) ** 2)) AS rmse FROM e GROUP BY ALL""")
def gated_weight_sweep(spark, sf):
    v = {}
    for d0, s0, wmax in GATES:
        w = wmax * sigmoid_gate(F.col("nn"), d0, s0) * ramp_up(F.col("md_since"), 500.0)
        v[f"{d0}_{s0}_{wmax}"] = err2(w * F.col("g") + (1 - w) * F.col("m"))
    return U.wide_sweep(mix(spark, sf), v)


def sql_curve(x, edges, vals):
    c = bin_centers(edges)
    w = " ".join(f"WHEN {x} < {c[i + 1]} THEN {vals[i]} + ({vals[i + 1]} - {vals[i]}) * ({x} - {c[i]}) / {c[i + 1] - c[i]}"
                 for i in range(len(c) - 1))
    return f"(CASE WHEN {x} < {c[0]} THEN {vals[0]} {w} ELSE {vals[-1]} END)"


SIG = f"sg AS (SELECT *, {sql_curve('nn', U.NN_BINS, U.SIGMA_NN)} AS sa, {sql_curve('md_since', U.MD_BINS, U.SIGMA_MD)} AS sb FROM mix)"


@query("inverse_variance_blend", "F3", "well:l seq:l w:d pred:d", f"""
WITH {MIX}, {SIG}, w AS (SELECT *, least(greatest(sb*sb / (sa*sa + sb*sb), 0.05), 0.9) AS w FROM sg)
SELECT well, seq, w, w * g + (1 - w) * m AS pred FROM w""")
def inverse_variance_blend(spark, sf):
    w = U.inverse_variance(U.sigma_nn(F.col("nn")), U.sigma_md(F.col("md_since")))
    return mix(spark, sf).select("well", "seq", w.alias("w"), (w * F.col("g") + (1 - w) * F.col("m")).alias("pred"))


CR, CC = bin_centers(NN_EDGES), bin_centers(MD_EDGES)


def sql_axis(x, ctr, p):
    """Lower index and fraction on a list of centres, and the nearest upper centre (searchsorted, clipped)."""
    n = len(ctr)
    i = "CASE " + " ".join(f"WHEN {x} < {ctr[k + 1]} THEN {k}" for k in range(n - 2)) + f" ELSE {n - 2} END"
    ss = "CASE " + " ".join(f"WHEN {x} <= {c} THEN {k}" for k, c in enumerate(ctr)) + f" ELSE {n - 1} END"
    return f"{i} AS {p}i, least(greatest({x}, {ctr[0]}), {ctr[-1]}) AS {p}x, {ss} AS {p}n"


@query("sigma_grid_blend", "F4", "well:l seq:l bilinear:d cell:d", f"""
WITH {MIX}, {binned_sql('nn', '(y-s)**2', NN_EDGES, 'nn')},
g AS (SELECT {sql_bins('nn', NN_EDGES)} AS r, {sql_bins('md_since', MD_EDGES)} AS c, count(*) AS n, sum((y-s)**2) AS ss FROM cand GROUP BY 1, 2),
f AS (SELECT b.bin AS r, c.c, b.sigma AS s1, coalesce(g.n, 0) AS n, coalesce(g.ss, 0) AS ss FROM b_nn b, (SELECT unnest(range({len(MD_EDGES) - 1})) AS c) c
  LEFT JOIN g ON g.r = b.bin AND g.c = c.c),
mr AS (SELECT c, CASE WHEN sum(n) >= 50 THEN sqrt(sum(ss) / sum(n * s1 * s1)) ELSE 1 END AS ratio FROM f GROUP BY c),
gr AS (SELECT r, f.c, CASE WHEN n >= 50 THEN sqrt(ss / n) ELSE s1 * ratio END AS v FROM f JOIN mr ON f.c = mr.c),
cr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(CR))}) t(i, x)), cc AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(CC))}) t(i, x)),
a AS (SELECT well, seq, {sql_axis('nn', CR, 'r')}, {sql_axis('md_since', CC, 'c')} FROM mix),
h AS (SELECT a.*, (rx - r0.x) / (r1.x - r0.x) AS u, (cx - c0.x) / (c1.x - c0.x) AS v FROM a JOIN cr r0 ON r0.i = ri JOIN cr r1 ON r1.i = ri + 1
  JOIN cc c0 ON c0.i = ci JOIN cc c1 ON c1.i = ci + 1)
SELECT well, seq, (1-u)*(1-h.v)*q00.v + u*(1-h.v)*q10.v + (1-u)*h.v*q01.v + u*h.v*q11.v AS bilinear, qn.v AS cell FROM h
JOIN gr q00 ON q00.r = ri AND q00.c = ci JOIN gr q10 ON q10.r = ri + 1 AND q10.c = ci JOIN gr q01 ON q01.r = ri AND q01.c = ci + 1
JOIN gr q11 ON q11.r = ri + 1 AND q11.c = ci + 1 JOIN gr qn ON qn.r = rn AND qn.c = cn""")
def sigma_grid_blend(spark, sf):
    """Deviation read from a fitted 2-D grid, bilinear and by cell; the grid is one row of fixed size."""
    c = mix(spark, sf)
    rows = M.binned_rms(c, F.col("nn"), sq("s"), NN_EDGES, MIN_BIN)
    g = M.binned_rms_2d(c, F.col("nn"), F.col("md_since"), sq("s"), NN_EDGES, MD_EDGES, rows, 50)
    g = one(g.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "sigma"))), lambda s: s["sigma"]).alias("q")))
    nc = len(CC)

    def axis(x, ctr):
        i = F.lit(len(ctr) - 2)
        for k in reversed(range(len(ctr) - 2)):
            i = F.when(x < ctr[k + 1], F.lit(k)).otherwise(i)
        ss = F.lit(len(ctr) - 1)
        for k in reversed(range(len(ctr))):
            ss = F.when(x <= ctr[k], F.lit(k)).otherwise(ss)
        at = F.array(*[F.lit(v) for v in ctr])
        return i, (clip(x, ctr[0], ctr[-1]) - F.get(at, i)) / (F.get(at, i + 1) - F.get(at, i)), ss

    ri, u, rn = axis(F.col("nn"), CR)
    ci, v, cn = axis(F.col("md_since"), CC)
    q = lambda r, k: F.get(F.col("q"), r * nc + k)
    bil = (1 - u) * (1 - v) * q(ri, ci) + u * (1 - v) * q(ri + 1, ci) + (1 - u) * v * q(ri, ci + 1) + u * v * q(ri + 1, ci + 1)
    return one(c).join(g, "one").select("well", "seq", bil.alias("bilinear"), q(rn, cn).alias("cell"))


@query("capped_member_blend", "F5", "well:l seq:l wa:d wb:d wc:d pred:d", f"""
WITH {MIX}, {SIG}, p AS (SELECT *, 1/(sa*sa) AS pa, 1/(sb*sb) AS pb, 1/400.0 AS pc FROM sg),
c AS (SELECT *, CASE WHEN md_since < 1000 THEN least(pc / (pa + pb + pc), 0.2) ELSE 0 END AS wc FROM p),
a AS (SELECT *, (1 - wc) * least(greatest(pa / (pa + pb), 0.05), 0.9) AS wa FROM c)
SELECT well, seq, wa, 1 - wc - wa AS wb, wc, wa * g + (1 - wc - wa) * m + wc * l AS pred FROM a""")
def capped_member_blend(spark, sf):
    w = U.capped_third(U.sigma_nn(F.col("nn")), U.sigma_md(F.col("md_since")), F.lit(20.0), 0.2, F.col("md_since") < 1000)
    return mix(spark, sf).select("well", "seq", w[0].alias("wa"), w[1].alias("wb"), w[2].alias("wc"),
                                 blend(w, ["g", "m", "l"]).alias("pred"))


RHO_EDGES = [0, 250, 500, 1000, 1e9]


@query("covariance_blend", "F6", "well:l seq:l wa:d wb:d wc:d", f"""
WITH {MIX}, {SIG}, rb AS (SELECT {sql_bins('md_since', RHO_EDGES)} AS b, corr(y-g, y-m) AS r12, corr(y-g, y-l) AS r13, corr(y-m, y-l) AS r23 FROM mix GROUP BY 1),
rr AS (SELECT {', '.join(f"max({r}) FILTER (b = {i}) AS {r}_{i}" for r in ['r12', 'r13', 'r23'] for i in range(4))} FROM rb),
k AS (SELECT well, seq, sa, sb, 20.0 AS sc, {', '.join(f"0.5 * {sql_curve('md_since', RHO_EDGES, [f'{r}_{i}' for i in range(4)])} AS {r}" for r in ['r12', 'r13', 'r23'])} FROM sg, rr),
m3 AS (SELECT *, sa*sa AS a, r12*sa*sb AS b, r13*sa*sc AS c, sb*sb AS d, r23*sb*sc AS e, sc*sc AS f FROM k),
w AS (SELECT well, seq, greatest((d*f-e*e + c*e-b*f + b*e-c*d) / det, 0) AS x, greatest((c*e-b*f + a*f-c*c + b*c-a*e) / det, 0) AS y, greatest((b*e-c*d + b*c-a*e + a*d-b*b) / det, 0) AS z
  FROM (SELECT *, a*(d*f-e*e) + b*(c*e-b*f) + c*(b*e-c*d) AS det FROM m3))
SELECT well, seq, x / (x+y+z) AS wa, y / (x+y+z) AS wb, z / (x+y+z) AS wc FROM w""")
def covariance_blend(spark, sf):
    """Weights from deviations and residual correlations per depth bin, shrunk by half."""
    t = mix(spark, sf)
    e = {"a": F.col("y") - F.col("g"), "b": F.col("y") - F.col("m"), "c": F.col("y") - F.col("l")}
    r = M.pair_correlations(t.withColumn("bin", M.clipped_bin(F.col("md_since"), RHO_EDGES)), ["bin"], e)
    nb = len(RHO_EDGES) - 1
    r = one(r.agg(*[F.max(F.when((F.col("a") == a) & (F.col("b") == b) & (F.col("bin") == i), F.col("rho"))).alias(f"{a}{b}{i}")
                    for a, b in [("a", "b"), ("a", "c"), ("b", "c")] for i in range(nb)]))
    ctr = bin_centers(RHO_EDGES)
    rho = {p: 0.5 * curve_value(F.col("md_since"), ctr, [F.coalesce(F.col(f"{p}{i}"), F.lit(0.0)) for i in range(nb)])
           for p in ("ab", "ac", "bc")}
    w = U.covariance_weights([U.sigma_nn(F.col("nn")), U.sigma_md(F.col("md_since")), F.lit(20.0)], rho["ab"], rho["ac"], rho["bc"])
    return one(t).join(r, "one").select("well", "seq", *[x.alias(n) for x, n in zip(w, ["wa", "wb", "wc"])])


def sql_var(name, pred, u, v):
    return f"""t{name} AS (SELECT (y-{pred})**2 AS e2, ln(greatest((y-{pred})**2, 1e-4)) AS z, {u} AS u, {v} AS v FROM mix),
g{name} AS (SELECT count(*) AS a, sum(u) AS b, sum(v) AS c, sum(u*u) AS d, sum(u*v) AS e, sum(v*v) AS f, sum(z) AS x, sum(z*u) AS y, sum(z*v) AS w FROM t{name}),
c{name} AS (SELECT ((d*f-e*e)*x + (c*e-b*f)*y + (b*e-c*d)*w) / det AS c0, ((c*e-b*f)*x + (a*f-c*c)*y + (b*c-a*e)*w) / det AS c1,
  ((b*e-c*d)*x + (b*c-a*e)*y + (a*d-b*b)*w) / det AS c2 FROM (SELECT *, a*(d*f-e*e) + b*(c*e-b*f) + c*(b*e-c*d) AS det FROM g{name})),
k{name} AS (SELECT avg(e2) / avg(exp(c0 + c1*u + c2*v)) AS k FROM t{name}, c{name})"""


LN, LM = "ln(greatest(nn, 1))", "ln(greatest(md_since, 1))"
TG = list(product([0.5, 1.0], [0.5, 1.0, 2.0]))


MANY = {4: ["g", "m", "l", "s"], 5: ["g", "m", "l", "s", "p"]}


def many_sql(members):
    nb, n = len(RHO_EDGES) - 1, len(members)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    mid = [f"greatest({sql_curve('md_since', RHO_EDGES, [f's{i}_{k}' for k in range(nb)])}, 0.001) AS s{i}" for i in range(n)] + [
        f"0.5 * {sql_curve('md_since', RHO_EDGES, [f'r{i}_{j}_{k}' for k in range(nb)])} AS r{i}_{j}" for i, j in pairs]
    cov = [f"s{i} * s{j} * {f'r{i}_{j}' if j < i else '1.0'} AS a{i}_{j}" for i in range(n) for j in range(i + 1)]
    steps, last = sql_solve("mc", "mw", [[f"a{i}_{j}" for j in range(i + 1)] for i in range(n)], ["one"] * n, [f"x{i}" for i in range(n)])
    total = " + ".join(f"greatest(x{i}, 0)" for i in range(n))
    return f"""WITH {MIX}, rb AS (SELECT {sql_bins('md_since', RHO_EDGES)} AS b, {', '.join(f"sqrt(avg((y - {m}) ** 2)) AS s{i}" for i, m in enumerate(members))},
  {', '.join(f"corr(y - {members[i]}, y - {members[j]}) AS r{i}_{j}" for i, j in pairs)} FROM mix GROUP BY 1),
rr AS (SELECT {', '.join(f"coalesce(max(s{i}) FILTER (b = {k}), 1) AS s{i}_{k}" for i in range(n) for k in range(nb))}, {', '.join(f"coalesce(max(r{i}_{j}) FILTER (b = {k}), 0) AS r{i}_{j}_{k}" for i, j in pairs for k in range(nb))} FROM rb),
mk AS (SELECT well, seq, y, {', '.join(f"{m} AS v{i}" for i, m in enumerate(members))}, {', '.join(mid)} FROM mix, rr), mc AS (SELECT *, 1.0 AS one, {', '.join(cov)} FROM mk), {', '.join(steps)}
SELECT well, seq, {', '.join(f"greatest(x{i}, 0) / ({total}) AS w_{m}" for i, m in enumerate(members))}, ({' + '.join(f"greatest(x{i}, 0) * v{i}" for i in range(n))}) / ({total}) AS pred FROM {last}"""


def many_query(n, members):
    @query(f"covariance_blend_{n}", "F6", "well:l seq:l " + " ".join(f"w_{m}:d" for m in members) + " pred:d", many_sql(members), digits=5)
    def run(spark, sf):
        """Weights of four or five members from their error curves and residual correlations per depth bin, shrunk by half."""
        t = mix(spark, sf).withColumn("bin", M.clipped_bin(F.col("md_since"), RHO_EDGES))
        nb, ctr = len(RHO_EDGES) - 1, bin_centers(RHO_EDGES)
        e = {m: F.col("y") - F.col(m) for m in members}
        pairs = [(i, j) for i in range(n) for j in range(i)]
        g = t.groupBy("bin").agg(*[F.sqrt(F.avg(x * x)).alias(f"s{i}") for i, x in enumerate(e.values())],
                                 *[F.corr(e[members[i]], e[members[j]]).alias(f"r{i}_{j}") for i, j in pairs])
        known = [(f"s{i}", 1.0) for i in range(n)] + [(f"r{i}_{j}", 0.0) for i, j in pairs]
        r = one(g.agg(*[F.coalesce(F.max(F.when((F.col("bin") == k) & ~F.isnan(c), F.col(c))), F.lit(d)).alias(f"{c}_{k}") for c, d in known for k in range(nb)]))
        value = lambda c: curve_value(F.col("md_since"), ctr, [F.col(f"{c}_{k}") for k in range(nb)])
        rows = one(t).join(r, "one")
        w = U.covariance_weights_of(rows, [F.greatest(value(f"s{i}"), F.lit(1e-3)) for i in range(n)], {(i, j): 0.5 * value(f"r{i}_{j}") for i, j in pairs},
                                    [f"w_{m}" for m in members])
        return w.withColumn("pred", blend([F.col(f"w_{m}") for m in members], members))

    return run


for _n, _members in MANY.items():
    many_query(_n, _members)


@query("variance_model_blend", "F7", "variant:s n:l rmse:d", f"""
WITH {MIX}, {sql_var('s', 'g', LN, LM)}, {sql_var('p', 'm', LM, LN)},
v AS (SELECT y, g, m, ks.k * exp(least(greatest(cs.c0 + cs.c1*{LN} + cs.c2*{LM}, -20), 20)) AS vs, kp.k * exp(least(greatest(cp.c0 + cp.c1*{LM} + cp.c2*{LN}, -20), 20)) AS vp
  FROM mix, cs, ks, cp, kp), tg(t, q) AS (VALUES {', '.join(f'({t}, {g})' for t, g in TG)}),
w AS (SELECT t || '_' || q AS variant, y, g, m, (q*vp)**t / ((q*vp)**t + vs**t) AS w FROM v, tg)
SELECT variant, count(*) AS n, sqrt(avg((y - w*g - (1-w)*m)**2)) AS rmse FROM w GROUP BY variant""", digits=5)
def variance_model_blend(spark, sf):
    """Squared errors modelled on a log scale, then inverse-variance weights over a small grid."""
    t = mix(spark, sf)
    ln = F.log(F.greatest(F.col("nn"), F.lit(1.0)))
    lm = F.log(F.greatest(F.col("md_since"), F.lit(1.0)))
    a = U.log_variance_model(t, err2(F.col("g")), ln, lm).select("one", *[F.col(c).alias(f"s{c}") for c in ("c0", "c1", "c2", "k")])
    b = U.log_variance_model(t, err2(F.col("m")), lm, ln).select("one", *[F.col(c).alias(f"p{c}") for c in ("c0", "c1", "c2", "k")])
    t = one(t).join(a, "one").join(b, "one")
    vs = F.col("sk") * F.exp(clip(F.col("sc0") + F.col("sc1") * ln + F.col("sc2") * lm, -20, 20))
    vp = F.col("pk") * F.exp(clip(F.col("pc0") + F.col("pc1") * lm + F.col("pc2") * ln, -20, 20))
    t = t.withColumn("vs", vs).withColumn("vp", vp)
    v = {}
    for tt, g in TG:
        up = F.pow(g * F.col("vp"), F.lit(tt))
        w = up / (up + F.pow("vs", F.lit(tt)))
        v[f"{tt}_{g}"] = err2(w * F.col("g") + (1 - w) * F.col("m"))
    return U.wide_sweep(t, v)


@query("softmax_point_weights", "F8", "well:l seq:l wg:d wm:d wl:d pred:d", f"""
WITH {MIX}, u AS (SELECT *, -0.2 + 0.4 * md_since / 1000 - 0.1 * {LN} AS a, -3 + 0.2 * md_since / 1000 + 0.3 * {LN} AS b FROM mix),
e AS (SELECT *, exp(a - greatest(a, 0, b)) AS ea, exp(-greatest(a, 0, b)) AS e0, exp(b - greatest(a, 0, b)) AS eb FROM u)
SELECT well, seq, ea / (ea+e0+eb) AS wg, e0 / (ea+e0+eb) AS wm, eb / (ea+e0+eb) AS wl, (ea*g + e0*m + eb*l) / (ea+e0+eb) AS pred FROM e""")
def softmax_point_weights(spark, sf):
    """Weights per row from stored coefficients on depth and log distance."""
    md, ln = F.col("md_since") / 1000, F.log(F.greatest(F.col("nn"), F.lit(1.0)))
    w = softmax([-0.2 + 0.4 * md - 0.1 * ln, F.lit(0.0), -3 + 0.2 * md + 0.3 * ln])
    return mix(spark, sf).select("well", "seq", w[0].alias("wg"), w[1].alias("wm"), w[2].alias("wl"),
                                 blend(w, ["g", "m", "l"]).alias("pred"))


@query("optimal_weight", "F9", "scope:s key:l n:l w:d", f"""
WITH {MIX}, d AS (SELECT well, {sql_bins('nn', NN_EDGES)} AS bin, g - m AS d, y - m AS r FROM mix)
SELECT 'all' AS scope, 0 AS key, count(*) AS n, sum(r*d)/sum(d*d) AS w FROM d UNION ALL
SELECT 'bin', bin, count(*), sum(r*d)/sum(d*d) FROM d GROUP BY bin UNION ALL
SELECT 'well', well, count(*), least(greatest(sum(r*d)/sum(d*d), 0), 1) FROM d GROUP BY well""")
def optimal_weight(spark, sf):
    """Closed-form best weight overall, per distance bin, and per series clipped to [0, 1]."""
    t = mix(spark, sf).withColumn("bin", M.clipped_bin(F.col("nn"), NN_EDGES)).withColumn("all", F.lit(0))
    def at(k, scope):
        return U.optimal_weight(t, [k], "y", "m", "g").select(F.lit(scope).alias("scope"), F.col(k).cast("long").alias("key"), "n", "w")
    w = at("well", "well").withColumn("w", clip(F.col("w"), 0, 1))
    return at("all", "all").unionByName(at("bin", "bin")).unionByName(w)


def sql_nnls() -> str:
    one_ = [f"SELECT well, {k} AS k, {', '.join((f'b{i}/a{i}{i}' if j == i else '0') + f' AS w{j}' for j in range(3))} FROM mo" for k, i in enumerate(range(3))]
    two = []
    for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        det = f"(a{i}{i}*a{j}{j}-a{i}{j}*a{i}{j})"
        s = {i: f"(b{i}*a{j}{j}-a{i}{j}*b{j})/{det}", j: f"(a{i}{i}*b{j}-a{i}{j}*b{i})/{det}"}
        two.append(f"SELECT well, {k + 3} AS k, {', '.join(s.get(q, '0') + f' AS w{q}' for q in range(3))} FROM mo")
    det = "(a00*(a11*a22-a12*a12)+a01*(a02*a12-a01*a22)+a02*(a01*a12-a02*a11))"
    three = f"""SELECT well, 6 AS k, ((a11*a22-a12*a12)*b0+(a02*a12-a01*a22)*b1+(a01*a12-a02*a11)*b2)/{det} AS w0,
 ((a02*a12-a01*a22)*b0+(a00*a22-a02*a02)*b1+(a01*a02-a00*a12)*b2)/{det} AS w1, ((a01*a12-a02*a11)*b0+(a01*a02-a00*a12)*b1+(a00*a11-a01*a01)*b2)/{det} AS w2 FROM mo"""
    return " UNION ALL ".join(one_ + two + [three])


MO = "mo AS (SELECT well, count(*) AS n, sum(y*y) AS yy, sum(g*y) AS b0, sum(l*y) AS b1, sum(m*y) AS b2, sum(g*g) AS a00, sum(g*l) AS a01, sum(g*m) AS a02, sum(l*l) AS a11, sum(l*m) AS a12, sum(m*m) AS a22 FROM mix GROUP BY well)"
NNLS = f"""{MIX}, {MO}, op AS ({sql_nnls()}),
bw AS (SELECT well, arg_min(struct_pack(w0, w1, w2), w0*-b0 - w1*b1 - w2*b2) AS w FROM op JOIN mo USING (well) WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0 GROUP BY well),
nw AS (SELECT well, w.w0 / (w.w0+w.w1+w.w2) AS w0, w.w1 / (w.w0+w.w1+w.w2) AS w1, w.w2 / (w.w0+w.w1+w.w2) AS w2 FROM bw)"""


@query("nnls_weights", "F10", "well:l w0:d w1:d w2:d rmse:d", f"""
WITH {NNLS} SELECT well, w0, w1, w2, sqrt(avg((y - w0*g - w1*l - w2*m) ** 2)) AS rmse FROM nw JOIN mix USING (well) GROUP BY ALL""", digits=4)
def nnls_weights(spark, sf):
    """Non-negative weights per series, scaled to sum 1, from the moments alone."""
    t = U.nnls3(U.moments(mix(spark, sf), ["well"], "y", MEM), ["well"], W_GLOBAL)
    return t.withColumn("rmse", F.sqrt(F.greatest(U.sse_of([F.col(f"w{i}") for i in range(3)]), F.lit(0.0)) / F.col("n")))


@query("free_least_squares", "F11", "well:l wg:d wl:d sse:d", f"""
WITH {MIX}, c AS (SELECT well, var_pop(g) AS a, covar_pop(g, l) AS b, var_pop(l) AS d, covar_pop(g, y) AS x, covar_pop(l, y) AS z, var_pop(y) AS v, count(*) AS n FROM mix GROUP BY well)
SELECT well, (x*d - b*z) / (a*d - b*b) AS wg, (a*z - b*x) / (a*d - b*b) AS wl, n * (v - (x*(x*d - b*z) + z*(a*z - b*x)) / (a*d - b*b)) AS sse FROM c""", digits=4)
def free_least_squares(spark, sf):
    """Two members and an intercept, no constraint, from centred moments."""
    c = mix(spark, sf).groupBy("well").agg(
        F.var_pop("g").alias("a"), F.covar_pop("g", "l").alias("b"), F.var_pop("l").alias("d"), F.covar_pop("g", "y").alias("x"),
        F.covar_pop("l", "y").alias("z"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n"))
    from ..functions.small_solve import solve2
    w = solve2(F.col("a"), F.col("b"), F.col("d"), F.col("x"), F.col("z"))
    return c.select("well", w[0].alias("wg"), w[1].alias("wl"), (F.col("n") * (F.col("v") - F.col("x") * w[0] - F.col("z") * w[1])).alias("sse"))


@query("sum_to_one_split", "F12", "w0:d w1:d w2:d rmse:d n:l", f"""
WITH {MIX}, d AS (SELECT well, y - m AS r, g - m AS u, l - m AS v, y, g, l, m FROM mix), s AS (SELECT sum(u*u) AS a, sum(u*v) AS b, sum(v*v) AS d, sum(u*r) AS x, sum(v*r) AS z FROM d WHERE well % 2 = 0),
w AS (SELECT (x*d - b*z) / (a*d - b*b) AS w0, (a*z - b*x) / (a*d - b*b) AS w1 FROM s)
SELECT w0, w1, 1 - w0 - w1 AS w2, sqrt(avg((y - w0*g - w1*l - (1-w0-w1)*m)**2)) AS rmse, count(*) AS n FROM d, w WHERE well % 2 = 1 GROUP BY w0, w1""")
def sum_to_one_split(spark, sf):
    """Weights summing to one fitted on half of the series, scored on the other half."""
    from ..functions.small_solve import solve2
    t = mix(spark, sf).withColumn("r", F.col("y") - F.col("m")).withColumn("u", F.col("g") - F.col("m")).withColumn("v", F.col("l") - F.col("m"))
    c = F.col
    s = t.where("well % 2 = 0").agg(F.sum(c("u") * c("u")).alias("a"), F.sum(c("u") * c("v")).alias("b"), F.sum(c("v") * c("v")).alias("d"),
                                    F.sum(c("u") * c("r")).alias("x"), F.sum(c("v") * c("r")).alias("z"))
    w = one(s.select(*[e.alias(f"w{i}") for i, e in enumerate(solve2(c("a"), c("b"), c("d"), c("x"), c("z")))]))
    h = one(t.where("well % 2 = 1")).join(w, "one")
    e = c("r") - c("w0") * c("u") - c("w1") * c("v")
    return h.agg(F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.count(F.lit(1)).alias("n")).withColumn("w2", 1 - c("w0") - c("w1"))


LAMS = [0.0, 0.25, 0.5, 0.75, 1.0]
BT = B.BACKTEST.split(",\nm0 AS", 1)[1]
BTM = MIX + ",\nm0 AS" + BT + """, btm AS (SELECT bt.*, f + z0 - e.z AS l, p + (event_id * 7919 % 201 - 100) / 20.0 AS m FROM bt
  JOIN ev e ON e.well = bt.well AND e.seq = bt.seq JOIN (SELECT well AS aw, frac AS af, max(z) FILTER (seq = cut2 - 1) AS z0 FROM m GROUP BY 1, 2) a ON a.aw = bt.well AND a.af = bt.frac),
br AS (SELECT well, count(*) AS nb, sqrt(avg((y-g)**2)) AS rg, sqrt(avg((y-l)**2)) AS rl, sqrt(avg((y-m)**2)) AS rm,
  least(greatest(sum((y-m)*(g-m)) / sum((g-m)**2), 0), 1) AS wb FROM btm GROUP BY well)"""


def backtest_mix(spark, sf, fracs=(0.5, 0.65, 0.75), s=None):
    """Masked-tail rows with the same three members as `mix`."""
    m = B.masked(B.evaluable(B.series(spark, sf) if s is None else s), list(fracs))
    seq, cut = F.col("seq"), F.col("cut2")
    pre, at = seq < cut, seq == cut - 1
    a = m.groupBy("well", "frac").agg(
        F.max(F.when(at, F.col("tvt"))).alias("f"), F.max(F.when(at, F.col("z"))).alias("z0"), F.avg(F.when(pre, F.col("tvt"))).alias("p"),
        F.median(F.when(pre & (seq >= cut - B.TAIL), F.col("tvt"))).alias("s"),
        F.regr_slope(F.when(pre, F.col("tvt")), F.when(pre, F.col("md"))).alias("sl"),
        F.regr_intercept(F.when(pre, F.col("tvt")), F.when(pre, F.col("md"))).alias("ic"))
    return m.where(seq >= cut).join(a, ["well", "frac"]).select(
        "well", "frac", "s", "p", F.col("tvt").alias("y"), (F.col("ic") + F.col("sl") * F.col("md")).alias("g"),
        (F.col("f") + F.col("z0") - F.col("z")).alias("l"), (F.col("p") + (F.col("event_id") * 7919 % 201 - 100) / 20.0).alias("m"))


def backtest_scores(spark, sf):
    b = backtest_mix(spark, sf)
    d, r = F.col("g") - F.col("m"), F.col("y") - F.col("m")
    return b.groupBy("well").agg(
        F.count(F.lit(1)).alias("nb"), *[F.sqrt(F.avg(err2(F.col(c)))).alias(f"r{c}") for c in MEM],
        F.least(F.greatest(F.sum(r * d) / F.sum(d * d), F.lit(0.0)), F.lit(1.0)).alias("wb"))


@query("shrunk_backtest_weight", "F13", "variant:s n:l rmse:d", f"""
WITH {BTM}, v AS (SELECT 'lam_' || lam AS variant, well, (1 - lam) * wb + lam * 0.25 AS w FROM br, (SELECT unnest({LAMS})::DOUBLE AS lam)
UNION ALL SELECT 'bayes_' || k, well, least(greatest(nb / (nb + k) * wb + (1 - nb / (nb + k)) * 0.25, 0), 1) FROM br, (SELECT unnest([20, 200]) AS k))
SELECT variant, count(*) AS n, sqrt(avg((y - w*g - (1-w)*mix.m)**2)) AS rmse FROM v JOIN mix USING (well) GROUP BY variant""")
def shrunk_backtest_weight(spark, sf):
    """Least-squares weight of the masked tail, shrunk to a global weight by a factor or by its row count."""
    t = mix(spark, sf).join(backtest_scores(spark, sf), "well")
    v = {f"lam_{x}": (1 - x) * F.col("wb") + x * 0.25 for x in LAMS}
    for k in (20, 200):
        a = F.col("nb") / (F.col("nb") + k)
        v[f"bayes_{k}"] = clip(a * F.col("wb") + (1 - a) * 0.25, 0, 1)
    return U.wide_sweep(t, {k: err2(w * F.col("g") + (1 - w) * F.col("m")) for k, w in v.items()})


@query("backtest_weights", "F14", "well:l inv2:d ratio2:d soft:d gated:d", f"""
WITH {BTM} SELECT well, rg**-2 / (rg**-2 + rl**-2 + rm**-2) AS inv2, rm**2 / (rm**2 + rg**2) AS ratio2, exp(-rg/4) / (exp(-rg/4) + exp(-rm/4)) AS soft,
  CASE WHEN abs(rg - rm) >= 2 THEN rm**2 / (rg**2 + rm**2 + 1e-12) ELSE 0.25 END AS gated FROM br""")
def backtest_weights(spark, sf):
    """Per-series weights from masked-tail errors: inverse power, ratio, softmax, and only on clear evidence."""
    rg, rl, rm = F.col("rg"), F.col("rl"), F.col("rm")
    i2 = lambda c: 1 / (c * c)
    return backtest_scores(spark, sf).select(
        "well", (i2(rg) / (i2(rg) + i2(rl) + i2(rm))).alias("inv2"), (rm * rm / (rm * rm + rg * rg)).alias("ratio2"),
        softmax([-rg / 4, -rm / 4])[0].alias("soft"),
        F.when(F.abs(rg - rm) >= 2, rm * rm / (rg * rg + rm * rm + 1e-12)).otherwise(0.25).alias("gated"))


@query("bounded_move_sweep", "F15", "variant:s n:l rmse:d", f"""
WITH {BTM}, v AS (SELECT lam || '_' || d AS variant, y, mix.m + least(greatest(lam * (wb * g + (1 - wb) * mix.m - mix.m), -d), d) AS p
  FROM mix JOIN br USING (well), (SELECT unnest([0.3, 1.0]) AS lam), (SELECT unnest([5.0, 20.0]) AS d))
SELECT variant, count(*) AS n, sqrt(avg((y - p)**2)) AS rmse FROM v GROUP BY variant""")
def bounded_move_sweep(spark, sf):
    t = mix(spark, sf).join(backtest_scores(spark, sf), "well")
    move = F.col("wb") * (F.col("g") - F.col("m"))
    return U.wide_sweep(t, {f"{lam}_{d}": err2(F.col("m") + clip(lam * move, -d, d)) for lam in (0.3, 1.0) for d in (5.0, 20.0)})


@query("sigma_rescale", "F16", "well:l fa:d fb:d rmse:d", f"""
WITH {BTM}, {SIG}, f AS (SELECT well, rg / greatest(15, 1e-6) AS fa, rm / greatest(10, 1e-6) AS fb FROM br),
w AS (SELECT well, y, g, m, fa, fb, least(greatest((sb*fb**0.5)**2 / ((sa*fa**0.5)**2 + (sb*fb**0.5)**2), 0.05), 0.9) AS w FROM sg JOIN f USING (well))
SELECT well, fa, fb, sqrt(avg((y - w*g - (1-w)*m)**2)) AS rmse FROM w GROUP BY well, fa, fb""")
def sigma_rescale(spark, sf):
    """Deviation curves scaled per series by how far its masked-tail error is from the expected one."""
    t = mix(spark, sf).join(backtest_scores(spark, sf), "well")
    t = t.withColumn("fa", F.col("rg") / 15).withColumn("fb", F.col("rm") / 10)
    w = U.inverse_variance(U.sigma_nn(F.col("nn")) * F.sqrt("fa"), U.sigma_md(F.col("md_since")) * F.sqrt("fb"))
    return final(t, ["well", "fa", "fb"], w * F.col("g") + (1 - w) * F.col("m"))


@query("tilted_weights", "F17", "well:l seq:l wg:d wm:d", f"""
WITH {BTM}, e AS (SELECT mix.well, seq, exp(0.4 * md_since / 1000) AS a, greatest(wb, 0.001) / 0.25 AS ta, greatest(1 - wb, 0.001) / 0.75 AS tb FROM mix JOIN br USING (well))
SELECT well, seq, a * ta / (a * ta + tb) AS wg, tb / (a * ta + tb) AS wm FROM e""")
def tilted_weights(spark, sf):
    """Row weights multiplied by the ratio of series weight to global weight, then scaled to one."""
    t = mix(spark, sf).join(backtest_scores(spark, sf), "well")
    ta = F.log(F.greatest("wb", F.lit(1e-3)) / 0.25)
    tb = F.log(F.greatest(1 - F.col("wb"), F.lit(1e-3)) / 0.75)
    w = softmax([0.4 * F.col("md_since") / 1000 + ta, tb])
    return t.select("well", "seq", w[0].alias("wg"), w[1].alias("wm"))


@query("hard_selection", "F18", "well:l winner:s n:l rmse:d", f"""
WITH {BTM}, w AS (SELECT well, CASE WHEN rg <= rl AND rg <= rm THEN 'g' WHEN rl <= rm THEN 'l' ELSE 'm' END AS winner FROM br)
SELECT well, winner, count(*) AS n, sqrt(avg((y - mix.m - 0.6 * (CASE winner WHEN 'g' THEN g WHEN 'l' THEN l ELSE mix.m END - mix.m))**2)) AS rmse
FROM mix JOIN w USING (well) GROUP BY well, winner""")
def hard_selection(spark, sf):
    """Backtest winner per series (first on ties), moved 60 % of the way."""
    win = F.array_min(F.array(*[F.struct(F.col(f"r{c}").alias("r"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(MEM)]))
    b = backtest_scores(spark, sf).select("well", win["c"].alias("winner"))
    pick = F.coalesce(*[F.when(F.col("winner") == c, F.col(c)) for c in MEM])
    return final(mix(spark, sf).join(b, "well"), ["well", "winner"], F.col("m") + 0.6 * (pick - F.col("m")))


MODES = ["mean", "median", "best", "wrmse", "inv2", "inv4", "soft", "softmax", "top2"]


@query("surface_combine", "F19", "variant:s n:l rmse:d", f"""
WITH {BTM}, j AS (SELECT y, g, l, mix.m, rg, rl, rm, least(rg, rl, rm) AS lo FROM mix JOIN br USING (well)),
c AS (SELECT y, (g+l+m)/3 AS mean, list_median([g,l,m]) AS median, CASE WHEN rg <= rl AND rg <= rm THEN g WHEN rl <= rm THEN l ELSE m END AS best,
  (g/rg+l/rl+m/rm)/(1/rg+1/rl+1/rm) AS wrmse, (g/rg**2+l/rl**2+m/rm**2)/(1/rg**2+1/rl**2+1/rm**2) AS inv2, (g/rg**4+l/rl**4+m/rm**4)/(1/rg**4+1/rl**4+1/rm**4) AS inv4,
  (g*exp(-rg/lo)+l*exp(-rl/lo)+m*exp(-rm/lo))/(exp(-rg/lo)+exp(-rl/lo)+exp(-rm/lo)) AS soft,
  (g*exp(-(rg**2)/lo**2)+l*exp(-(rl**2)/lo**2)+m*exp(-(rm**2)/lo**2))/(exp(-(rg**2)/lo**2)+exp(-(rl**2)/lo**2)+exp(-(rm**2)/lo**2)) AS softmax,
  (g+l+m - CASE WHEN rm >= rg AND rm >= rl THEN m WHEN rl >= rg THEN l ELSE g END)/2 AS top2 FROM j)
{' UNION ALL '.join(f"SELECT '{v}' AS variant, count(*) AS n, sqrt(avg((y - {v})**2)) AS rmse FROM c" for v in MODES)}""")
def surface_combine(spark, sf):
    """Nine ways to merge three predictions by their known-part error, scored in one pass."""
    t = mix(spark, sf).join(backtest_scores(spark, sf), "well")
    return U.wide_sweep(t, {k: err2(v) for k, v in U.combine(MEM, ["rg", "rl", "rm"]).items()})


POST = list(product([0.9, 1.0], [0, 50, 150], [0.0, 0.2]))


@query("postprocess_sweep", "F20", "variant:s n:l rmse:d", f"""
WITH {MIX}, v(a, t, w) AS (VALUES {', '.join(f'({a}, {t}, {w})' for a, t, w in POST)}),
e AS (SELECT a || '_' || t || '_' || w AS variant, y - f - a * ((g - f) * (1 - w) + (m - f) * w) * CASE WHEN t > 0 THEN 1 - exp(-greatest(md_since, 0) / t) ELSE 1 END AS e FROM mix, v)
SELECT variant, count(*) AS n, sqrt(avg(e*e)) AS rmse FROM e GROUP BY variant""")
def postprocess_sweep(spark, sf):
    """Shrink, ramp and member share applied to the deviation from the last known value."""
    v = {}
    for a, tau, w in POST:
        d = (F.col("g") - F.col("f")) * (1 - w) + (F.col("m") - F.col("f")) * w
        d = d * ramp_up(F.col("md_since"), float(tau)) if tau else d
        v[f"{a}_{tau}_{w}"] = err2(F.col("f") + a * d)
    return U.wide_sweep(mix(spark, sf), v)


ALPHAS, TAUS, SHARES = [0.8, 0.85, 0.9, 0.95, 1.0], [0, 50, 85, 150], [0.0, 0.05, 0.1, 0.15, 0.2]


@query("postprocess_smoothed", "F20", "alpha:d tau:l share:d smooth:b n:l rmse:d", f"""
WITH {MIX}, r AS (SELECT well, seq - cut AS i, n_pred AS n, least(17, n_pred - (n_pred + 1) % 2) AS wl, t, y - f AS r, rp * (g - f) AS a, rp * (m - f) AS b
  FROM (SELECT *, CASE WHEN t > 0 THEN 1 - exp(-greatest(md_since, 0) / t) ELSE 1 END AS rp FROM mix, (SELECT unnest({TAUS}) AS t))),
w AS (SELECT *, (wl - 1) // 2 AS m, greatest(0, least(i - (wl - 1) // 2, n - wl)) AS st FROM r),
j AS (SELECT a.well, a.t, a.i, a.r, a.a AS sa, a.b AS sb, a.wl, CAST(a.m AS DOUBLE) AS m, CAST(a.i - a.st - a.m AS DOUBLE) AS u,
  CAST(b.i - a.st - a.m AS DOUBLE) AS q, b.a AS a, b.b AS b FROM w a JOIN w b ON a.well = b.well AND a.t = b.t AND b.i BETWEEN a.st AND a.st + greatest(a.wl, 1) - 1),
k AS (SELECT *, m * (m + 1) AS k, 2 * m + 1 AS n0, (2 * m - 1) * (2 * m + 3) AS e FROM j),
c AS (SELECT *, 1 / n0 + q * u * 3 / (k * n0) + (q*q - k/3) * (u*u - k/3) * 45 / (k * n0 * e)
  + (q*q*q - q*(3*k-1)/5) * (u*u*u - u*(3*k-1)/5) * 175 / (k * n0 * e * (m-1) * (m+2)) AS c FROM k),
s AS (SELECT t, any_value(r) AS r, CASE WHEN any_value(wl) >= 5 THEN sum(c * a) ELSE any_value(sa) END AS a, CASE WHEN any_value(wl) >= 5 THEN sum(c * b) ELSE any_value(sb) END AS b FROM c GROUP BY well, t, i),
x AS (SELECT t, false AS smooth, r, a, b FROM r UNION ALL SELECT t, true, r, a, b FROM s)
SELECT alpha, t AS tau, share, smooth, count(*) AS n, sqrt(avg((r - alpha * ((1 - share) * a + share * b)) ** 2)) AS rmse
FROM x, (SELECT unnest({ALPHAS})::DOUBLE AS alpha), (SELECT unnest({SHARES})::DOUBLE AS share) GROUP BY alpha, t, share, smooth""", digits=5)
def postprocess_smoothed(spark, sf):
    """Shrink, ramp, member share and smoothing: 200 settings.  Smoothing is linear, so the two deviations are smoothed once per ramp."""
    t, raw, smooth = mix(spark, sf), {}, {}
    for tau in TAUS:
        ramp = ramp_up(F.col("md_since"), float(tau)) if tau else F.lit(1.0)
        t = t.withColumns({f"a{tau}": ramp * (F.col("g") - F.col("f")), f"b{tau}": ramp * (F.col("m") - F.col("f"))})
        raw[(tau, False)] = (F.col(f"a{tau}"), F.col(f"b{tau}"))
        smooth[(tau, True)] = (F.col(f"sa{tau}"), F.col(f"sb{tau}"))
    t = S.savgol_many(t, ["well"], {f"s{c}{tau}": f"{c}{tau}" for tau in TAUS for c in "ab"}, F.col("seq") - F.col("cut"), F.col("n_pred"))
    g = U.postprocess_grid(t, raw | smooth, F.col("y") - F.col("f"), ALPHAS, SHARES)
    return g.withColumnsRenamed({"c0": "tau", "c1": "smooth"})


FULL = ["mean", "median", "best", "topn", "winv", "softmax"]


@query("surface_combine_full", "F19", "variant:s known:b n:l rmse:d", f"""
WITH {B.SERIES}, a AS (SELECT well, max(tvt) FILTER (seq = cut - 1) AS f, max(z) FILTER (seq = cut - 1) AS z0, avg(tvt) FILTER (seq < cut) AS p,
  regr_slope(tvt, md) FILTER (seq < cut) AS sl, regr_intercept(tvt, md) FILTER (seq < cut) AS ic FROM ev GROUP BY well),
x AS (SELECT well, seq, seq < cut AS known, cut, tvt AS y, ic + sl * md AS g, CASE WHEN well % 3 <> 0 OR event_id % 5 <> 0 THEN f + z0 - z END AS l,
  CASE WHEN well % 4 <> 0 OR seq >= cut THEN p + (event_id * 7919 % 201 - 100) / 20.0 END AS m FROM ev JOIN a USING (well)),
e AS (SELECT well, {', '.join(f"avg((y-{c})**2) FILTER (seq < cut AND seq >= cut - 40) AS e{c}, coalesce(bool_and({c} IS NOT NULL) FILTER (seq >= cut), false) AS k{c}" for c in MEM)} FROM x GROUP BY well),
k AS (SELECT well, {', '.join(f"CASE WHEN k{c} OR NOT (kg OR kl OR km) THEN e{c} END AS e{c}, k{c} OR NOT (kg OR kl OR km) AS k{c}" for c in MEM)} FROM e),
w AS (SELECT *, greatest(least(eg, el, em), 1e-6) AS lo, list_sort(list_filter([{', '.join(f"{{'e': e{c}, 'i': {i}}}" for i, c in enumerate(MEM))}], lambda s: s.e IS NOT NULL)) AS o FROM k),
v AS (SELECT well, known, y, list_filter([{', '.join(f"CASE WHEN k{c} THEN {c} END" for c in MEM)}], lambda q: q IS NOT NULL) AS p, list_transform(o[1:2], lambda s: [g, l, m][s.i + 1]) AS b,
  {', '.join(f"coalesce(1 / greatest(e{c}, 1e-6), 0) AS i{c}, coalesce(exp(-e{c} / lo), 0) AS s{c}" for c in MEM)}, coalesce(g, 0) AS g, coalesce(l, 0) AS l, coalesce(m, 0) AS m FROM x JOIN w USING (well)),
c AS (SELECT known, y, list_avg(p) AS mean, list_median(p) AS median, b[1] AS best, list_avg(b) AS topn,
  (ig*g + il*l + im*m) / nullif(ig + il + im, 0) AS winv, (sg*g + sl*l + sm*m) / nullif(sg + sl + sm, 0) AS softmax FROM v)
{' UNION ALL '.join(f"SELECT '{v}' AS variant, known, count({v}) AS n, sqrt(avg((y - {v})**2)) AS rmse FROM c GROUP BY known" for v in FULL)}""", digits=5)
def surface_combine_full(spark, sf):
    """Six ways to merge three predictions over whole series, known part included; two members have gaps."""
    s = B.evaluable(B.series(spark, sf))
    x = s.join(B.anchors(s).select("well", "f", "z0", "p", "sl", "ic"), "well")
    seq, cut, post = F.col("seq"), F.col("cut"), F.col("seq") >= F.col("cut")
    x = x.select("well", (~post).alias("known"), (~post & (seq >= cut - 40)).alias("scored"), F.col("tvt").alias("y"), (F.col("ic") + F.col("sl") * F.col("md")).alias("g"),
                 F.when((F.col("well") % 3 != 0) | (F.col("event_id") % 5 != 0), F.col("f") + F.col("z0") - F.col("z")).alias("l"),
                 F.when((F.col("well") % 4 != 0) | post, F.col("p") + (F.col("event_id") * 7919 % 201 - 100) / 20.0).alias("m"))
    e = x.groupBy("well").agg(*[F.avg(F.when(F.col("scored"), err2(F.col(c)))).alias(f"e{c}") for c in MEM],
                              *[F.coalesce(F.bool_and(F.when(~F.col("known"), F.col(c).isNotNull())), F.lit(False)).alias(f"k{c}") for c in MEM])
    p = U.combine_full(MEM, [f"e{c}" for c in MEM], [f"k{c}" for c in MEM])
    g = x.join(e, "well").groupBy("known").agg(*[f(err2(v)).alias(f"{t}_{k}") for k, v in p.items() for t, f in (("n", F.count), ("q", F.avg))])
    return g.select("known", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(f"n_{k}").alias("n"), F.sqrt(f"q_{k}").alias("rmse")) for k in FULL])))


THETA = {"g": [-0.3, 0.5, 0.2, -0.4], "m": [], "l": [-0.6, -0.2, 0.3, 0.25]}


@query("spread_point_weights", "F8", "well:l seq:l wg:d wm:d wl:d pred:d logpred:d", f"""
WITH {B.ENS}, mix AS (SELECT *, f + z0 - z AS l, p + (event_id * 7919 % 201 - 100) / 20.0 AS m FROM cand),
sd AS (SELECT well, seq, stddev_pop(value) AS sd FROM ens GROUP BY well, seq),
t AS (SELECT mix.*, sd, ln(1 + nn) AS x1, md_since / 1000 AS x2, {LN} AS ln, ln(greatest(sd, 0.1)) AS ls FROM mix JOIN sd USING (well, seq)),
z AS (SELECT t.*, coalesce((x1 - avg(x1) OVER ()) / nullif(stddev_pop(x1) OVER (), 0), 0) AS z1, coalesce((x2 - avg(x2) OVER ()) / nullif(stddev_pop(x2) OVER (), 0), 0) AS z2,
  coalesce((sd - avg(sd) OVER ()) / nullif(stddev_pop(sd) OVER (), 0), 0) AS z3 FROM t),
u AS (SELECT *, exp(-0.3 + 0.5*z1 + 0.2*z2 - 0.4*z3) AS eg, exp(-0.6 - 0.2*z1 + 0.3*z2 + 0.25*z3) AS el,
  exp(-0.2 + 0.4*x2 - 0.1*ln + 0.15*ls) AS ga, exp(-3 + 0.2*x2 + 0.3*ln - 0.1*ls) AS la FROM z)
SELECT well, seq, eg / (eg + 1 + el) AS wg, 1 / (eg + 1 + el) AS wm, el / (eg + 1 + el) AS wl, (eg*g + m + el*l) / (eg + 1 + el) AS pred, (ga*g + m + la*l) / (ga + 1 + la) AS logpred FROM u""")
def spread_point_weights(spark, sf):
    """Weights from distance, depth and the spread of the replicas: standardised coefficients, and stored ones on logarithms."""
    sd = B.ens(spark, sf).groupBy("well", "seq").agg(F.stddev_pop("value").alias("sd"))
    t = mix(spark, sf).join(sd, ["well", "seq"])
    md = F.col("md_since") / 1000
    w = U.standard_softmax(t, {"x1": F.log1p("nn"), "x2": md, "x3": F.col("sd")}, THETA, "w")
    ln, ls = F.log(F.greatest(F.col("nn"), F.lit(1.0))), F.log(F.greatest(F.col("sd"), F.lit(0.1)))
    stored = softmax([-0.2 + 0.4 * md - 0.1 * ln + 0.15 * ls, F.lit(0.0), -3 + 0.2 * md + 0.3 * ln - 0.1 * ls])
    order = ["g", "m", "l"]
    return w.select("well", "seq", "wg", "wm", "wl", blend([F.col(f"w{c}") for c in order], order).alias("pred"), blend(stored, order).alias("logpred"))


@query("greedy_layers", "F21", "step:l variant:s rmse:d")
def greedy_layers(spark, sf):
    """Forward chain of layers: each step scores the remaining layers in Spark and keeps the best one.

    Only the scores (one number per layer) reach the driver."""
    t = mix(spark, sf).withColumn("pred", F.col("g"))
    layers = {"shrink": lambda p: F.col("l") + 0.9 * (p - F.col("l")),
              "ramp": lambda p: F.col("f") + (p - F.col("f")) * ramp_up(F.col("md_since"), 500.0),
              "mean": lambda p: 0.5 * p + 0.5 * F.col("m")}
    rows, chain = [], F.col("pred")
    start = U.wide_sweep(t, {"start": err2(chain)}).first()
    rows.append((0, "start", float(start["rmse"])))
    left = dict(layers)
    while left:
        best = min(U.wide_sweep(t, {k: err2(f(chain)) for k, f in left.items()}).collect(), key=lambda r: (r["rmse"], r["variant"]))
        if best["rmse"] >= rows[-1][2]:
            break
        rows.append((len(rows), best["variant"], float(best["rmse"])))
        chain = left.pop(best["variant"])(chain)
    return spark.createDataFrame(rows, "step long, variant string, rmse double")
