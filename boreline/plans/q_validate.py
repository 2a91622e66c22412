"""Validation, resampling and oracle queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.small_solve import solve2
from ..operators import fuse as U
from ..operators import metrics as M
from ..operators import series as S
from ..operators import validate as V
from ..sources.store import materialize
from . import bindings as B
from .q_fusion import MEM, MIX, err2, mix
from .q_stats import ANCH, SSE, anchored
from .registry import query

SS = MIX + """, ss AS (SELECT well, count(*) AS n, sum((y-g)**2) AS g, sum((y-l)**2) AS l, sum((y-m)**2) AS m, sum((y-(g+m)/2)**2) AS b FROM mix GROUP BY well),
rk AS (SELECT *, row_number() OVER (ORDER BY n, well) - 1 AS idx, count(*) OVER () AS k FROM ss)"""


def well_sse(spark, sf):
    t = mix(spark, sf).withColumn("b", (F.col("g") + F.col("m")) / 2)
    return t.groupBy("well").agg(F.count(F.lit(1)).alias("n_pred"), *[F.sum(err2(F.col(c))).alias(c) for c in ["g", "l", "m", "b"]])


def ranked_sse(spark, sf):
    return V.ranked(well_sse(spark, sf), F.col("n_pred"), "well").drop("n").withColumnsRenamed({"seq": "idx", "n_pred": "n"})


@query("systematic_sample", "G1", "well:l n_pred:l", f"""
WITH {SS}, p AS (SELECT CAST(round_even(i * (k - 1) / 39.0::DOUBLE, 0) AS BIGINT) AS idx FROM (SELECT DISTINCT k FROM rk), (SELECT unnest(range(40)) AS i))
SELECT well, n AS n_pred FROM rk WHERE idx IN (SELECT idx FROM p)""")
def systematic_sample(spark, sf):
    return V.systematic_sample(well_sse(spark, sf), F.col("n_pred"), "well", 40)


def last_value(known, curve, wid):
    """Predictor of the harness query: carry the last known value."""
    v = known["tvt_input"].dropna()
    return [float(v.iloc[-1])] * int(known["tvt_input"].isna().sum())


@query("callback_harness", "G2", "well:l n_pred:l sse:d rmse:d", f"""
WITH {B.CAND} SELECT well, count(*) AS n_pred, sum((y-f)**2) AS sse, sqrt(avg((y-f)**2)) AS rmse FROM cand GROUP BY well""")
def callback_harness(spark, sf):
    """User predictor run per series on prediction-time columns, contract checked, scored in Spark."""
    s = B.series(spark, sf).select("well", "seq", "md", "z", F.col("grn").alias("gr"), "tvt", F.when(F.col("seq") < F.col("cut"), F.col("tvt")).alias("tvt_input"))
    curve = B.curve(spark, sf).select(F.col("k").cast("long").alias("well"), "k", "v")
    return V.score(s, V.evaluate(s, curve, last_value))


@query("group_folds", "G3", "fold:l groups:l n:l rmse:d", f"""
WITH {SS} SELECT idx % 5 AS fold, count(*) AS groups, sum(n) AS n, sqrt(sum(m) / sum(n)) AS rmse FROM rk GROUP BY 1""")
def group_folds(spark, sf):
    t = V.folds(well_sse(spark, sf), F.col("n_pred"), "well", 5)
    return t.groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_pred").alias("n"), F.sqrt(F.sum("m") / F.sum("n_pred")).alias("rmse"))


@query("subset_stability", "G4", "model:s mean:d sd:d pooled:d", f"""
WITH {SS}, f AS (SELECT idx % 5 AS fold, sqrt(sum(g)/sum(n)) AS g, sqrt(sum(l)/sum(n)) AS l, sqrt(sum(m)/sum(n)) AS m FROM rk GROUP BY 1)
{' UNION ALL '.join(f"SELECT '{c}' AS model, avg({c}) AS mean, stddev_samp({c}) AS sd, (SELECT sqrt(sum({c})/sum(n)) FROM ss) AS pooled FROM f" for c in MEM)}""")
def subset_stability(spark, sf):
    """Metric over five disjoint subsets: mean, deviation and pooled value."""
    t = M.unpivot(V.folds(well_sse(spark, sf), F.col("n_pred"), "well", 5), ["fold", "n_pred"], MEM, "model", "sse")
    f = t.groupBy("model", "fold").agg(F.sum("sse").alias("s"), F.sum("n_pred").alias("n"))
    r = F.sqrt(F.col("s") / F.col("n"))
    return f.groupBy("model").agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.sqrt(F.sum("s") / F.sum("n")).alias("pooled"))


UNIF = "CAST(('0x' || substr(md5(rep || ':' || idx), 1, 13)) AS BIGINT) / 4503599627370496.0"
BOOT = SS + f""", dr AS (SELECT rep, idx, {UNIF} AS u FROM rk, (SELECT unnest(range(200)) AS rep)),
dc AS (SELECT rep, idx, {' + '.join(f'CASE WHEN u >= {c!r} THEN 1 ELSE 0 END' for c in V.DRAW_CHANCES)} AS c FROM dr),
rp AS (SELECT rep, sqrt(sum(c * rk.g) / sum(c * n)) AS g, sqrt(sum(c * rk.m) / sum(c * n)) AS m, sqrt(sum(c * rk.b) / sum(c * n)) AS bl FROM dc JOIN rk USING (idx) GROUP BY rep)"""
SUBS = SS + f""", dr AS (SELECT rep, idx, {UNIF} AS u FROM rk, (SELECT unnest(range(200)) AS rep)),
dc AS (SELECT rep, idx FROM dr QUALIFY row_number() OVER (PARTITION BY rep ORDER BY u, idx) <= 60),
rp AS (SELECT rep, sqrt(sum(rk.m) / sum(n)) AS m, sqrt(sum(rk.b) / sum(n)) AS bl FROM dc JOIN rk USING (idx) GROUP BY rep)"""


@query("paired_bootstrap", "G5", "mean:d sd:d delta:d sd_delta:d p_better:d lo:d hi:d", f"""
WITH {BOOT} SELECT avg(bl) AS mean, stddev_pop(bl) AS sd, avg(bl - m) AS delta, stddev_pop(bl - m) AS sd_delta,
  avg(CASE WHEN bl < m THEN 1.0 ELSE 0 END) AS p_better, quantile_cont(bl, 0.025) AS lo, quantile_cont(bl, 0.975) AS hi FROM rp""")
def paired_bootstrap(spark, sf):
    r = materialize(ranked_sse(spark, sf), "sse")
    return V.bootstrap_report(V.bootstrap(r, ["g", "m", "b"], 200), "b", "m")


@query("paired_subsample", "G5", "mean:d sd:d delta:d sd_delta:d p_better:d lo:d hi:d", f"""
WITH {SUBS} SELECT avg(bl) AS mean, stddev_pop(bl) AS sd, avg(bl - m) AS delta, stddev_pop(bl - m) AS sd_delta,
  avg(CASE WHEN bl < m THEN 1.0 ELSE 0 END) AS p_better, quantile_cont(bl, 0.025) AS lo, quantile_cont(bl, 0.975) AS hi FROM rp""")
def paired_subsample(spark, sf):
    """The same for 60 groups drawn without replacement."""
    r = materialize(ranked_sse(spark, sf), "sse")
    return V.bootstrap_report(V.subsample(r, ["m", "b"], 200, 60), "b", "m")


@query("candidate_oracles", "G7", "oracle:s rmse:d", f"""
WITH {MIX}, w AS (SELECT well, count(*) AS n, sum((y-g)**2) AS g, sum((y-l)**2) AS l, sum((y-m)**2) AS m,
  sum(least((y-g)**2, (y-l)**2, (y-m)**2)) AS row_best, sum((y - least(greatest(y, least(g,l,m)), greatest(g,l,m)))**2) AS hull,
  var_pop(y-m) * count(*) AS off, count(*) * (var_pop(y-m) - coalesce(covar_pop(y-m, md_since)**2 / nullif(var_pop(md_since), 0), 0)) AS lin,
  count(*) * least(var_pop(y-g), var_pop(y-l), var_pop(y-m)) AS sel_off FROM mix GROUP BY well)
SELECT 'select' AS oracle, sqrt(sum(least(g,l,m)) / sum(n)) AS rmse FROM w {' '.join(f"UNION ALL SELECT '{c}', sqrt(sum({c}) / sum(n)) FROM w" for c in ['row_best', 'hull', 'off', 'lin', 'sel_off'])}""")
def candidate_oracles(spark, sf):
    """Lower bounds: best member per series and per row, convex hull, offset, offset and slope, selection and offset."""
    c = [F.col(m) for m in MEM]
    e = [F.col("y") - x for x in c]
    n, r, md = F.count(F.lit(1)), F.col("y") - F.col("m"), F.col("md_since")
    hull = F.least(F.greatest(F.col("y"), F.least(*c)), F.greatest(*c))
    w = mix(spark, sf).groupBy("well").agg(
        n.alias("n"), F.least(*[F.sum(x * x) for x in e]).alias("select"), F.sum(F.least(*[x * x for x in e])).alias("row_best"),
        F.sum(err2(hull)).alias("hull"), (n * F.var_pop(r)).alias("off"),
        (n * (F.var_pop(r) - F.coalesce(F.covar_pop(r, md) ** 2 / F.nullif(F.var_pop(md), F.lit(0.0)), F.lit(0.0)))).alias("lin"),
        (n * F.least(*[F.var_pop(x) for x in e])).alias("sel_off"))
    names = ["select", "row_best", "hull", "off", "lin", "sel_off"]
    return M.unpivot(w.agg(*[F.sqrt(F.sum(c_) / F.sum("n")).alias(c_) for c_ in names]), [], names, "oracle", "rmse")


@query("blend_oracles", "G7", "oracle:s n:l rmse:d", f"""
WITH {MIX}, c AS (SELECT well, count(*) AS n, sum((y-l)**2) AS rr, sum((y-l)*(g-l)) AS r1, sum((y-l)*(m-l)) AS r2, sum((g-l)**2) AS d11, sum((g-l)*(m-l)) AS d12, sum((m-l)**2) AS d22,
  sum(y*y) AS yy, sum(g*g) AS gg, sum(g*m) AS gm, sum(m*m) AS mm, sum(y*g) AS yg, sum(y*m) AS ym FROM mix GROUP BY well),
w AS (SELECT *, (r1*d22 - r2*d12) / (d11*d22 - d12*d12) AS w1, (r2*d11 - r1*d12) / (d11*d22 - d12*d12) AS w2, CASE WHEN d11 > 0 THEN least(greatest(r1 / d11, 0), 1) ELSE 0 END AS a,
  CASE WHEN d22 > 0 THEN least(greatest(r2 / d22, 0), 1) ELSE 0 END AS b, CASE WHEN d11 - 2*d12 + d22 > 0 THEN least(greatest((r1 - r2 - d12 + d22) / (d11 - 2*d12 + d22), 0), 1) ELSE 0 END AS e FROM c),
s AS (SELECT n, CASE WHEN w1 >= 0 AND w2 >= 0 AND w1 + w2 <= 1 THEN rr - 2*(w1*r1 + w2*r2) + w1*w1*d11 + 2*w1*w2*d12 + w2*w2*d22
  ELSE least(rr - 2*a*r1 + a*a*d11, rr - 2*b*r2 + b*b*d22, rr - 2*(e*r1 + (1-e)*r2) + e*e*d11 + 2*e*(1-e)*d12 + (1-e)*(1-e)*d22) END AS convex,
  rr - w1*r1 - w2*r2 AS sum_one, yy - (yg*(yg*mm - ym*gm) + ym*(ym*gg - yg*gm)) / (gg*mm - gm*gm) AS pair FROM w)
SELECT 'convex' AS oracle, sum(n) AS n, sqrt(sum(convex) / sum(n)) AS rmse FROM s UNION ALL SELECT 'sum_one', sum(n), sqrt(sum(sum_one) / sum(n)) FROM s UNION ALL SELECT 'pair', sum(n), sqrt(sum(pair) / sum(n)) FROM s""", digits=5)
def blend_oracles(spark, sf):
    """Best blend per series from one pass of sums: weights in the hull, weights of sum one, two free weights."""
    y, g, m, l = (F.col(c) for c in ("y", "g", "m", "l"))
    r, d1, d2 = y - l, g - l, m - l
    sums = {"rr": r * r, "r1": r * d1, "r2": r * d2, "d11": d1 * d1, "d12": d1 * d2, "d22": d2 * d2,
            "yy": y * y, "gg": g * g, "gm": g * m, "mm": m * m, "yg": y * g, "ym": y * m}
    t = mix(spark, sf).groupBy("well").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    c = F.col
    convex = U.convex_sse(*[c(k) for k in ("rr", "r1", "r2", "d11", "d12", "d22")])
    w, v = solve2(c("d11"), c("d12"), c("d22"), c("r1"), c("r2")), solve2(c("gg"), c("gm"), c("mm"), c("yg"), c("ym"))
    free = c("rr") - F.coalesce(w[0] * c("r1") + w[1] * c("r2"), F.lit(0.0))
    pair = c("yy") - F.coalesce(v[0] * c("yg") + v[1] * c("ym"), F.lit(0.0))
    names = ["convex", "sum_one", "pair"]
    t = t.select("n", convex.alias("convex"), free.alias("sum_one"), pair.alias("pair"))
    return M.unpivot(t.agg(F.sum("n").alias("n"), *[F.sqrt(F.sum(k) / F.sum("n")).alias(k) for k in names]), ["n"], names, "oracle", "rmse")


SHIFTS = 12


@query("shape_oracles", "G8", "well:l n:l quadratic:d plane:d shift:l shifted:d", f"""
WITH {ANCH}{B.CAND[len(B.SERIES):]}, o AS (SELECT pa.*, e.x, e.y AS yy FROM pa JOIN ev e ON e.well = pa.well AND e.seq = pa.seq WHERE pa.seq >= pa.cut),
m AS (SELECT well, count(*) AS n, var_pop(r) AS rr, var_pop(h) AS hh, var_pop(h*h) AS qq, covar_pop(h, h*h) AS hq, covar_pop(h, r) AS hr, covar_pop(h*h, r) AS qr,
  var_pop(x) AS xx, var_pop(yy) AS vy, covar_pop(x, yy) AS xy, covar_pop(x, r) AS xr, covar_pop(yy, r) AS yr FROM o GROUP BY well),
c AS (SELECT well, seq, cut, n, y, g, row_number() OVER (PARTITION BY well ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY well) AS k FROM cand),
s AS (SELECT a.well, d, sum((a.y - b.g)**2) AS sse FROM c a, (SELECT unnest(range(-{SHIFTS}, {SHIFTS + 1})) AS d) JOIN c b ON b.well = a.well AND b.i = greatest(0, least(a.k - 1, a.i - d)) GROUP BY a.well, d),
b AS (SELECT well, arg_min(d, (round(sse, 6), abs(d), d)) AS shift, min(sse) AS shifted FROM s GROUP BY well)
SELECT m.well, n, n * (rr - (qq*hr*hr - 2*hq*hr*qr + hh*qr*qr) / (hh*qq - hq*hq)) AS quadratic, n * (rr - (vy*xr*xr - 2*xy*xr*yr + xx*yr*yr) / (xx*vy - xy*xy)) AS plane, shift, shifted
FROM m JOIN b USING (well)""", digits=2)
def shape_oracles(spark, sf):
    """Error left after the best parabola, the best plane in the path's coordinates, and the best shift of a candidate along the
    series (its ends held); all from one pass of sums each."""
    r, h = F.col("r"), F.col("h")
    t = anchored(spark, sf).where(F.col("seq") >= F.col("cut"))
    xy = B.evaluable(B.series(spark, sf, xy=True)).select("well", "seq", F.col("x").alias("px"), F.col("y").alias("py"))

    def left(df, u, v):
        a = df.groupBy("well").agg(F.count(F.lit(1)).alias("n"), F.var_pop(r).alias("rr"), F.var_pop(u).alias("uu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("uv"),
                                   F.covar_pop(u, r).alias("ur"), F.covar_pop(v, r).alias("vr"))
        w = solve2(F.col("uu"), F.col("uv"), F.col("vv"), F.col("ur"), F.col("vr"))
        return a.select("well", "n", (F.col("n") * (F.col("rr") - w[0] * F.col("ur") - w[1] * F.col("vr"))).alias("sse"))

    both = t.select("well", "seq", "r", "h").join(xy, ["well", "seq"])
    quad = left(both, h, h * h).withColumnRenamed("sse", "quadratic")
    plane = left(both, F.col("px"), F.col("py")).select("well", F.col("sse").alias("plane"))
    c = B.cand(spark, sf).select("well", "y", "g", (F.col("seq") - F.col("cut")).alias("i"))
    ends = c.groupBy("well").agg(F.max(F.struct("i", "g")).alias("e"), F.min(F.struct("i", "g")).alias("b"))
    c = c.join(ends.select("well", F.col("e.g").alias("ge"), F.col("b.g").alias("gb")), "well")
    lags = [d for d in range(-SHIFTS, SHIFTS + 1)]
    c = S.framed(c, ["well"], SHIFTS, lambda w: {f"g{d}": F.lag("g", d).over(w) for d in lags}, seq="i")
    e = [F.sum((F.col("y") - F.coalesce(F.col(f"g{d}"), F.col("gb") if d > 0 else F.col("ge"))) ** 2).alias(f"s{d}") for d in lags]
    best = F.least(*[F.struct(F.round(F.col(f"s{d}"), 6).alias("k"), F.lit(abs(d)).alias("a"), F.lit(d).alias("d"), F.col(f"s{d}").alias("s")) for d in lags])
    shift = c.groupBy("well").agg(*e).select("well", best.alias("o")).select("well", F.col("o.d").alias("shift"), F.col("o.s").alias("shifted"))
    return quad.join(plane, "well").join(shift, "well")


@query("trend_oracles", "G8", "well:l n:l base:d const:d line:d anchored:d", f"""
WITH {ANCH} SELECT well, count(*) AS n, sum(r*r) AS base, count(*) * var_pop(r) AS const,
  count(*) * (var_pop(r) - coalesce(covar_pop(r, h)**2 / nullif(var_pop(h), 0), 0)) AS line, sum(r*r) - sum(r*h)**2 / sum(h*h) AS anchored
FROM pa WHERE seq >= cut GROUP BY well""", digits=3)
def trend_oracles(spark, sf):
    """Error left after the best constant, line, and line through the last known row, from moments."""
    r, h, n = F.col("r"), F.col("h"), F.count(F.lit(1))
    return anchored(spark, sf).where(F.col("seq") >= F.col("cut")).groupBy("well").agg(
        n.alias("n"), F.sum(r * r).alias("base"), (n * F.var_pop(r)).alias("const"),
        (n * (F.var_pop(r) - F.coalesce(F.covar_pop(r, h) ** 2 / F.nullif(F.var_pop(h), F.lit(0.0)), F.lit(0.0)))).alias("line"),
        (F.sum(r * r) - F.sum(r * h) ** 2 / F.sum(h * h)).alias("anchored"))


@query("lowpass_oracle", "G8", "well:l sse:d", f"""
WITH {ANCH}, p AS (SELECT well, seq - cut AS i, count(*) OVER (PARTITION BY well) AS n, r FROM pa WHERE seq >= cut),
w AS (SELECT d, exp(-0.5 * (d / 2.0) ** 2) AS w FROM (SELECT unnest(range(-8, 9)) AS d)),
s AS (SELECT a.well, a.i, any_value(a.r) AS r, sum(w.w * b.r) / sum(w.w) AS low FROM p a, w JOIN p b ON a.well = b.well AND b.i = greatest(0, least(a.n - 1, a.i + w.d)) GROUP BY a.well, a.i)
SELECT well, sum((r - low)**2) AS sse FROM s GROUP BY well""", digits=3)
def lowpass_oracle(spark, sf):
    t = anchored(spark, sf).where(F.col("seq") >= F.col("cut")).select("well", "seq", "r")
    t = S.gaussian_lowpass(t, ["well"], "r", 2.0, "low")
    return t.groupBy("well").agg(F.sum((F.col("r") - F.col("low")) ** 2).alias("sse"))


@query("paired_variant_report", "G9", "variant:s delta:d beyond_noise:b same_sign:b", f"""
WITH {SS}, f AS (SELECT idx % 3 AS s, sqrt(sum(g)/sum(n)) - sqrt(sum(m)/sum(n)) AS g, sqrt(sum(l)/sum(n)) - sqrt(sum(m)/sum(n)) AS l, sqrt(sum(b)/sum(n)) - sqrt(sum(m)/sum(n)) AS b FROM rk GROUP BY 1),
a AS (SELECT sqrt(sum(g)/sum(n)) - sqrt(sum(m)/sum(n)) AS g, sqrt(sum(l)/sum(n)) - sqrt(sum(m)/sum(n)) AS l, sqrt(sum(b)/sum(n)) - sqrt(sum(m)/sum(n)) AS b FROM rk)
{' UNION ALL '.join(f"SELECT '{c}' AS variant, (SELECT {c} FROM a) AS delta, abs((SELECT {c} FROM a)) > 0.35 AS beyond_noise, bool_and(sign({c}) = sign((SELECT {c} FROM a))) AS same_sign FROM f" for c in ['g', 'l', 'b'])}""")
def paired_variant_report(spark, sf):
    """Variants against a control: difference, whether it exceeds the noise threshold, and whether all subsets agree."""
    t = M.unpivot(ranked_sse(spark, sf).withColumn("s", F.col("idx") % 3), ["s", "n", "m"], ["g", "l", "b"], "variant", "sse")
    f = t.groupBy("variant", "s").agg(F.sum("sse").alias("v"), F.sum("m").alias("c"), F.sum("n").alias("n"))
    d = F.sqrt(F.col("v") / F.col("n")) - F.sqrt(F.col("c") / F.col("n"))
    a = f.groupBy("variant").agg((F.sqrt(F.sum("v") / F.sum("n")) - F.sqrt(F.sum("c") / F.sum("n"))).alias("delta"),
                                 F.min(F.signum(d)).alias("lo"), F.max(F.signum(d)).alias("hi"))
    sg = F.signum("delta")
    return a.withColumn("beyond_noise", F.abs("delta") > 0.35).withColumn("same_sign", (F.col("lo") == sg) & (F.col("hi") == sg))


@query("calibrated_score", "G10", "rmse:d proxy:d estimate:d", f"""
WITH {SSE} SELECT sqrt(sum(sse_s)/sum(n)) AS rmse, sqrt(sum(sse_s) FILTER (n >= 23) / sum(n) FILTER (n >= 23)) AS proxy, sqrt(sum(sse_s)/sum(n)) * 46.615 / 39.429 AS estimate FROM sse""")
def calibrated_score(spark, sf):
    """Pooled error, error of the long series, and the extrapolation by a measured factor (46.615 / 39.429)."""
    t = M.sse_table(B.cand(spark, sf), ["well"], "y", ["s"])
    long = F.col("n") >= 23
    r = F.sqrt(F.sum("sse_s") / F.sum("n"))
    return t.agg(r.alias("rmse"), F.sqrt(F.sum(F.when(long, F.col("sse_s"))) / F.sum(F.when(long, F.col("n")))).alias("proxy"),
                 (r * 46.615 / 39.429).alias("estimate"))


CFG = [(t, a) for t in (5, 10, 20) for a in (0.5, 1.0)]


@query("config_grid", "G11", "tail:l alpha:d subset:s n:l rmse:d", f"""
WITH {B.SERIES}, c(tail, alpha) AS (VALUES {', '.join(f'({t}, {a})' for t, a in CFG)}), l AS (SELECT well, tail, median(tvt) AS m FROM ev, (SELECT DISTINCT tail FROM c) WHERE seq < cut AND seq >= cut - tail GROUP BY 1, 2),
f AS (SELECT well, max(tvt) AS f FROM ev WHERE seq = cut - 1 GROUP BY well),
e AS (SELECT well, tail, alpha, tvt - alpha * m - (1 - alpha) * f AS e FROM ev JOIN l USING (well) JOIN c USING (tail) JOIN f USING (well) WHERE seq >= cut)
SELECT tail, alpha, 'all' AS subset, count(*) AS n, sqrt(avg(e*e)) AS rmse FROM e GROUP BY 1, 2 UNION ALL SELECT tail, alpha, 'even', count(*), sqrt(avg(e*e)) FROM e WHERE well % 2 = 0 GROUP BY 1, 2""")
def config_grid(spark, sf):
    """Configurations as rows: every level needed is computed once, every score is one sum."""
    s = B.evaluable(B.series(spark, sf))
    seq, cut = F.col("seq"), F.col("cut")
    lev = s.where((seq < cut) & (seq >= cut - 20)).groupBy("well").agg(
        F.max(F.when(seq == cut - 1, F.col("tvt"))).alias("f"), *[F.median(F.when(seq >= cut - t, F.col("tvt"))).alias(f"m{t}") for t in (5, 10, 20)])
    t = s.where(seq >= cut).join(lev, "well").withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("well") % 2 == 0, "even")))))
    v = {f"{k}_{a}": (F.col("tvt") - a * F.col(f"m{k}") - (1 - a) * F.col("f")) ** 2 for k, a in CFG}
    r = U.wide_sweep(t, v, ["subset"])
    return r.withColumn("tail", F.split("variant", "_")[0]).withColumn("alpha", F.split("variant", "_")[1])


@query("pipeline_parity", "G12", "rows:l max_diff:d beyond:l one_sided:l", f"""
WITH {B.CAND}, k AS (SELECT * FROM cand WHERE event_id % 50 <> 0) SELECT count(*) AS rows, 0.0 AS max_diff, 0 AS beyond, count(*) FILTER (event_id % 50 = 0) AS one_sided FROM cand""")
def pipeline_parity(spark, sf):
    """The same column computed two ways; rows missing on one side are counted."""
    c = B.cand(spark, sf)
    a = c.select("well", "seq", F.col("md_since").alias("v"))
    b = c.where("event_id % 50 <> 0").select("well", "seq", (F.col("md") - F.col("md0")).alias("v"))
    return V.parity(a, b, ["well", "seq"], "v", 1e-9)


@query("key_set_algebra", "G13", "op:s keys:l", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)
SELECT 'union' AS op, count(*) AS keys FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'shared_parts', count(*) FROM (SELECT k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) INTERSECT SELECT k FROM b)""")
def key_set_algebra(spark, sf):
    """Union, intersection and difference of key sets; the last row proves fit and evaluation keys disjoint."""
    a = B.table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("k"))
    b = B.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    only = a.subtract(b)
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_a": only, "shared_parts": only.intersect(b)}
    return reduce(lambda x, y: x.unionByName(y), [d.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(k).alias("op"), "keys") for k, d in parts.items()])


@query("fix_worst_series", "G14", "k:l rmse:d", f"""
WITH {MIX}, w AS (SELECT well, count(*) AS n, sum((y-m)**2) AS s, least(sum((y-g)**2), sum((y-l)**2), sum((y-m)**2)) AS best FROM mix GROUP BY well),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, well) AS r FROM w), k AS (SELECT unnest([10, 20, 50]) AS k)
SELECT k, sqrt(sum(CASE WHEN r <= k THEN best ELSE s END) / sum(n)) AS rmse FROM r, k GROUP BY k""")
def fix_worst_series(spark, sf):
    """Pooled error if the k worst series used their best member."""
    c = mix(spark, sf).groupBy("well").agg(F.count(F.lit(1)).alias("n0"), F.sum(err2(F.col("m"))).alias("s"),
                                           F.least(*[F.sum(err2(F.col(m))) for m in MEM]).alias("best"))
    r = V.ranked(c, -F.col("s"), "well")
    a = r.agg(F.sum("n0").alias("n"), *[F.sum(F.when(F.col("seq") < k, F.col("best")).otherwise(F.col("s"))).alias(str(k)) for k in (10, 20, 50)])
    return M.unpivot(a, ["n"], ["10", "20", "50"], "k", "s").withColumn("rmse", F.sqrt(F.col("s") / F.col("n")))
