"""Aggregation and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import row_mean, row_median, row_std
from ..operators import calibrate as K
from ..operators import levels as LV
from ..operators import metrics as M
from ..operators import series as S
from ..operators.fuse import wide_sweep
from ..operators.lookup import curve_lookup
from ..operators.quantiles import group_quantiles
from . import bindings as B
from .registry import query
from .sql_solve import sql_solve

PREDS = ["f", "s", "p", "g"]
NN_EDGES = [0, 50, 100, 200, 300, 450, 600, 800, 1000]
MD_EDGES = [0, 100, 250, 500, 1000, 1500, 2000, 1e9]
MIN_BIN = 200


def sq(a, b="y"):
    return (F.col(b) - F.col(a)) * (F.col(b) - F.col(a))


def sql_bins(x, edges):
    """CASE for [lo,hi) bins with the ends clipped."""
    whens = " ".join(f"WHEN {x} < {edges[i + 1]} THEN {i}" for i in range(len(edges) - 2))
    return f"(CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {len(edges) - 2} END)"


SSE = B.CAND + """, sse AS (SELECT well, count(*) AS n, n AS n_all, sum((y-f)**2) AS sse_f, sum((y-s)**2) AS sse_s,
  sum((y-p)**2) AS sse_p, sum((y-g)**2) AS sse_g FROM cand GROUP BY well, n)"""
POOL = " UNION ALL ".join(f"SELECT '{p}' AS pred, count(*) AS groups, sum(n) AS n, sqrt(sum(sse_{p}) / sum(n)) AS rmse FROM sse {{w}}"
                          for p in PREDS)


@query("rmse_per_series", "E1", "well:l n:l sse_f:d sse_s:d sse_p:d sse_g:d", f"WITH {SSE} SELECT * FROM sse", digits=4)
def rmse_per_series(spark, sf):
    return M.sse_table(B.cand(spark, sf), ["well"], "y", PREDS)


@query("rmse_pooled", "E1", "pred:s groups:l n:l rmse:d", f"WITH {SSE} {POOL.format(w='')}")
def rmse_pooled(spark, sf):
    return M.pooled(M.sse_table(B.cand(spark, sf), ["well"], "y", PREDS), PREDS)


@query("rmse_long_series", "E2", "pred:s groups:l n:l rmse:d",
       f"WITH {SSE} {POOL.format(w='WHERE n >= 23 AND 1 - n / n_all <= 0.66')}")
def rmse_long_series(spark, sf):
    t = M.sse_table(B.cand(spark, sf).withColumnRenamed("n", "n_all"), ["well", "n_all"], "y", PREDS)
    return M.pooled(t, PREDS, (F.col("n") >= 23) & (1 - F.col("n") / F.col("n_all") <= 0.66))


@query("rmse_distribution", "E3", "q50:d q90:d mx:d mn:d mean:d sd:d", f"""
WITH {SSE}, r AS (SELECT sqrt(sse_s / n) AS r FROM sse) SELECT quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.9) AS q90,
  max(r) AS mx, min(r) AS mn, avg(r) AS mean, stddev_samp(r) AS sd FROM r""")
def rmse_distribution(spark, sf):
    r = M.sse_table(B.cand(spark, sf), ["well"], "y", ["s"]).select(F.sqrt(F.col("sse_s") / F.col("n")).alias("r"))
    q = group_quantiles(r, [], F.col("r"), {"q50": 0.5, "q90": 0.9}).withColumn("one", F.lit(1))
    a = r.agg(F.max("r").alias("mx"), F.min("r").alias("mn"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    return q.join(a.withColumn("one", F.lit(1)), "one")


@query("whole_table_quantiles", "E3", "l_returnflag:s q05:d q50:d q95:d", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS q05, quantile_cont(l_extendedprice, 0.5) AS q50,
  quantile_cont(l_extendedprice, 0.95) AS q95 FROM lineitem GROUP BY l_returnflag""")
def whole_table_quantiles(spark, sf):
    """Three groups over all of lineitem: exact quantiles although each group is a third of the table."""
    return group_quantiles(B.table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"),
                           {"q05": 0.05, "q50": 0.5, "q95": 0.95})


@query("group_offset", "E4", "grp:l c1:d c2:d c3:d", f"""
WITH {B.CLOUD}, m AS (SELECT grp, median(y - h1 / 1000) AS a, median(y - h2) AS b, median(y - h3) AS c FROM cloud GROUP BY grp)
SELECT grp, a AS c1, coalesce(b, (a + c) / 2) AS c2, c AS c3 FROM m""")
def group_offset(spark, sf):
    """Median offset per group and horizon; a horizon missing in a group takes the median of the others."""
    c = B.cloud(spark, sf).select("grp", (F.col("y") - F.col("h1") / 1000).alias("c1"),
                                  (F.col("y") - F.col("h2")).alias("c2"), (F.col("y") - F.col("h3")).alias("c3"))
    long = M.unpivot(c, ["grp"], ["c1", "c2", "c3"], "h", "v")
    q = group_quantiles(long, ["grp", "h"], F.col("v"), {"m": 0.5})
    cols = ["c1", "c2", "c3"]
    t = q.groupBy("grp").agg(*[F.max(F.when(F.col("h") == h, F.col("m"))).alias(h) for h in cols])
    other = row_median([F.col(h) for h in cols])
    return t.select("grp", *[F.coalesce(F.col(h), other, F.lit(0.0)).alias(h) for h in cols])


def huber_sql(base: str, start: str, rounds: int) -> str:
    """Unrolled rounds over base(well, v, w) from start(well, c)."""
    out, prev = [], start
    for i in range(rounds):
        out.append(f"d{i} AS MATERIALIZED (SELECT b.well, 1.345 * (1.4826 * median(abs(v - c)) + 1e-9) AS k FROM {base} b JOIN {prev} p USING (well) GROUP BY b.well)")
        out.append(f"""c{i} AS MATERIALIZED (SELECT well, CASE WHEN done OR abs(nc - c) < 1e-6 THEN c ELSE nc END AS c,
  done OR abs(nc - c) < 1e-6 AS done FROM (SELECT b.well, any_value(p.c) AS c, any_value(p.done) AS done,
  sum(v * w * least(1.0, k / greatest(abs(v - p.c), 1e-12))) / sum(w * least(1.0, k / greatest(abs(v - p.c), 1e-12))) AS nc
  FROM {base} b JOIN {prev} p USING (well) JOIN d{i} USING (well) GROUP BY b.well))""")
        prev = f"c{i}"
    return ",\n".join(out)


TAILW = B.SERIES + """, t AS (SELECT well, seq, tvt AS v, exp(-(cut - 1 - seq) / 40.0) AS w, tvt + z AS u, cut FROM ev
  WHERE seq < cut AND seq >= cut - 30)"""
LEVELS = TAILW + """, o AS (SELECT *, sum(w) OVER (PARTITION BY well ORDER BY v, w) AS cw, sum(w) OVER (PARTITION BY well) AS tw FROM t),
wm AS MATERIALIZED (SELECT well, min(v) AS c, false AS done FROM o WHERE cw >= 0.5 * tw GROUP BY well),
q AS (SELECT well, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM t GROUP BY well), """ + huber_sql("t", "wm", 15)


@query("robust_levels", "E5", "well:l wmedian:d mean:d trim10:d huber:d last:d", f"""
WITH {LEVELS} SELECT t.well, any_value(wm.c) AS wmedian, sum(v * w) / sum(w) AS mean,
  sum(v * w) FILTER (v >= lo AND v <= hi) / sum(w) FILTER (v >= lo AND v <= hi) AS trim10, any_value(c14.c) AS huber,
  max(v) FILTER (seq = cut - 1) AS last
FROM t JOIN wm USING (well) JOIN q USING (well) JOIN c14 USING (well) GROUP BY t.well""")
def robust_levels(spark, sf):
    s = B.evaluable(B.series(spark, sf))
    w = F.exp(-(F.col("cut") - 1 - F.col("seq")) / 40.0)
    return K.robust_levels(K.tail_arrays(s, ["well"], 30, {"v": F.col("tvt"), "w": w}), ["well"])


LONG_LEVELS = LEVELS.replace("WHERE seq < cut AND seq >= cut - 30", "WHERE seq < cut")


@query("robust_levels_long", "E5", "well:l wmedian:d mean:d trim10:d huber:d last:d", f"""
WITH {LONG_LEVELS} SELECT t.well, any_value(wm.c) AS wmedian, sum(v * w) / sum(w) AS mean,
  sum(v * w) FILTER (v >= lo AND v <= hi) / sum(w) FILTER (v >= lo AND v <= hi) AS trim10, any_value(c14.c) AS huber,
  max(v) FILTER (seq = cut - 1) AS last
FROM t JOIN wm USING (well) JOIN q USING (well) JOIN c14 USING (well) GROUP BY t.well""", digits=4)
def robust_levels_long(spark, sf):
    """Levels over the whole known part, however long it is."""
    s = B.evaluable(B.series(spark, sf)).where(F.col("seq") < F.col("cut"))
    return LV.robust_levels(s, ["well"], F.col("tvt"), F.exp(-(F.col("cut") - 1 - F.col("seq")) / 40.0))


@query("observation_weights", "E6", "well:l seq:l inv1:d inv2:d recent:d", f"""
WITH {B.SERIES}, a AS (SELECT well, max(z) AS z0 FROM ev WHERE seq = cut - 1 GROUP BY well)
SELECT ev.well, seq, 1 / (1 + 10 * abs(z - z0) / 300) AS inv1, 1 / (1 + (10 * abs(z - z0) / 300) ** 2) AS inv2,
  exp(-(cut - 1 - seq) / 40.0) AS recent FROM ev JOIN a USING (well) WHERE seq < cut""")
def observation_weights(spark, sf):
    s = B.series(spark, sf)
    a = B.anchors(s).select("well", "z0")
    nn = 10 * F.abs(F.col("z") - F.col("z0")) / 300
    return B.evaluable(s).where(F.col("seq") < F.col("cut")).join(a, "well").select(
        "well", "seq", (1 / (1 + nn)).alias("inv1"), (1 / (1 + nn * nn)).alias("inv2"),
        F.exp(-(F.col("cut") - 1 - F.col("seq")) / 40.0).alias("recent"))


WINDOWS = [(5, 0), (10, 0), (20, 0), (20, 10), (1000000, 0), (1000000, 20)]
WIN_SQL = ", ".join(f"({a}, {b})" for a, b in WINDOWS)


@query("level_window_profile", "E7", "a:l b:l bias_rms:d bias_med:d rmse:d n_med:d", f"""
WITH {B.SERIES}, w(a, b) AS (VALUES {WIN_SQL}),
l AS (SELECT well, a, b, median(tvt) AS c, count(*) AS k FROM ev, w WHERE seq < cut - b AND seq >= cut - a GROUP BY well, a, b HAVING count(*) >= 5),
e AS (SELECT well, count(*) AS n, sum(tvt) AS s1, sum(tvt * tvt) AS s2 FROM ev WHERE seq >= cut GROUP BY well)
SELECT a, b, sqrt(avg((c - s1 / n) ** 2)) AS bias_rms, median(abs(c - s1 / n)) AS bias_med,
  sqrt(sum(s2 - 2 * c * s1 + n * c * c) / sum(n)) AS rmse, median(k) AS n_med FROM l JOIN e USING (well) GROUP BY a, b""")
def level_window_profile(spark, sf):
    """Level taken from lagged windows of the known part, judged on the rest; moments instead of a second scan."""
    s = B.evaluable(B.series(spark, sf))
    spec = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in WINDOWS])
    pre = s.where(F.col("seq") < F.col("cut")).select("well", "seq", "cut", "tvt", F.inline(spec))
    pre = pre.where((F.col("seq") < F.col("cut") - F.col("b")) & (F.col("seq") >= F.col("cut") - F.col("a")))
    keys = ["well", "a", "b"]
    lev = group_quantiles(pre, keys, F.col("tvt"), {"c": 0.5}).join(
        pre.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= 5), keys)
    e = s.where(F.col("seq") >= F.col("cut")).groupBy("well").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tvt").alias("s1"), F.sum(F.col("tvt") * F.col("tvt")).alias("s2"))
    t = lev.join(e, "well").withColumn("bias", F.col("c") - F.col("s1") / F.col("n"))
    m = t.groupBy("a", "b").agg(
        F.sqrt(F.avg(F.col("bias") ** 2)).alias("bias_rms"),
        F.sqrt(F.sum(F.col("s2") - 2 * F.col("c") * F.col("s1") + F.col("n") * F.col("c") ** 2) / F.sum("n")).alias("rmse"))
    q1 = group_quantiles(t, ["a", "b"], F.abs("bias"), {"bias_med": 0.5})
    q2 = group_quantiles(t, ["a", "b"], F.col("k"), {"n_med": 0.5})
    return m.join(q1, ["a", "b"]).join(q2, ["a", "b"])


@query("level_anchor_mix", "E7", "alpha:d rmse:d", f"""
WITH {B.CAND}, a AS (SELECT unnest([0, 0.25, 0.5, 0.75, 1.0]) AS alpha)
SELECT alpha, sqrt(avg((y - alpha * s - (1 - alpha) * f) ** 2)) AS rmse FROM cand, a GROUP BY alpha""")
def level_anchor_mix(spark, sf):
    """Mix of tail level and last value, scored for all weights from one set of cross moments."""
    d, r = F.col("s") - F.col("f"), F.col("y") - F.col("f")
    m = B.cand(spark, sf).agg(F.avg(r * r).alias("rr"), F.avg(r * d).alias("rd"), F.avg(d * d).alias("dd"))
    al = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("alpha")
    a = F.col("alpha")
    return m.select("rr", "rd", "dd", al).select("alpha", F.sqrt(F.col("rr") - 2 * a * F.col("rd") + a * a * F.col("dd")).alias("rmse"))


KEY = "least(greatest(1 + {x} / 8.0, 1), 50)"
SEGS = B.CURVE + """, seg AS (SELECT k AS k0, v AS v0, lead(k) OVER (ORDER BY k) AS k1, lead(v) OVER (ORDER BY k) AS v1 FROM curve)"""


def sql_lookup(rel: str, key: str, out: str, name: str) -> str:
    return f"""{name} AS (SELECT r.*, v0 + coalesce((v1 - v0) * ({key} - k0) / (k1 - k0), 0) AS {out} FROM {rel} r
  LEFT JOIN seg ON {key} >= k0 AND (k1 IS NULL OR {key} < k1))"""


CAL = f"{B.SERIES}, {SEGS}, pre AS (SELECT * FROM ev WHERE seq < cut), {sql_lookup('pre', KEY.format(x='tvt'), 'ref', 'pr')}"


def prefix_ref(spark, sf, s=None):
    s = B.evaluable(B.series(spark, sf) if s is None else s).where(F.col("seq") < F.col("cut"))
    return curve_lookup(s, 1 + F.col("tvt") / 8, B.curve(spark, sf), [], "ref")


@query("affine_calibration", "E8", "well:l pairs:l a:d b:d sigma:d", f"""
WITH {CAL}, m AS (SELECT well, count(grn) AS pairs, regr_slope(grn, ref) AS a, regr_intercept(grn, ref) AS b FROM pr
  WHERE grn IS NOT NULL GROUP BY well)
SELECT m.well, pairs, CASE WHEN pairs >= 30 THEN a ELSE 1 END AS a, CASE WHEN pairs >= 30 THEN b ELSE 0 END AS b,
  CASE WHEN pairs >= 30 THEN least(greatest(sg, 5), 60) END AS sigma
FROM m JOIN (SELECT pr.well, sqrt(avg((grn - a * ref - b) ** 2)) AS sg FROM pr JOIN m USING (well) WHERE grn IS NOT NULL GROUP BY pr.well) USING (well)""", digits=5)
def affine_calibration(spark, sf):
    return K.affine(prefix_ref(spark, sf), ["well"], F.col("grn"), F.col("ref"), min_pairs=30)


@query("noise_sigma", "E9", "well:l pairs:l sigma:d", f"""
WITH {CAL} SELECT well, count(grn) AS pairs, CASE WHEN count(grn) >= 35 THEN least(greatest(stddev_pop(grn - ref / 10), 20), 120) ELSE 30 END AS sigma
FROM pr GROUP BY well""")
def noise_sigma(spark, sf):
    return K.noise_sigma(prefix_ref(spark, sf), ["well"], F.col("grn") - F.col("ref") / 10, min_pairs=35)


ANCH = B.SERIES + """, an AS (SELECT well, max(md) AS md0, max(tvt + z) AS u0 FROM ev WHERE seq = cut - 1 GROUP BY well),
pa AS (SELECT ev.*, md - md0 AS h, tvt + z - u0 AS r FROM ev JOIN an USING (well))"""


def anchored(spark, sf):
    """Rows with distance h and residual r = tvt+z relative to the last known row."""
    s = B.evaluable(B.series(spark, sf))
    a = s.where(F.col("seq") == F.col("cut") - 1).select("well", F.col("md").alias("md0"),
                                                         (F.col("tvt") + F.col("z")).alias("u0"))
    return s.join(a, "well").withColumn("h", F.col("md") - F.col("md0")).withColumn(
        "r", F.col("tvt") + F.col("z") - F.col("u0"))


@query("anchored_slope", "E10", "well:l slope:d", f"""
WITH {ANCH} SELECT well, CASE WHEN count(*) > 10 AND sum(h * h) > 0 THEN sum(r * h) / sum(h * h) ELSE 0 END AS slope
FROM pa WHERE seq < cut AND seq >= cut - 20 GROUP BY well""")
def anchored_slope(spark, sf):
    t = anchored(spark, sf).where(S.in_last_known(20)).groupBy("well").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("h")).alias("rh"), F.sum(F.col("h") * F.col("h")).alias("hh"))
    return t.select("well", F.when((F.col("k") > 10) & (F.col("hh") > 0), F.col("rh") / F.col("hh")).otherwise(0.0).alias("slope"))


VARIANTS = ["flat", "lin15", "lin30", "linall", "shrink", "damped", "avg3"]


@query("dip_variants", "E11", "pred:s n:l rmse:d", f"""
WITH {ANCH}, sl AS (SELECT well, regr_slope(r, h) FILTER (seq >= cut - 15) AS a, regr_slope(r, h) FILTER (seq >= cut - 30) AS b,
  regr_slope(r, h) AS c FROM pa WHERE seq < cut GROUP BY well),
e AS (SELECT pa.r AS flat, r - a * h AS lin15, r - b * h AS lin30, r - c * h AS linall, r - 0.8 * b * h AS shrink,
  r - b * 1000 * (1 - exp(-h / 1000)) AS damped, r - (a + b + c) / 3 * h AS avg3 FROM pa JOIN sl USING (well) WHERE seq >= cut)
{' UNION ALL '.join(f"SELECT '{v}' AS pred, count(*) AS n, sqrt(avg({v} * {v})) AS rmse FROM e" for v in VARIANTS)}""", digits=5)
def dip_variants(spark, sf):
    """Least-squares slope on several windows of the known part; every variant scored in one pass."""
    t = anchored(spark, sf)
    pre = F.col("seq") < F.col("cut")
    sl = t.groupBy("well").agg(*[
        F.regr_slope(F.when(pre & (F.col("seq") >= F.col("cut") - w), F.col("r")),
                     F.when(pre & (F.col("seq") >= F.col("cut") - w), F.col("h"))).alias(n)
        for n, w in {"a": 15, "b": 30, "c": 10 ** 9}.items()])
    h, a, b, c = (F.coalesce(F.col(k), F.lit(0.0)) for k in "habc")
    pred = {"flat": F.lit(0.0), "lin15": a * h, "lin30": b * h, "linall": c * h, "shrink": 0.8 * b * h,
            "damped": b * 1000 * (1 - F.exp(-h / 1000)), "avg3": (a + b + c) / 3 * h}
    e = t.where(~pre).join(sl, "well").agg(F.count(F.lit(1)).alias("n"), *[
        F.sqrt(F.avg((F.col("r") - p) ** 2)).alias(n) for n, p in pred.items()])
    return M.unpivot(e, ["n"], VARIANTS, "pred", "rmse")


@query("parabola_extrapolation", "E12", "well:l c1:d c2:d rmse:d", f"""
WITH {ANCH}, w AS (SELECT well, h / 100 AS h, r FROM pa WHERE seq < cut AND seq >= cut - 30),
g AS (SELECT well, count(*) AS a0, sum(h) AS a1, sum(h**2) AS a2, sum(h**3) AS a3, sum(h**4) AS a4, sum(r) AS b0, sum(r*h) AS b1, sum(r*h*h) AS b2 FROM w GROUP BY well),
d AS (SELECT *, a0*(a2*a4-a3*a3) - a1*(a1*a4-a2*a3) + a2*(a1*a3-a2*a2) AS det FROM g),
c AS (SELECT well, (a0*(b1*a4-a3*b2) - b0*(a1*a4-a2*a3) + a2*(a1*b2-b1*a2)) / det AS c1,
  (a0*(a2*b2-b1*a3) - a1*(a1*b2-b1*a2) + b0*(a1*a3-a2*a2)) / det AS c2 FROM d)
SELECT pa.well, any_value(c1) AS c1, any_value(c2) AS c2, sqrt(avg((r - c1 * h / 100 - c2 * h * h / 1e4) ** 2)) AS rmse
FROM pa JOIN c USING (well) WHERE seq >= cut GROUP BY pa.well""", digits=3)
def parabola_extrapolation(spark, sf):
    t = anchored(spark, sf).withColumn("h", F.col("h") / 100)
    c = K.parabola(t.where(S.in_last_known(30)), ["well"], F.col("h"), F.col("r"))
    p = F.col("c1") * F.col("h") + F.col("c2") * F.col("h") * F.col("h")
    return t.where(F.col("seq") >= F.col("cut")).join(c, "well").groupBy("well").agg(
        F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.sqrt(F.avg((F.col("r") - p) ** 2)).alias("rmse"))


@query("recency_weighted_line", "E13", "well:l icpt:d slope:d", f"""
WITH {ANCH}, g AS (SELECT well, sum(w) AS s0, sum(w*h) AS sx, sum(w*h*h) AS sxx, sum(w*r) AS sy, sum(w*h*r) AS sxy
  FROM (SELECT well, h, r, exp(h / 300) AS w FROM pa WHERE seq < cut) GROUP BY well)
SELECT well, (sy*sxx - sx*sxy) / (s0*sxx - sx*sx) AS icpt, (s0*sxy - sx*sy) / (s0*sxx - sx*sx) AS slope FROM g""", digits=5)
def recency_weighted_line(spark, sf):
    t = anchored(spark, sf).where(F.col("seq") < F.col("cut"))
    return K.weighted_line(t, ["well"], F.col("h"), F.col("r"), F.exp(F.col("h") / 300))


@query("theil_sen_slope", "E14", "well:l slope:d", f"""
WITH {ANCH}, t AS (SELECT well, seq, h, r, row_number() OVER (PARTITION BY well ORDER BY seq) - 1 AS i FROM pa WHERE seq < cut AND seq >= cut - 30),
k AS (SELECT * FROM t WHERE i % 2 = 0)
SELECT a.well, least(greatest(median((b.r - a.r) / (b.h - a.h)), -0.5), 0.5) AS slope FROM k a JOIN k b ON a.well = b.well AND b.seq > a.seq
WHERE abs(b.h - a.h) > 100 GROUP BY a.well""")
def theil_sen_slope(spark, sf):
    t = K.tail_arrays(anchored(spark, sf), ["well"], 30, {"x": F.col("h"), "y": F.col("r")})
    return K.theil_sen(t, ["well"], every=2, min_gap=100.0, limit=0.5)


@query("theil_sen_long", "E14", "well:l slope:d", f"""
WITH {ANCH}, k AS (SELECT well, h, r FROM pa WHERE seq < cut AND seq % CAST(ceil(cut / 20.0) AS BIGINT) = 0),
w AS (SELECT DISTINCT well FROM pa), m AS (SELECT a.well, median((b.r - a.r) / (b.h - a.h)) AS s FROM k a JOIN k b ON a.well = b.well AND b.h - a.h > 50 GROUP BY a.well)
SELECT well, CASE WHEN s IS NULL THEN 0 ELSE least(greatest(s, -0.5), 0.5) END AS slope FROM w LEFT JOIN m USING (well)""")
def theil_sen_long(spark, sf):
    """Median slope between twenty rows at even steps of the whole known part."""
    t = anchored(spark, sf).where(F.col("seq") < F.col("cut"))
    return LV.theil_sen(t, ["well"], F.col("h"), F.col("r"), F.col("seq"), F.col("cut"), points=20)


@query("median_rate", "E15", "well:l rate:d slope:d icpt:d", f"""
WITH {B.SERIES}, d AS (SELECT well, seq, cut, tvt + z - lag(tvt + z) OVER w AS du, md - lag(md) OVER w AS dm, z - lag(z) OVER w AS dz,
  tvt - lag(tvt) OVER w AS dt FROM ev WHERE seq < cut WINDOW w AS (PARTITION BY well ORDER BY seq))
SELECT well, CASE WHEN count(*) FILTER (seq > cut - 30 AND dm > 0) >= 3 THEN median(du / dm) FILTER (seq > cut - 30 AND dm > 0) ELSE 0 END AS rate,
  regr_slope(dt / dm, dz / dm) FILTER (dm > 0) AS slope, regr_intercept(dt / dm, dz / dm) FILTER (dm > 0) AS icpt FROM d GROUP BY well""", digits=5)
def median_rate(spark, sf):
    """Median rate of the last 30 known rows; regression of the value rate on the elevation rate."""
    s = B.evaluable(B.series(spark, sf)).where(F.col("seq") < F.col("cut"))
    u = F.col("tvt") + F.col("z")
    t = S.framed(s, ["well"], 1, lambda w: {
        "du": u - F.lag(u).over(w), "dm": F.col("md") - F.lag("md").over(w),
        "dz": F.col("z") - F.lag("z").over(w), "dt": F.col("tvt") - F.lag("tvt").over(w)})
    ok = F.col("dm") > 0
    tail = F.when(ok & (F.col("seq") > F.col("cut") - 30), F.col("du") / F.col("dm"))
    y, x = F.when(ok, F.col("dt") / F.col("dm")), F.when(ok, F.col("dz") / F.col("dm"))
    g = t.groupBy("well").agg(F.count(tail).alias("k"), F.median(tail).alias("m"), F.regr_slope(y, x).alias("slope"),
                              F.regr_intercept(y, x).alias("icpt"))
    return g.withColumn("rate", F.when(F.col("k") >= 3, F.col("m")).otherwise(0.0))


REACH = [50.0, 200.0, 1000.0]


@query("damped_trends", "E16", "variant:s n:l rmse:d", f"""
WITH {ANCH}, t AS (SELECT well, h, r, seq - greatest(cut - 60, 0) AS i, least(cut, 60) AS nt FROM pa WHERE seq < cut AND seq >= cut - 60),
k AS (SELECT well, h, r FROM t WHERE i % CAST(ceil(nt / 20.0) AS BIGINT) = 0),
ok AS (SELECT well, count(*) >= 10 AND max(h) - min(h) > 100 AS ok FROM k GROUP BY well),
m AS (SELECT a.well, median((b.r - a.r) / (b.h - a.h)) AS s FROM k a JOIN k b ON a.well = b.well AND b.h > a.h GROUP BY a.well),
sl AS (SELECT well, CASE WHEN ok AND s IS NOT NULL THEN least(greatest(s, -0.05), 0.05) ELSE 0 END AS s FROM ok LEFT JOIN m USING (well)),
e0 AS (SELECT well, median(r) AS e0 FROM pa WHERE seq < cut AND seq >= cut - 30 GROUP BY well),
x AS (SELECT r - e0 AS e, s, h, q FROM pa JOIN sl USING (well) JOIN e0 USING (well), (SELECT unnest({REACH})::DOUBLE AS q) WHERE seq >= cut)
SELECT 'lin_' || CAST(q AS BIGINT) AS variant, count(*) AS n, sqrt(avg((e - s * h * exp(-h / q)) ** 2)) AS rmse FROM x GROUP BY q UNION ALL
SELECT 'sat_' || CAST(q AS BIGINT), count(*), sqrt(avg((e - s * q * (1 - exp(-h / q))) ** 2)) FROM x GROUP BY q""", digits=5)
def damped_trends(spark, sf):
    """Level of the last rows and a robust slope of the residual whose extrapolation is damped with distance, over three reaches."""
    t = anchored(spark, sf)
    pre = t.where(S.in_last_known(60))
    s = LV.guarded_slope(pre, ["well"], F.col("h"), F.col("r"), F.col("seq") - F.greatest(F.col("cut") - 60, F.lit(0)), F.least("cut", F.lit(60)),
                         points=20, min_rows=10, limit=0.05)
    e0 = group_quantiles(t.where(S.in_last_known(30)), ["well"], F.col("r"), {"e0": 0.5})
    post = t.where(F.col("seq") >= F.col("cut")).join(s, "well").join(e0, "well")
    e = F.col("r") - F.col("e0")
    return wide_sweep(post, {f"{k}_{int(q)}": (e - v) * (e - v) for q in REACH for k, v in LV.damped(F.col("h"), F.col("slope"), q).items()})


def huber_line_sql(rounds: int) -> str:
    """Unrolled reweighted line fits over hl(well, x, y)."""
    def fit(w, frm):
        return f"""SELECT well, (sy*sxx - sx*sxy) / (s0*sxx - sx*sx) AS b0, (s0*sxy - sx*sy) / (s0*sxx - sx*sx) AS b1 FROM (
  SELECT b.well, sum({w}) AS s0, sum({w}*x) AS sx, sum({w}*x*x) AS sxx, sum({w}*y) AS sy, sum({w}*x*y) AS sxy FROM {frm} GROUP BY b.well)"""
    out = [f"h0 AS MATERIALIZED (SELECT *, false AS done FROM ({fit('1', 'hl b')}))"]
    for i in range(1, rounds):
        out.append(f"k{i} AS MATERIALIZED (SELECT b.well, 1.345 * (1.4826 * median(abs(y - b0 - b1 * x)) + 1e-9) AS k FROM hl b JOIN h{i-1} USING (well) GROUP BY b.well)")
        f = fit("least(1.0, k / greatest(abs(y - p.b0 - p.b1 * x), 1e-12))", f"hl b JOIN h{i-1} p USING (well) JOIN k{i} USING (well)")
        out.append(f"""h{i} AS MATERIALIZED (SELECT p.well, CASE WHEN p.done THEN p.b0 ELSE q.b0 END AS b0, CASE WHEN p.done THEN p.b1 ELSE q.b1 END AS b1,
  p.done OR greatest(abs(p.b0 - q.b0), abs(p.b1 - q.b1)) < 1e-8 AS done FROM h{i-1} p JOIN ({f}) q USING (well))""")
    return ",\n".join(out)


@query("robust_trend_line", "E16", "well:l level:d slope:d rmse:d", f"""
WITH {ANCH}, hl AS (SELECT well, h / 1000 AS x, r AS y FROM pa WHERE seq < cut AND seq >= cut - 30), {huber_line_sql(20)},
sp AS (SELECT well, max(x) - min(x) AS span FROM hl GROUP BY well),
c AS (SELECT well, b0, least(greatest(0.8 * b1, -200), 200) AS g, 2 * span AS lim FROM h19 JOIN sp USING (well))
SELECT pa.well, any_value(b0) AS level, any_value(g) AS slope, sqrt(avg((r - b0 - g * least(h / 1000, lim)) ** 2)) AS rmse
FROM pa JOIN c USING (well) WHERE seq >= cut GROUP BY pa.well""", digits=4)
def robust_trend_line(spark, sf):
    """Reweighted line on the tail, slope shrunk and clipped, extrapolated to twice the tail's span at most."""
    t = anchored(spark, sf).withColumn("x", F.col("h") / 1000)
    tails = K.tail_arrays(t, ["well"], 30, {"x": F.col("x"), "y": F.col("r"), "w": F.lit(1.0)})
    b = K.huber_trend(tails, ["well"], ["x"])
    span = t.where(S.in_last_known(30)).groupBy("well").agg((F.max("x") - F.min("x")).alias("span"))
    b = b.join(span, "well").select("well", F.get("beta", F.lit(0)).alias("level"), "span",
                                    F.least(F.greatest(0.8 * F.get("beta", F.lit(1)), F.lit(-200.0)), F.lit(200.0)).alias("slope"))
    far = F.least(F.col("x"), 2 * F.col("span"))
    return t.where(F.col("seq") >= F.col("cut")).join(b, "well").groupBy("well").agg(
        F.first("level").alias("level"), F.first("slope").alias("slope"),
        F.sqrt(F.avg((F.col("r") - F.col("level") - F.col("slope") * far) ** 2)).alias("rmse"))


def huber_plane_sql(rounds: int, ridge: float) -> str:
    """Unrolled reweighted plane fits over hp(well, u, v, y)."""
    def fit(i, w, frm):
        sums = {"a00": "1", "a10": "u", "a11": "u*u", "a20": "v", "a21": "u*v", "a22": "v*v", "r0": "y", "r1": "u*y", "r2": "v*y"}
        items = ", ".join(f"sum({w} * {e}) + {ridge if k in ('a11', 'a22') else 0} AS {k}" for k, e in sums.items())
        steps, last = sql_solve(f"hs{i}", f"hf{i}_", [["a00"], ["a10", "a11"], ["a20", "a21", "a22"]], ["r0", "r1", "r2"], ["b0", "b1", "b2"])
        return [f"hs{i} AS MATERIALIZED (SELECT b.well, {items} FROM {frm} GROUP BY b.well)", *steps, f"hn{i} AS MATERIALIZED (SELECT well, b0, b1, b2 FROM {last})"]
    out = [*fit(0, "1", "hp b"), "hb0 AS MATERIALIZED (SELECT *, false AS done FROM hn0)"]
    for i in range(1, rounds):
        out.append(f"hk{i} AS MATERIALIZED (SELECT b.well, 1.345 * (1.4826 * median(abs(y - b0 - b1*u - b2*v)) + 1e-9) AS k FROM hp b JOIN hb{i-1} USING (well) GROUP BY b.well)")
        out += fit(i, "least(1.0, k / greatest(abs(y - p.b0 - p.b1*u - p.b2*v), 1e-12))", f"hp b JOIN hb{i-1} p USING (well) JOIN hk{i} USING (well)")
        new = ", ".join(f"CASE WHEN p.done THEN p.{c} ELSE q.{c} END AS {c}" for c in ("b0", "b1", "b2"))
        out.append(f"hb{i} AS MATERIALIZED (SELECT p.well, {new}, p.done OR greatest(abs(p.b0 - q.b0), abs(p.b1 - q.b1), abs(p.b2 - q.b2)) < 1e-8 AS done FROM hb{i-1} p JOIN hn{i} q USING (well))")
    return ",\n".join(out)


@query("robust_plane_long", "E16", "well:l level:d gx:d gy:d", f"""
WITH {B.SERIES}, ax AS (SELECT well, max(x) AS x0, max(y) AS y0 FROM ev WHERE seq = cut - 1 GROUP BY well),
hp AS (SELECT ev.well, (x - x0) / 1000 AS u, (ev.y - y0) / 1000 AS v, tvt + z AS y FROM ev JOIN ax USING (well) WHERE seq < cut), {huber_plane_sql(6, 0.5)}
SELECT well, b0 AS level, b1 AS gx, b2 AS gy FROM hb5""", digits=3)
def robust_plane_long(spark, sf):
    """Reweighted plane over the whole known part, ridge on the gradient (six rounds)."""
    s = B.evaluable(B.series(spark, sf, xy=True))
    a = s.where(F.col("seq") == F.col("cut") - 1).select("well", F.col("x").alias("x0"), F.col("y").alias("y0"))
    t = s.where(F.col("seq") < F.col("cut")).join(a, "well")
    b = LV.huber_trend(t, ["well"], F.col("tvt") + F.col("z"), [(F.col("x") - F.col("x0")) / 1000, (F.col("y") - F.col("y0")) / 1000], rounds=6, ridge=0.5)
    return b.select("well", F.col("b0").alias("level"), F.col("b1").alias("gx"), F.col("b2").alias("gy"))


@query("robust_trend_plane", "E16", "well:l level:d gx:d gy:d")
def robust_trend_plane(spark, sf):
    """Reweighted plane in two coordinates with ridge on the gradient (20 rounds)."""
    s = B.evaluable(B.series(spark, sf, xy=True))
    a = s.where(F.col("seq") == F.col("cut") - 1).select("well", F.col("x").alias("x0"), F.col("y").alias("y0"))
    t = s.join(a, "well")
    tails = K.tail_arrays(t, ["well"], 30, {"u": (F.col("x") - F.col("x0")) / 1000, "v": (F.col("y") - F.col("y0")) / 1000,
                                            "y": F.col("tvt") + F.col("z"), "w": F.lit(1.0)})
    b = K.huber_trend(tails, ["well"], ["u", "v"], ridge=1e-3)
    return b.select("well", *[F.get("beta", F.lit(i)).alias(n) for i, n in enumerate(["level", "gx", "gy"])])


def binned_sql(x, e2, edges, name):
    """b_<name>(bin, n, sigma) with thin bins filled from the nearest."""
    nb = len(edges) - 1
    ctr = ", ".join(f"({i})" for i in range(nb))
    return f"""r_{name} AS (SELECT {sql_bins(x, edges)} AS bin, count(*) AS n, sqrt(avg({e2})) AS rms FROM cand GROUP BY 1),
b_{name} AS (SELECT b.bin, coalesce(any_value(o.n), 0) AS n, arg_min(g.rms, abs(g.bin - b.bin) * 1000 + g.bin) AS sigma
  FROM (VALUES {ctr}) b(bin) JOIN r_{name} g ON g.n > {MIN_BIN} LEFT JOIN r_{name} o ON o.bin = b.bin GROUP BY b.bin)"""


@query("binned_rms_curve", "E18", "bin:l n:l sigma:d", f"WITH {B.CAND}, {binned_sql('nn', '(y-s)**2', NN_EDGES, 'nn')} SELECT * FROM b_nn")
def binned_rms_curve(spark, sf):
    return M.binned_rms(B.cand(spark, sf), F.col("nn"), sq("s"), NN_EDGES, MIN_BIN)


@query("binned_rms_grid", "E19", "r:l c:l n:l mult:d sigma:d", f"""
WITH {B.CAND}, {binned_sql('nn', '(y-s)**2', NN_EDGES, 'nn')},
g AS (SELECT {sql_bins('nn', NN_EDGES)} AS r, {sql_bins('md_since', MD_EDGES)} AS c, count(*) AS n, sum((y-s)**2) AS ss FROM cand GROUP BY 1, 2),
f AS (SELECT b.bin AS r, c.c, b.sigma AS s1, coalesce(g.n, 0) AS n, coalesce(g.ss, 0) AS ss FROM b_nn b, (SELECT unnest(range({len(MD_EDGES) - 1})) AS c) c
  LEFT JOIN g ON g.r = b.bin AND g.c = c.c),
m AS (SELECT c, CASE WHEN sum(n) >= 50 THEN sqrt(sum(ss) / sum(n * s1 * s1)) ELSE 1 END AS ratio FROM f GROUP BY c)
SELECT r, f.c, n, s1 * ratio AS mult, CASE WHEN n >= 50 THEN sqrt(ss / n) ELSE s1 * ratio END AS sigma FROM f JOIN m ON f.c = m.c""")
def binned_rms_grid(spark, sf):
    c = B.cand(spark, sf)
    rows = M.binned_rms(c, F.col("nn"), sq("s"), NN_EDGES, MIN_BIN)
    return M.binned_rms_2d(c, F.col("nn"), F.col("md_since"), sq("s"), NN_EDGES, MD_EDGES, rows, 50)


def errors():
    return {f"e{c}": F.col("y") - F.col(c) for c in "spg"}


PAIRS = [("es", "ep"), ("es", "eg"), ("ep", "eg")]


@query("residual_corr_by_bin", "E20", "bin:l a:s b:s n:l rho:d", f"""
WITH {B.CAND}, e AS (SELECT {sql_bins('md_since', MD_EDGES)} AS bin, y - s AS es, y - p AS ep, y - g AS eg FROM cand)
{' UNION ALL '.join(f"SELECT bin, '{a}' AS a, '{b}' AS b, count(*) AS n, CASE WHEN count(*) >= 100 THEN corr({a}, {b}) END AS rho FROM e GROUP BY bin" for a, b in PAIRS)}""")
def residual_corr_by_bin(spark, sf):
    c = B.cand(spark, sf).withColumn("bin", M.clipped_bin(F.col("md_since"), MD_EDGES))
    return M.pair_correlations(c, ["bin"], errors(), 100)


@query("error_by_fixed_bins", "E21", "bin:l n:l share:d rmse:d bias:d share_sse:d", f"""
WITH {B.CAND}, g AS (SELECT {sql_bins('nn', NN_EDGES)} AS bin, count(*) AS n, sum((y-s)**2) AS ss, avg(y - s) AS bias FROM cand GROUP BY 1)
SELECT bin, n, n / sum(n) OVER () AS share, sqrt(ss / n) AS rmse, bias, ss / sum(ss) OVER () AS share_sse FROM g""")
def error_by_fixed_bins(spark, sf):
    return M.error_by_bins(B.cand(spark, sf), F.col("y") - F.col("s"), M.clipped_bin(F.col("nn"), NN_EDGES))


@query("error_by_deciles", "E21", "bin:l n:l share:d rmse:d bias:d share_sse:d", f"""
WITH {B.CAND}, q AS (SELECT quantile_cont(md_since, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM cand),
b AS (SELECT len(list_filter(q, lambda t: md_since > t)) AS bin, y - s AS e FROM cand, q),
g AS (SELECT bin, count(*) AS n, sum(e * e) AS ss, avg(e) AS bias FROM b GROUP BY 1)
SELECT bin, n, n / sum(n) OVER () AS share, sqrt(ss / n) AS rmse, bias, ss / sum(ss) OVER () AS share_sse FROM g""")
def error_by_deciles(spark, sf):
    t = M.quantile_bin(B.cand(spark, sf), "md_since", [i / 10 for i in range(1, 10)], "bin")
    return M.error_by_bins(t, F.col("y") - F.col("s"), F.col("bin"))


@query("binning_crosstab", "E22", "r:l c0:l c1:l c2:l c3:l", f"""
WITH {B.CAND}, b AS (SELECT {sql_bins('nn', NN_EDGES)} AS r, {sql_bins('md_since', [0, 250, 500, 1000, 1e9])} AS c FROM cand)
SELECT r, count(*) FILTER (c = 0) AS c0, count(*) FILTER (c = 1) AS c1, count(*) FILTER (c = 2) AS c2, count(*) FILTER (c = 3) AS c3 FROM b GROUP BY r""")
def binning_crosstab(spark, sf):
    b = B.cand(spark, sf).select(M.clipped_bin(F.col("nn"), NN_EDGES).alias("r"),
                                 M.clipped_bin(F.col("md_since"), [0, 250, 500, 1000, 1e9]).alias("c"))
    t = b.groupBy("r").pivot("c", [0, 1, 2, 3]).count().fillna(0)
    return t.select("r", *[F.col(str(i)).alias(f"c{i}") for i in range(4)])


@query("error_correlation_matrix", "E23", "a:s b:s n:l rho:d", f"""
WITH {B.CAND}, e AS (SELECT y - s AS es, y - p AS ep, y - g AS eg FROM cand)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS rho FROM e" for a, b in PAIRS)}""")
def error_correlation_matrix(spark, sf):
    return M.pair_correlations(B.cand(spark, sf), [], errors())


FEAT = SSE + """, ft AS (SELECT round(sqrt(sse_s / n), 9) AS rmse, CAST(n AS DOUBLE) AS n_pred, round(lv, 9) AS lv, round(dip, 9) AS dip FROM sse JOIN
  (SELECT well, max(s) AS lv, abs(max(g) FILTER (seq = cut) - max(f)) AS dip FROM cand GROUP BY well) USING (well))"""


def feature_rows(spark, sf):
    c = B.cand(spark, sf)
    return c.groupBy("well").agg(
        F.sqrt(F.avg(sq("s"))).alias("rmse"), F.count(F.lit(1)).cast("double").alias("n_pred"), F.max("s").alias("lv"),
        F.abs(F.max(F.when(F.col("seq") == F.col("cut"), F.col("g"))) - F.max("f")).alias("dip"))


def sql_rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}"


@query("spearman_features", "E24", "a:s b:s rho:d", f"""
WITH {FEAT}, r AS (SELECT {', '.join(sql_rank(c) for c in ['rmse', 'n_pred', 'lv', 'dip'])} FROM ft)
{' UNION ALL '.join(f"SELECT 'rmse' AS a, '{b}' AS b, corr(r_rmse, r_{b}) AS rho FROM r" for b in ['n_pred', 'lv', 'dip'])}""", digits=4)
def spearman_features(spark, sf):
    f = feature_rows(spark, sf).select("well", *[F.round(c, 9).alias(c) for c in ["rmse", "n_pred", "lv", "dip"]])
    return M.spearman(f, "well", [("rmse", "n_pred"), ("rmse", "lv"), ("rmse", "dip")])


@query("partial_correlation", "E24", "rxy:d rxz:d ryz:d partial:d", f"""
WITH {FEAT}, r AS (SELECT corr(rmse, lv) AS rxy, corr(rmse, n_pred) AS rxz, corr(lv, n_pred) AS ryz FROM ft)
SELECT *, (rxy - rxz * ryz) / sqrt((1 - rxz * rxz) * (1 - ryz * ryz)) AS partial FROM r""")
def partial_correlation(spark, sf):
    return M.partial_corr(feature_rows(spark, sf), F.col("rmse"), F.col("lv"), F.col("n_pred"))


@query("null_census", "E25", "col:s rows:l nulls:l groups_some:l groups_all:l", f"""
WITH {B.CLOUD}, g AS (SELECT grp, count(*) AS n, count(*) - count(h1) AS h1, count(*) - count(h2) AS h2, count(*) - count(h3) AS h3 FROM cloud GROUP BY grp)
{' UNION ALL '.join(f"SELECT '{h}' AS col, sum(n) AS rows, sum({h}) AS nulls, count(*) FILTER ({h} > 0) AS groups_some, count(*) FILTER ({h} = n) AS groups_all FROM g" for h in ['h1', 'h2', 'h3'])}""")
def null_census(spark, sf):
    return M.null_census(B.cloud(spark, sf), "grp", ["h1", "h2", "h3"])


@query("principal_direction", "E26", "well:l theta:d major:d", f"""
WITH {B.SERIES}, g AS (SELECT well, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM series GROUP BY well)
SELECT well, 0.5 * atan2(2 * c, vx - vy) AS theta, 0.5 * (vx + vy + sqrt((vx - vy) ** 2 + 4 * c * c)) AS major FROM g""", digits=4)
def principal_direction(spark, sf):
    return M.principal_direction(B.series(spark, sf, xy=True), ["well"], "x", "y")


@query("global_direction", "E26", "theta:d share:d n:l", f"""
WITH {B.SERIES}, g AS (SELECT well, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM series GROUP BY well HAVING count(*) > 2),
d AS (SELECT cos(0.5 * atan2(2 * c, vx - vy)) AS dx, sin(0.5 * atan2(2 * c, vx - vy)) AS dy FROM g),
m AS (SELECT sum(dx * dx) AS a, sum(dx * dy) AS b, sum(dy * dy) AS c, count(*) AS n FROM d)
SELECT 0.5 * atan2(2 * b, a - c) AS theta, (a + c + sqrt((a - c) ** 2 + 4 * b * b)) / (2 * (a + c)) AS share, n FROM m""")
def global_direction(spark, sf):
    """Principal axis of the series' own axes, each of length one, and its share of their moments; signs do not matter."""
    d = M.principal_direction(B.series(spark, sf, xy=True).where("n > 2"), ["well"], "x", "y")
    x, y = F.cos("theta"), F.sin("theta")
    m = d.agg(F.sum(x * x).alias("a"), F.sum(x * y).alias("b"), F.sum(y * y).alias("c"), F.count(F.lit(1)).alias("n"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return m.select((0.5 * F.atan2(2 * b, a - c)).alias("theta"), ((a + c + F.hypot(a - c, 2 * b)) / (2 * (a + c))).alias("share"), "n")


@query("mean_direction", "E26", "theta:d", f"""
WITH {B.SERIES}, d AS (SELECT arg_max(x, seq) - arg_min(x, seq) AS dx, arg_max(y, seq) - arg_min(y, seq) AS dy FROM series GROUP BY well HAVING count(*) > 2),
u AS (SELECT CASE WHEN dx < 0 THEN -1 ELSE 1 END * dx / greatest(sqrt(dx*dx+dy*dy), 1e-9) AS ux,
  CASE WHEN dx < 0 THEN -1 ELSE 1 END * dy / greatest(sqrt(dx*dx+dy*dy), 1e-9) AS uy FROM d)
SELECT atan2(avg(uy), avg(ux)) AS theta FROM u""")
def mean_direction(spark, sf):
    s = B.series(spark, sf, xy=True)
    d = s.groupBy("well").agg((F.max_by("x", "seq") - F.min_by("x", "seq")).alias("dx"),
                              (F.max_by("y", "seq") - F.min_by("y", "seq")).alias("dy"), F.count(F.lit(1)).alias("k"))
    norm = F.greatest(F.hypot("dx", "dy"), F.lit(1e-9)) * F.when(F.col("dx") < 0, -1).otherwise(1)
    return d.where(F.col("k") > 2).agg(F.atan2(F.avg(F.col("dy") / norm), F.avg(F.col("dx") / norm)).alias("theta"))


@query("group_extents", "E28", "grp:l n:l cx:d cy:d dx:d dy:d span:d", f"""
WITH {B.CLOUD} SELECT grp, count(*) AS n, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS dx, max(y) - min(y) AS dy,
  sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS span FROM cloud GROUP BY grp""")
def group_extents(spark, sf):
    g = B.cloud(spark, sf).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    return g.withColumn("span", F.hypot("dx", "dy"))


@query("structural_identity", "E29", "well:l slope:d icpt:d c:d spread:d", f"""
WITH {B.SERIES} SELECT well, regr_slope(tvt, 100 - z) AS slope, regr_intercept(tvt, 100 - z) AS icpt, avg(tvt + z - 100) AS c,
  stddev_pop(tvt + z - 100) AS spread FROM series GROUP BY well""", digits=5)
def structural_identity(spark, sf):
    """Fit of value against (surface - elevation) and the spread of the constant it implies."""
    sz, y = 100 - F.col("z"), F.col("tvt")
    return B.series(spark, sf).groupBy("well").agg(
        F.regr_slope(y, sz).alias("slope"), F.regr_intercept(y, sz).alias("icpt"), F.avg(y - sz).alias("c"),
        F.stddev_pop(y - sz).alias("spread"))


@query("bias_variance_split", "E31", "mse:d bias2:d variance:d", f"""
WITH {B.CAND}, w AS (SELECT count(*) AS n, avg(y - s) AS b, var_pop(y - s) AS v FROM cand GROUP BY well)
SELECT sum(n * (b * b + v)) / sum(n) AS mse, sum(n * b * b) / sum(n) AS bias2, sum(n * v) / sum(n) AS variance FROM w""")
def bias_variance_split(spark, sf):
    e = F.col("y") - F.col("s")
    w = B.cand(spark, sf).groupBy("well").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("b"), F.var_pop(e).alias("v"))
    n, b, v = F.col("n"), F.col("b"), F.col("v")
    return w.agg((F.sum(n * (b * b + v)) / F.sum(n)).alias("mse"), (F.sum(n * b * b) / F.sum(n)).alias("bias2"),
                 (F.sum(n * v) / F.sum(n)).alias("variance"))


@query("replicate_noise", "E32", "k:l mean:d sd:d spread:d", f"""
WITH {B.ENS}, r AS (SELECT seed, sqrt(avg((y - value) ** 2)) AS r FROM ens GROUP BY seed)
SELECT count(*) AS k, avg(r) AS mean, stddev_samp(r) AS sd, max(r) - min(r) AS spread FROM r""")
def replicate_noise(spark, sf):
    r = B.ens(spark, sf).groupBy("seed").agg(F.sqrt(F.avg(sq("value"))).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("k"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"),
                 (F.max("r") - F.min("r")).alias("spread"))


WTS = B.ENS + f""", wt AS (SELECT well, seed, ll, row_number() OVER (PARTITION BY well ORDER BY round(ll + {M.TIE_NUDGE}, 8) DESC, seed) AS rank,
  ll - max(ll) OVER w AS d, stddev_pop(ll) OVER w AS sd FROM ensll WINDOW w AS (PARTITION BY well)),
ws AS (SELECT *, exp(d / 3) / sum(exp(d / 3)) OVER w AS w3, exp(d / 5) / sum(exp(d / 5)) OVER w AS w5,
  exp(d / 8) / sum(exp(d / 8)) OVER w AS w8, exp(d / 12) / sum(exp(d / 12)) OVER w AS w12,
  CASE WHEN sd > 0 THEN exp(d / (0.5 * sd)) / sum(exp(d / (0.5 * sd))) OVER w ELSE 1 / count(*) OVER w END AS wa FROM wt WINDOW w AS (PARTITION BY well))"""


@query("ensemble_reducers", "E33", "well:l seq:l mean:d med:d soft:d multi:d adapt:d best:d top3:d first4:d", f"""
WITH {WTS} SELECT e.well, e.seq, avg(value) AS mean, median(value) AS med, sum(w3 * value) AS soft,
  sum((w3 + w5 + w8 + w12) / 4 * value) AS multi, sum(wa * value) AS adapt, max(value) FILTER (rank = 1) AS best,
  avg(value) FILTER (rank <= 3) AS top3, avg(value) FILTER (e.seed <= 4) AS first4
FROM ens e JOIN ws ON e.well = ws.well AND e.seed = ws.seed GROUP BY e.well, e.seq""")
def ensemble_reducers(spark, sf):
    """Members per row are few (one per seed), so per-row medians stay small; weights come from one row per seed."""
    e = B.ens(spark, sf)
    w = M.ensemble_weights(B.ens_ll(e), ["well"], [3.0, 5.0, 8.0, 12.0], 0.5)
    v = F.col("value")
    return e.join(w, ["well", "seed"]).groupBy("well", "seq").agg(
        F.avg(v).alias("mean"), F.median(v).alias("med"), F.sum(F.col("w_soft") * v).alias("soft"),
        F.sum(F.col("w_multi") * v).alias("multi"), F.sum(F.col("w_adapt") * v).alias("adapt"),
        F.max(F.when(F.col("rank") == 1, v)).alias("best"), F.avg(F.when(F.col("rank") <= 3, v)).alias("top3"),
        F.avg(F.when(F.col("seed") <= 4, v)).alias("first4"))


@query("ensemble_diagnostics", "E34", "corr_ll:d corr_spread:d ll_range:d ll_sd:d", f"""
WITH {B.ENS}, r AS (SELECT well, seed, sqrt(avg((y - value) ** 2)) AS r FROM ens GROUP BY well, seed),
a AS (SELECT well, corr(ll, r) AS c, max(ll) - min(ll) AS rg, stddev_pop(ll) AS sd FROM r JOIN ensll USING (well, seed) GROUP BY well),
p AS (SELECT well, seq, stddev_pop(value) AS sp, abs(avg(value) - any_value(y)) AS e FROM ens GROUP BY well, seq),
b AS (SELECT well, corr(sp, e) AS c FROM p GROUP BY well)
SELECT avg(a.c) AS corr_ll, avg(b.c) AS corr_spread, avg(rg) AS ll_range, avg(sd) AS ll_sd FROM a JOIN b USING (well)""", digits=5)
def ensemble_diagnostics(spark, sf):
    e = B.ens(spark, sf)
    r = e.groupBy("well", "seed").agg(F.sqrt(F.avg(sq("value"))).alias("r"),
                                      (-0.5 * F.avg((F.col("value") - F.col("s")) ** 2)).alias("ll"))
    a = r.groupBy("well").agg(F.corr("ll", "r").alias("c"), (F.max("ll") - F.min("ll")).alias("rg"), F.stddev_pop("ll").alias("sd"))
    p = e.groupBy("well", "seq").agg(F.stddev_pop("value").alias("sp"), F.abs(F.avg("value") - F.first("y")).alias("e"))
    b = p.groupBy("well").agg(F.corr("sp", "e").alias("c2"))
    return a.join(b, "well").agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("corr_ll"),
                                 F.avg(F.when(~F.isnan("c2"), F.col("c2"))).alias("corr_spread"),
                                 F.avg("rg").alias("ll_range"), F.avg("sd").alias("ll_sd"))


@query("path_ensemble", "E35", "well:l seq:l mean:d med:d pair:d", f"""
WITH {B.ENS} SELECT well, seq, avg(value) AS mean, median(value) AS med, avg(value) FILTER (seed IN (1, 2)) AS pair
FROM ens WHERE seed <= 7 GROUP BY well, seq""")
def path_ensemble(spark, sf):
    v = F.col("value")
    return B.ens(spark, sf).where(F.col("seed") <= 7).groupBy("well", "seq").agg(
        F.avg(v).alias("mean"), F.median(v).alias("med"), F.avg(F.when(F.col("seed") <= 2, v)).alias("pair"))


@query("candidate_stack", "E36", "well:l seq:l mean:d sd:d med:d fs:d sg:d", f"""
WITH {B.CAND} SELECT well, seq, (f + s + p + g) / 4 AS mean, sqrt(list_var_pop([f, s, p, g])) AS sd, list_median([f, s, p, g]) AS med,
  f - s AS fs, s - g AS sg FROM cand""")
def candidate_stack(spark, sf):
    cs = [F.col(c) for c in PREDS]
    return B.cand(spark, sf).select("well", "seq", row_mean(cs).alias("mean"), row_std(cs).alias("sd"),
                                    row_median(cs).alias("med"), (F.col("f") - F.col("s")).alias("fs"),
                                    (F.col("s") - F.col("g")).alias("sg"))
