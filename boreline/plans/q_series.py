"""Ordered-series queries on `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import ramp_up, rms
from ..operators import series as S
from ..operators.ordering import fill_linear, framed
from ..operators.quantiles import top_per_group, value_ranks
from . import bindings as B
from .registry import query


@query("masked_level_rmse", "C1 C2 C17 E1 E4", "well:l n_pred:l level:d rmse:d", f"""
WITH {B.CAND} SELECT well, count(*) AS n_pred, max(s) AS level, sqrt(avg((y - s) * (y - s))) AS rmse
FROM cand GROUP BY well""")
def masked_level_rmse(spark, sf):
    """Level of the last ten known rows predicts the rest of each series."""
    c = B.cand(spark, sf)
    return c.groupBy("well").agg(F.count(F.lit(1)).alias("n_pred"), F.max("s").alias("level"),
                                 rms(F.col("y") - F.col("s")).alias("rmse"))


@query("prefix_cut", "C1", "well:l cut:l n:l", f"""
WITH {B.SERIES} SELECT well, coalesce(min(CASE WHEN seq >= cut THEN seq END), count(*)) AS cut, count(*) AS n
FROM series GROUP BY well""")
def prefix_cut(spark, sf):
    s = B.series(spark, sf).withColumn("tvt_input", F.when(F.col("seq") < F.col("cut"), F.col("tvt")))
    return S.cut_of(s, ["well"], "tvt_input")


@query("tail_of_prefix", "C2", "well:l k:l m20:d m30:d", f"""
WITH {B.SERIES} SELECT well, count(*) FILTER (seq >= cut - 20) AS k, avg(tvt) FILTER (seq >= cut - 20) AS m20,
  avg(tvt) FILTER (seq >= cut - 30) AS m30 FROM ev WHERE seq < cut GROUP BY well""")
def tail_of_prefix(spark, sf):
    s = B.evaluable(B.series(spark, sf))
    t20, t30 = S.in_last_known(20), S.in_last_known(30)
    return s.groupBy("well").agg(F.count(F.when(t20, 1)).alias("k"), F.avg(F.when(t20, F.col("tvt"))).alias("m20"),
                                 F.avg(F.when(t30, F.col("tvt"))).alias("m30"))


HD = B.SERIES + """,
st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step
       FROM series WINDOW w AS (PARTITION BY well ORDER BY seq)),
hd AS (SELECT *, sum(step) OVER (PARTITION BY well ORDER BY seq) AS hd FROM st)"""


@query("step_distance", "C3", "well:l seq:l step:d hd:d", f"WITH {HD} SELECT well, seq, step, hd FROM hd", digits=4)
def step_distance(spark, sf):
    return S.step_distance(B.series(spark, sf, xy=True), ["well"], "x", "y")


@query("anchor_deltas", "C4", "well:l seq:l md_since:d hd_since:d dz:d dtvt:d", f"""
WITH {HD}, a AS (SELECT well, max(md) AS md0, max(hd) AS hd0, max(z) AS z0, max(tvt) AS t0 FROM hd
  WHERE seq = cut - 1 GROUP BY well)
SELECT hd.well, seq, md - md0 AS md_since, hd - hd0 AS hd_since, z - z0 AS dz, tvt - t0 AS dtvt
FROM hd JOIN a USING (well) WHERE seq >= cut AND cut >= 20""", digits=4)
def anchor_deltas(spark, sf):
    s = S.step_distance(B.series(spark, sf, xy=True), ["well"], "x", "y")
    at = F.col("seq") == F.col("cut") - 1
    a = s.where(at).select("well", F.col("md").alias("md0"), F.col("hd").alias("hd0"), F.col("z").alias("z0"),
                           F.col("tvt").alias("t0"))
    return (s.where((F.col("seq") >= F.col("cut")) & (F.col("cut") >= 20)).join(a, "well").select(
        "well", "seq", (F.col("md") - F.col("md0")).alias("md_since"), (F.col("hd") - F.col("hd0")).alias("hd_since"),
        (F.col("z") - F.col("z0")).alias("dz"), (F.col("tvt") - F.col("t0")).alias("dtvt")))


@query("suffix_position", "C5", "well:l seq:l frac:d frac_md:d", f"""
WITH {B.CAND} SELECT well, seq, (seq - cut) / greatest(n - cut - 1, 1) AS frac,
  md_since / greatest(max(md_since) OVER (PARTITION BY well), 1) AS frac_md FROM cand""")
def suffix_position(spark, sf):
    c = B.cand(spark, sf)
    end = c.groupBy("well").agg(F.max("md_since").alias("end"))
    return c.join(end, "well").select(
        "well", "seq", ((F.col("seq") - F.col("cut")) / F.greatest(F.col("n") - F.col("cut") - 1, F.lit(1))).alias("frac"),
        (F.col("md_since") / F.greatest(F.col("end"), F.lit(1.0))).alias("frac_md"))


@query("series_derivatives", "C6", "well:l seq:l central:d backward:d", f"""
WITH {B.SERIES}, l AS (SELECT well, seq, md - lag(md) OVER w AS hp, lead(md) OVER w - md AS hn,
  z - lag(z) OVER w AS dp, lead(z) OVER w - z AS dn FROM series WINDOW w AS (PARTITION BY well ORDER BY seq))
SELECT well, seq, dp / hp AS backward, CASE WHEN hp IS NULL THEN dn / hn WHEN hn IS NULL THEN dp / hp
  ELSE (hp * hp * dn + hn * hn * dp) / (hp * hn * (hp + hn)) END AS central FROM l""", digits=5)
def series_derivatives(spark, sf):
    return S.gradient(B.series(spark, sf), ["well"], "z", "md", "central", "backward")


@query("rolling_mean_std", "C7", "well:l seq:l m5:d s5:d m21:d s21:d", f"""
WITH {B.SERIES} SELECT well, seq, avg(gr) OVER a AS m5, stddev_samp(gr) OVER a AS s5, avg(gr) OVER b AS m21,
  stddev_samp(gr) OVER b AS s21 FROM series WINDOW
  a AS (PARTITION BY well ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
  b AS (PARTITION BY well ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def rolling_mean_std(spark, sf):
    def make(w):
        a, b = w.rowsBetween(-2, 2), w.rowsBetween(-10, 10)
        return {"m5": F.avg("gr").over(a), "s5": F.stddev_samp("gr").over(a),
                "m21": F.avg("gr").over(b), "s21": F.stddev_samp("gr").over(b)}
    return framed(B.series(spark, sf), ["well"], 10, make)


@query("rolling_median_anchored", "C8", "well:l seq:l med:d anchored:d", f"""
WITH {B.CAND}, m AS (SELECT well, seq, cut, f, quantile_cont(y, 0.5) OVER (PARTITION BY well ORDER BY seq
  ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM cand)
SELECT m.well, m.seq, m.med, m.med - m0.med + m.f AS anchored FROM m JOIN m m0 ON m.well = m0.well AND m0.seq = m0.cut""")
def rolling_median_anchored(spark, sf):
    t = S.rolling(B.cand(spark, sf), ["well"], "y", 5, median="med")
    return S.reanchor(t, ["well"], "med", F.col("cut"), "f", "anchored")


@query("gap_fill_linear", "C9", "well:l seq:l filled:d", f"""
WITH {B.SERIES}, a AS (SELECT *, last_value(CASE WHEN grn IS NOT NULL THEN seq END IGNORE NULLS) OVER p AS ps,
  last_value(grn IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN grn IS NOT NULL THEN seq END IGNORE NULLS) OVER q AS ns,
  first_value(grn IGNORE NULLS) OVER q AS nv FROM series WINDOW
  p AS (PARTITION BY well ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  q AS (PARTITION BY well ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT well, seq, CASE WHEN ps IS NULL THEN nv WHEN ns IS NULL THEN pv WHEN ns = ps THEN pv
  ELSE pv + (nv - pv) * (seq - ps) / (ns - ps) END AS filled FROM a""")
def gap_fill_linear(spark, sf):
    return fill_linear(B.series(spark, sf), ["well"], "grn", "filled")


@query("savgol_smooth", "C10", "well:l seq:l smooth:d", f"""
WITH {B.CAND}, r AS (SELECT well, seq - cut AS i, n_pred AS n, y, least(17, n_pred - (n_pred + 1) % 2) AS wl FROM cand),
w AS (SELECT *, (wl - 1) // 2 AS m, greatest(0, least(i - (wl - 1) // 2, n - wl)) AS st FROM r),
j AS (SELECT a.well, a.i, a.y AS self, a.wl, CAST(a.m AS DOUBLE) AS m, CAST(a.i - a.st - a.m AS DOUBLE) AS u,
  CAST(b.i - a.st - a.m AS DOUBLE) AS q, b.y AS y FROM w a JOIN w b ON a.well = b.well AND b.i BETWEEN a.st AND a.st + a.wl - 1),
k AS (SELECT *, m * (m + 1) AS k, 2 * m + 1 AS n0, (2 * m - 1) * (2 * m + 3) AS e FROM j)
SELECT k.well, k.i + c.cut AS seq, CASE WHEN max(wl) >= 5 THEN sum(k.y * (1 / n0 + q * u * 3 / (k * n0)
  + (q*q - k/3) * (u*u - k/3) * 45 / (k * n0 * e)
  + (q*q*q - q*(3*k-1)/5) * (u*u*u - u*(3*k-1)/5) * 175 / (k * n0 * e * (m-1) * (m+2)))) ELSE max(self) END AS smooth
FROM k JOIN (SELECT DISTINCT well, cut FROM cand) c USING (well) GROUP BY k.well, k.i, c.cut""")
def savgol_smooth(spark, sf):
    c = B.cand(spark, sf)
    return S.savgol(c, ["well"], "y", F.col("seq") - F.col("cut"), F.col("n_pred"), "smooth")


@query("gaussian_lowpass", "C11", "well:l seq:l low:d", f"""
WITH {B.SERIES}, k AS (SELECT unnest(range(-10, 11)) AS d), w AS (SELECT d, exp(-0.5 * (d / 2.5) ** 2) AS w FROM k)
SELECT a.well, a.seq, sum(w.w * b.tvt) / sum(w.w) AS low FROM series a, w
JOIN series b ON a.well = b.well AND b.seq = greatest(0, least(a.n - 1, a.seq + w.d)) GROUP BY a.well, a.seq""")
def gaussian_lowpass(spark, sf):
    return S.gaussian_lowpass(B.series(spark, sf), ["well"], "tvt", 2.5, "low")


@query("continuity_ramp", "C12", "well:l seq:l ramp:d shrunk:d togeo:d", f"""
WITH {B.CAND}, g0 AS (SELECT well, g AS g0 FROM cand WHERE seq = cut)
SELECT well, seq, g + (f - g0) * exp(-md_since / 1200) AS ramp, (f + z0 - z) + 0.9 * (g - (f + z0 - z)) AS shrunk,
  exp(-md_since / 500) * g + (1 - exp(-md_since / 500)) * s AS togeo FROM cand JOIN g0 USING (well)""")
def continuity_ramp(spark, sf):
    """Pull a candidate to the last known value near the cut, to the flat layer, to the line."""
    c = B.cand(spark, sf)
    g0 = c.where(F.col("seq") == F.col("cut")).select("well", F.col("g").alias("g0"))
    flat = F.col("f") + F.col("z0") - F.col("z")
    r = ramp_up(F.col("md_since"), 500.0)
    return c.join(g0, "well").select(
        "well", "seq", (F.col("g") + (F.col("f") - F.col("g0")) * F.exp(-F.col("md_since") / 1200)).alias("ramp"),
        (flat + 0.9 * (F.col("g") - flat)).alias("shrunk"), ((1 - r) * F.col("g") + r * F.col("s")).alias("togeo"))


@query("jump_events", "C13", "well:l events:l max5:d max20:d", f"""
WITH {B.SERIES}, v AS (SELECT well, seq, tvt + z AS v FROM ev WHERE seq >= cut),
j AS (SELECT well, seq, abs(lead(v, 5) OVER w - v) AS j5, abs(lead(v, 20) OVER w - v) AS j20 FROM v
      WINDOW w AS (PARTITION BY well ORDER BY seq)),
h AS (SELECT well, seq, seq - lag(seq) OVER (PARTITION BY well ORDER BY seq) AS gap FROM j WHERE j5 > 60)
SELECT a.well, coalesce(e.k, 0) AS events, a.m5 AS max5, a.m20 AS max20
FROM (SELECT well, max(j5) AS m5, max(j20) AS m20 FROM j GROUP BY well) a
LEFT JOIN (SELECT well, count(*) FILTER (gap IS NULL OR gap > 5) AS k FROM h GROUP BY well) e USING (well)""")
def jump_events(spark, sf):
    v = B.evaluable(B.series(spark, sf)).where(F.col("seq") >= F.col("cut")).select(
        "well", "seq", (F.col("tvt") + F.col("z")).alias("v"))
    t = S.jumps(v, ["well"], "v", 5, 60.0)
    t = framed(t, ["well"], 20, lambda w: {"j20": F.abs(F.lead("v", 20).over(w) - F.col("v"))})
    return t.groupBy("well").agg(F.sum("starts").alias("events"), F.max("jump").alias("max5"), F.max("j20").alias("max20"))


@query("path_curvature", "C14", "well:l curvature:d", f"""
WITH {B.SERIES}, st AS (SELECT well, seq, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ev WHERE seq >= cut - 1
  WINDOW w AS (PARTITION BY well ORDER BY seq)),
az AS (SELECT well, seq, sqrt(dx*dx + dy*dy) AS d, atan2(dy, dx) AS az FROM st WHERE sqrt(dx*dx + dy*dy) > 8),
t AS (SELECT well, d, abs(az - lag(az) OVER (PARTITION BY well ORDER BY seq)) AS t FROM az)
SELECT w.well, CASE WHEN k >= 5 AND d >= 100 THEN coalesce(t, 0) * 180 / pi() / (d / 100) ELSE 0 END AS curvature
FROM (SELECT DISTINCT well FROM ev) w LEFT JOIN (SELECT well, count(*) AS k, sum(d) AS d,
  sum(CASE WHEN t > pi() THEN 2 * pi() - t ELSE t END) AS t FROM t GROUP BY well) a USING (well)""")
def path_curvature(spark, sf):
    s = B.evaluable(B.series(spark, sf, xy=True)).where(F.col("seq") >= F.col("cut") - 1)
    return S.curvature(s, ["well"], "x", "y", 8.0)


@query("regular_grid", "C15", "well:l g:l x:d y:d", f"""
WITH {B.SERIES}, sg AS (SELECT well, md, x, y, lead(md) OVER w AS k1, lead(x) OVER w AS x1, lead(y) OVER w AS y1
  FROM series WINDOW w AS (PARTITION BY well ORDER BY seq)),
g AS (SELECT *, unnest(range(CAST(ceil(md / 100) AS BIGINT), CAST(CASE WHEN k1 IS NULL THEN floor(md / 100) + 1
  ELSE ceil(k1 / 100) END AS BIGINT))) AS g FROM sg)
SELECT well, g, coalesce(x + (x1 - x) * (g * 100 - md) / (k1 - md), x) AS x,
  coalesce(y + (y1 - y) * (g * 100 - md) / (k1 - md), y) AS y FROM g""", digits=5)
def regular_grid(spark, sf):
    return S.resample(B.series(spark, sf, xy=True), ["well"], "md", ["x", "y"], 100.0)


@query("decimate_reinterpolate", "C16", "well:l seq:l v:d", f"""
WITH {B.CAND}, d AS (SELECT well, seq, cut, n, y, cut + (seq - cut) // 5 * 5 AS a FROM cand)
SELECT d.well, d.seq, p.y + coalesce((q.y - p.y) * (d.seq - p.seq) / 5.0, 0) AS v
FROM d JOIN cand p ON p.well = d.well AND p.seq = d.a LEFT JOIN cand q ON q.well = d.well AND q.seq = d.a + 5""")
def decimate_reinterpolate(spark, sf):
    return S.decimate_refill(B.cand(spark, sf), ["well"], "y", F.col("seq") - F.col("cut"), 5, "v")


@query("masked_tail_view", "C17", "well:l frac:d cut2:l tail:l bs:d bg:d", f"""
WITH {B.BACKTEST} SELECT bt.well, bt.frac, min(bt.seq) AS cut2, count(*) AS tail, sqrt(avg((y - s) ** 2)) AS bs,
  sqrt(avg((y - g) ** 2)) AS bg FROM bt GROUP BY bt.well, bt.frac""")
def masked_tail_view(spark, sf):
    b = B.backtest(spark, sf)
    return b.groupBy("well", "frac").agg(F.min("seq").alias("cut2"), F.count(F.lit(1)).alias("tail"),
                                         rms(F.col("y") - F.col("s")).alias("bs"), rms(F.col("y") - F.col("g")).alias("bg"))


@query("top_per_series", "C18", "well:l event_id:l tvt:d rank:l", f"""
WITH {B.SERIES} SELECT well, event_id, tvt, row_number() OVER (PARTITION BY well ORDER BY tvt DESC, event_id) AS rank
FROM series QUALIFY rank <= 3""")
def top_per_series(spark, sf):
    s = B.table(spark, sf, "events").select(F.col("user_id").alias("well"), "event_id", F.col("value").alias("tvt"))
    return top_per_group(s, ["well"], [F.desc("tvt"), F.asc("event_id")], 3)


@query("largest_errors", "C18", "well:l sse:d", f"""
WITH {B.CAND} SELECT well, sum((y - s) ** 2) AS sse FROM cand GROUP BY well ORDER BY sse DESC, well LIMIT 10""")
def largest_errors(spark, sf):
    c = B.cand(spark, sf).groupBy("well").agg(F.sum((F.col("y") - F.col("s")) ** 2).alias("sse"))
    return c.orderBy(F.desc("sse"), "well").limit(10)


@query("error_share_curve", "C19", "sse:d top:l share:d", f"""
WITH {B.CAND}, w AS (SELECT well, round(sum((y - s) ** 2), 6) AS sse FROM cand GROUP BY well)
SELECT DISTINCT sse, count(*) OVER o AS top, sum(sse) OVER o / sum(sse) OVER () AS share FROM w
WINDOW o AS (ORDER BY sse DESC)""")
def error_share_curve(spark, sf):
    """Running share of the total error, largest series first; one global ranking without a global sort task."""
    w = B.cand(spark, sf).groupBy("well").agg(F.round(F.sum((F.col("y") - F.col("s")) ** 2), 6).alias("sse"))
    r = value_ranks(w, [], F.col("sse"), F.col("sse"))
    return r.select(F.col("v").alias("sse"), (F.col("n") - F.col("r0")).alias("top"),
                    ((F.col("wn") - F.col("w0")) / F.col("wn")).alias("share"))
