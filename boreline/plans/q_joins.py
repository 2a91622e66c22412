"""Join queries: equi, as-of, nearest key, matches, shift searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from ..operators import match as X
from ..operators import series as S
from ..operators.quantiles import group_quantiles
from ..sources.store import materialize
from . import bindings as B
from .q_stats import SEGS, sql_lookup
from .registry import query


@query("result_join", "D1", "well:l rmse_s:d rmse_g:d source:s", f"""
WITH {B.CAND}, a AS (SELECT well, sqrt(avg((y-s)**2)) AS rmse_s, sqrt(avg((y-g)**2)) AS rmse_g FROM cand GROUP BY well)
SELECT well, CASE WHEN well % 4 = 0 THEN 0 ELSE rmse_s END AS rmse_s, rmse_g, CASE WHEN well % 4 = 0 THEN 'new' ELSE 'old' END AS source FROM a""")
def result_join(spark, sf):
    """Two result tables joined by series; rows of a newer table replace the old ones by key."""
    c = B.cand(spark, sf)
    e = lambda p: F.sqrt(F.avg((F.col("y") - F.col(p)) ** 2))
    old = c.groupBy("well").agg(e("s").alias("rmse_s"), e("g").alias("rmse_g")).withColumn("source", F.lit("old"))
    new = old.where("well % 4 = 0").withColumn("rmse_s", F.lit(0.0)).withColumn("source", F.lit("new"))
    return old.join(new.select("well"), "well", "left_anti").unionByName(new)


LI = f"li AS (SELECT l_suppkey, l_quantity + 10 * l_discount AS key FROM lineitem), {SEGS}"


@query("curve_lookup", "D2", "l_suppkey:l n:l mean:d lo:d hi:d", f"""
WITH {LI}, lc AS (SELECT l_suppkey, least(greatest(key, (SELECT min(k) FROM curve)), (SELECT max(k) FROM curve)) AS key FROM li), {sql_lookup('lc', 'key', 'v', 'o')}
SELECT l_suppkey, count(*) AS n, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM o GROUP BY l_suppkey""")
def curve_lookup(spark, sf):
    """Every lineitem row looked up on the price-by-size curve, linear between knots and held at the ends."""
    l = B.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") + 10 * F.col("l_discount")).alias("q"))
    t = L.curve_lookup(l, F.col("q"), B.curve(spark, sf), [], "out")
    return t.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("out").alias("mean"), F.min("out").alias("lo"), F.max("out").alias("hi"))


@query("own_curve_lookup", "D2", "well:l n:l mean:d", f"""
WITH {B.SERIES}, k AS (SELECT well, round(tvt, 0) AS k, avg(md) AS v FROM ev WHERE seq < cut GROUP BY 1, 2),
sg AS (SELECT well, k AS k0, v AS v0, lead(k) OVER w AS k1, lead(v) OVER w AS v1 FROM k WINDOW w AS (PARTITION BY well ORDER BY k)),
mm AS (SELECT well, min(k) AS lo, max(k) AS hi FROM k GROUP BY well),
r AS (SELECT ev.well, least(greatest(tvt, lo), hi) AS q FROM ev JOIN mm USING (well) WHERE seq >= cut)
SELECT r.well, count(*) AS n, avg(v0 + coalesce((v1 - v0) * (q - k0) / (k1 - k0), 0)) AS mean FROM r JOIN sg ON sg.well = r.well AND q >= k0 AND (k1 IS NULL OR q < k1) GROUP BY r.well""")
def own_curve_lookup(spark, sf):
    """Curve per series, built from its own known part."""
    s = B.evaluable(B.series(spark, sf))
    k = s.where(F.col("seq") < F.col("cut")).select("well", F.round("tvt", 0).alias("k"), F.col("md").alias("v"))
    t = L.curve_lookup(s.where(F.col("seq") >= F.col("cut")).select("well", "tvt"), F.col("tvt"), k, ["well"], "out")
    return t.groupBy("well").agg(F.count(F.lit(1)).alias("n"), F.avg("out").alias("mean"))


@query("dense_grid_lookup", "D3", "l_suppkey:l n:l mean:d", f"""
WITH {LI}, b AS (SELECT min(k) AS lo, max(k) AS hi FROM curve), gr AS (SELECT unnest(range(0, CAST(ceil((hi - lo) / 0.2) AS BIGINT) + 1)) AS g, lo, hi FROM b),
gp AS (SELECT g, least(lo + g * 0.2::DOUBLE, hi) AS key FROM gr), {sql_lookup('gp', 'key', 'v', 'gv')},
p AS (SELECT l_suppkey, least(greatest((key - lo) / 0.2::DOUBLE, 0), (SELECT max(g) FROM gr)) AS p FROM li, b),
q AS (SELECT *, least(CAST(floor(p) AS BIGINT), (SELECT max(g) FROM gr) - 1) AS i FROM p)
SELECT l_suppkey, count(*) AS n, avg(a.v + (c.v - a.v) * (p - i)) AS mean FROM q JOIN gv a ON a.g = i JOIN gv c ON c.g = i + 1 GROUP BY l_suppkey""", digits=5)
def dense_grid_lookup(spark, sf):
    grid = L.dense_grid(B.curve(spark, sf), [], 0.2)
    l = B.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") + 10 * F.col("l_discount")).alias("q"))
    t = L.grid_lookup(l, F.col("q"), grid, [], 0.2, "out")
    return t.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("out").alias("mean"))


@query("nearest_key", "D4", "near_k:d n:l", f"""
WITH {LI}, d AS (SELECT DISTINCT key FROM li), nk AS (SELECT key, arg_min(k, abs(k - key) * 1000000 + k) AS near_k FROM d, curve WHERE abs(k - key) <= 2 GROUP BY key)
SELECT near_k, count(*) AS n FROM li JOIN nk USING (key) GROUP BY near_k""")
def nearest_key(spark, sf):
    l = B.table(spark, sf, "lineitem").select((F.col("l_quantity") + 10 * F.col("l_discount")).alias("q"))
    return L.nearest_knot(l, F.col("q"), B.curve(spark, sf), []).groupBy("near_k").agg(F.count(F.lit(1)).alias("n"))


GRID = B.SERIES + """, sg AS (SELECT well, md, x, y, lead(md) OVER w AS k1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM series WINDOW w AS (PARTITION BY well ORDER BY seq)),
g AS (SELECT *, unnest(range(CAST(ceil(md / 500) AS BIGINT), CAST(CASE WHEN k1 IS NULL THEN floor(md / 500) + 1 ELSE ceil(k1 / 500) END AS BIGINT))) AS g FROM sg),
gx AS (SELECT well, g, coalesce(x + (x1 - x) * (g * 500 - md) / (k1 - md), x) AS x, coalesce(y + (y1 - y) * (g * 500 - md) / (k1 - md), y) AS y FROM g),
sp AS (SELECT well, min(g) AS g0, max(g) AS g1 FROM gx GROUP BY well),
pr AS (SELECT a.well, b.well AS match, avg(abs(a.x - b.x) + abs(a.y - b.y)) AS dist, any_value((least(sa.g1, sb.g1) - greatest(sa.g0, sb.g0)) / (sa.g1 - sa.g0)) AS cover
  FROM gx a JOIN gx b ON a.g = b.g AND a.well <> b.well JOIN sp sa ON sa.well = a.well JOIN sp sb ON sb.well = b.well
  WHERE sa.g1 - sa.g0 + 1 >= 10 AND least(sa.g1, sb.g1) - greatest(sa.g0, sb.g0) >= 0.5 * (sa.g1 - sa.g0) GROUP BY a.well, b.well)"""
TOL = 400.0


def ck(df):
    return materialize(df, "match")


def path_grids(s):
    return materialize(S.resample(s, ["well"], "md", ["x", "y"], 500.0), "grids")


@query("path_matches", "D10", "well:l match:l dist:d cover:d", f"""
WITH {GRID} SELECT well, arg_min(match, dist) AS match, min(dist) AS dist, arg_min(cover, dist) AS cover FROM pr WHERE dist < {TOL} GROUP BY well""", digits=4)
def path_matches(spark, sf):
    """Series that follow nearly the same path on a common grid."""
    return X.path_matches(path_grids(B.series(spark, sf, xy=True)), "well", TOL, ck)


@query("guarded_override", "D11", "well:l match:l c:d prermse:d accepted:b n:l", f"""
WITH {GRID}, b AS (SELECT well, arg_min(match, dist) AS match FROM pr WHERE dist < {TOL} GROUP BY well),
sx AS (SELECT well, md AS k0, x AS v0, lead(md) OVER w AS k1, lead(x) OVER w AS v1, min(md) OVER (PARTITION BY well) AS lo, max(md) OVER (PARTITION BY well) AS hi FROM series WINDOW w AS (PARTITION BY well ORDER BY seq)),
q AS (SELECT ev.well, match, ev.seq, ev.cut, x, md, v0 + coalesce((v1 - v0) * (least(greatest(md, lo), hi) - k0) / (k1 - k0), 0) AS s, md >= lo - 0.5 AND md <= hi + 0.5 AS cov
  FROM ev JOIN b USING (well) JOIN sx ON sx.well = match AND least(greatest(md, lo), hi) >= k0 AND (k1 IS NULL OR least(greatest(md, lo), hi) < k1)),
c AS (SELECT well, median(x - s) AS c, count(*) AS k FROM q WHERE cov AND seq < cut GROUP BY well)
SELECT q.well, match, any_value(c) AS c, sqrt(avg((x - s - c)**2) FILTER (cov AND seq < cut)) AS prermse,
  any_value(k) >= 20 AND sqrt(avg((x - s - c)**2) FILTER (cov AND seq < cut)) < 60 AS accepted, count(*) FILTER (cov AND seq >= cut) AS n
FROM q JOIN c USING (well) GROUP BY q.well, match""", digits=4)
def guarded_override(spark, sf):
    """Values of the matched series read by depth, used only when they reproduce the known part."""
    s = materialize(B.series(spark, sf, xy=True), "series")
    m = X.path_matches(path_grids(s), "well", TOL, ck).select("well", "match")
    rows = B.evaluable(s).join(m, "well").select("well", "match", "seq", "cut", "x", "md")
    copy = s.select(F.col("well").alias("match"), F.col("md").alias("k"), F.col("x").alias("v"))
    t = L.curve_lookup(rows, F.col("md"), copy, ["match"], "s")
    ends = copy.groupBy("match").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    t = t.join(ends, "match").withColumn("cov", F.col("md").between(F.col("lo") - 0.5, F.col("hi") + 0.5))
    pre = F.col("cov") & (F.col("seq") < F.col("cut"))
    c = group_quantiles(t.where(pre), ["well"], F.col("x") - F.col("s"), {"c": 0.5})
    r = F.col("x") - F.col("s") - F.col("c")
    g = t.join(c, "well").groupBy("well", "match").agg(
        F.first("c").alias("c"), F.sqrt(F.avg(F.when(pre, r * r))).alias("prermse"), F.count(F.when(pre, 1)).alias("k"),
        F.count(F.when(F.col("cov") & (F.col("seq") >= F.col("cut")), 1)).alias("n"))
    return g.withColumn("accepted", (F.col("k") >= 20) & (F.col("prermse") < 60))


@query("scalar_to_rows", "D12", "event_id:l rel:d", f"""
WITH {B.SERIES} SELECT event_id, tvt - avg(tvt) OVER (PARTITION BY well) AS rel FROM series""")
def scalar_to_rows(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "user_id", "value")
    m = e.groupBy("user_id").agg(F.avg("value").alias("m"))
    return e.join(m, "user_id").select("event_id", (F.col("value") - F.col("m")).alias("rel"))


@query("disjoint_sample", "D13", "c_custkey:l", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY c_custkey * 7919 % 10007, c_custkey LIMIT 100""")
def disjoint_sample(spark, sf):
    """Sampling operator: a fixed number of keys outside another set, in a seeded order."""
    used = B.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    c = B.table(spark, sf, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")
    return c.orderBy(F.col("c_custkey") * 7919 % 10007, "c_custkey").limit(100)


def curve_row(spark, sf):
    """The curve on a unit grid as one row; its length is bounded by the range of sizes (1 to 50)."""
    g = L.dense_grid(B.curve(spark, sf), [], 1.0)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("g", "gv"))), lambda s: s["gv"])
    return g.agg(arr.alias("crv"), F.count(F.lit(1)).alias("knots")).withColumn("one", F.lit(1))


def with_curve(df, spark, sf):
    return df.withColumn("one", F.lit(1)).join(curve_row(spark, sf), "one")


CA = f"""{B.SERIES}, {B.CURVE}, ca AS (SELECT list(v ORDER BY k) AS a FROM curve)"""


def sql_at(pos):
    p = f"least(greatest({pos}, 0), 49)"
    i = f"least(CAST(floor({p}) AS BIGINT), 48)"
    return f"(a[{i} + 1] + (a[{i} + 2] - a[{i} + 1]) * ({p} - {i}))"


@query("shift_search", "D14", "well:l shift:d score:d n:l", f"""
WITH {CA}, s AS (SELECT unnest(range(-12, 13)) AS d), p AS (SELECT well, d, grn, {sql_at('tvt / 8.0 + d')} AS p FROM ev, s, ca WHERE seq < cut AND grn IS NOT NULL),
c AS (SELECT well, d, coalesce(nullif(corr(grn, p), 'nan'::DOUBLE), 0) AS r, count(*) AS n FROM p GROUP BY well, d)
SELECT well, d AS shift, r AS score, n FROM c QUALIFY row_number() OVER (PARTITION BY well ORDER BY round(r, 9) DESC, d) = 1""", digits=5)
def shift_search(spark, sf):
    """Shift along the curve with the best correlation on the known part."""
    t = with_curve(B.evaluable(B.series(spark, sf)).where(F.col("seq") < F.col("cut")), spark, sf)
    sc = X.shift_correlations(t, ["well"], "grn", 1 + F.col("tvt") / 8, "crv", [float(d) for d in range(-12, 13)], 1.0, 1.0)
    return X.best_shift(sc, ["well"], F.col("r"), 9)


@query("likelihood_scan", "D15", "well:l win:l shift:d score:d n:l", f"""
WITH {CA}, d AS (SELECT unnest(range(-10, 11)) AS d), p AS (SELECT well, (seq - cut) // 12 AS win, d, gr / 10 + 900 AS o, {sql_at('md_s / 40.0 + d')} AS p
  FROM (SELECT *, md % 2000 AS md_s FROM ev WHERE seq >= cut), d, ca),
c AS (SELECT well, win, d, sum(-0.5 * ((o - 0.9 * p - 95) / 20) ** 2) AS ll, count(*) AS n FROM p GROUP BY ALL)
SELECT well, win, d AS shift, ll AS score, n FROM c QUALIFY row_number() OVER (PARTITION BY well, win ORDER BY round(ll, 6) DESC, d) = 1""", digits=4)
def likelihood_scan(spark, sf):
    """Most likely shift per window of the unknown part."""
    t = B.evaluable(B.series(spark, sf)).where(F.col("seq") >= F.col("cut"))
    t = t.withColumn("win", F.floor((F.col("seq") - F.col("cut")) / 12)).withColumn("o", F.col("gr") / 10 + 900)
    t = with_curve(t, spark, sf)
    sc = X.shift_scores(t, ["well", "win"], "o", 1 + F.pmod(F.col("md"), F.lit(2000.0)) / 40, "crv", [float(d) for d in range(-10, 11)], 1.0, 1.0)
    return X.best_shift(sc, ["well", "win"], X.log_likelihood(F.lit(0.9), F.lit(95.0), F.lit(20.0)), 6)


@query("shape_scan", "D16", "well:l win:l shift:d score:d n:l", f"""
WITH {CA}, d AS (SELECT unnest(range(-10, 11)) AS d), p AS (SELECT well, (seq - cut) // 12 AS win, d, gr AS o, {sql_at('md_s / 40.0 + d')} AS p
  FROM (SELECT *, md % 2000 AS md_s FROM ev WHERE seq >= cut), d, ca),
c AS (SELECT well, win, d, coalesce(nullif(corr(o, p), 'nan'::DOUBLE), 0) AS r, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 6)
SELECT well, win, d AS shift, r AS score, n FROM c QUALIFY row_number() OVER (PARTITION BY well, win ORDER BY round(r, 7) DESC, d) = 1""", digits=4)
def shape_scan(spark, sf):
    """As the likelihood scan with correlation of shapes as the score."""
    t = B.evaluable(B.series(spark, sf)).where(F.col("seq") >= F.col("cut"))
    t = with_curve(t.withColumn("win", F.floor((F.col("seq") - F.col("cut")) / 12)), spark, sf)
    sc = X.shift_correlations(t, ["well", "win"], "gr", 1 + F.pmod(F.col("md"), F.lit(2000.0)) / 40, "crv", [float(d) for d in range(-10, 11)], 1.0, 1.0)
    return X.best_shift(sc.where(F.col("n") >= 6), ["well", "win"], F.col("r"), 7)


SM = B.SERIES + """, sd AS (SELECT *, CASE WHEN seq < cut THEN 0 ELSE 1 END AS side FROM ev),
sm AS (SELECT well, seq, cut, tvt, side, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY well, side) AS m,
  avg(gr) OVER (PARTITION BY well, side ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM sd WINDOW w AS (PARTITION BY well, side ORDER BY seq))"""


def sql_template(h):
    n = 2 * h + 1
    return f"""w{h} AS (SELECT r.well, r.side, r.seq, r.cut, r.tvt, r.i, r.m, k, q.v FROM sm r, (SELECT unnest(range(-{h}, {h} + 1)) AS k) JOIN sm q
  ON q.well = r.well AND q.side = r.side AND q.i = greatest(0, least(r.m - 1, r.i + k))),
z{h} AS (SELECT well, side, seq, any_value(cut) AS cut, any_value(tvt) AS tvt, any_value(i) AS i, any_value(m) AS m,
  list(v ORDER BY k) AS l, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM w{h} GROUP BY well, side, seq),
n{h} AS (SELECT *, list_transform(l, lambda x: (x - mu) / sd) AS z FROM z{h}),
b{h} AS (SELECT a.well, a.seq, arg_max(b.tvt, round(list_dot_product(a.z, b.z) / {n}, 9) * 1000000000000 - b.i) AS t{h}, max(round(list_dot_product(a.z, b.z) / {n}, 9)) AS s{h}
  FROM n{h} a JOIN n{h} b ON a.well = b.well AND a.side = 1 AND b.side = 0 AND b.i >= {h} AND b.i < b.m - {h} AND (b.i - {h}) % 3 = 0 GROUP BY a.well, a.seq)"""


@query("template_match", "D17", "well:l seq:l t4:d s4:d t6:d s6:d ens:d", f"""
WITH {SM}, {sql_template(4)}, {sql_template(6)}
SELECT well, seq, t4, s4, t6, s6, (t4 * exp(3*s4) + t6 * exp(3*s6)) / (exp(3*s4) + exp(3*s6) + 1e-9) AS ens FROM b4 JOIN b6 USING (well, seq)""", digits=5)
def template_match(spark, sf):
    """Each unknown row against every third window of the known part of its own series, at two widths."""
    s = B.evaluable(B.series(spark, sf)).withColumn("side", (F.col("seq") >= F.col("cut")).cast("int"))
    k = ["well", "side"]
    s = s.withColumn("i", F.when(F.col("side") == 1, F.col("seq") - F.col("cut")).otherwise(F.col("seq")))
    s = S.rolling(s.select("well", "side", "seq", "cut", "tvt", "gr", "i"), k, "gr", 2, mean="v")
    out = None
    for h in (4, 6):
        z = X.window_shapes(s, k, "v", h, "z")
        tpl = z.where((F.col("side") == 0) & F.col("__whole") & (F.pmod(F.col("i") - h, F.lit(3)) == 0))
        t = X.best_templates(z.where(F.col("side") == 1), tpl, "well", "tvt", 2 * h + 1)
        t = t.withColumnsRenamed({"best": f"t{h}", "score": f"s{h}"})
        out = t if out is None else out.join(t, ["well", "seq"])
    w4, w6 = F.exp(3 * F.col("s4")), F.exp(3 * F.col("s6"))
    return out.withColumn("ens", (F.col("t4") * w4 + F.col("t6") * w6) / (w4 + w6 + 1e-9))


@query("reference_choice", "D18", "well:l knots:l cover_self:d cover_all:d", f"""
WITH {B.SERIES}, r AS (SELECT well, round(tvt, 2) AS k, avg(md) AS v FROM ev WHERE seq < cut GROUP BY 1, 2),
m AS (SELECT well, count(*) AS knots, min(k) AS lo, max(k) AS hi FROM r GROUP BY well), e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)
SELECT ev.well, any_value(knots) AS knots, avg(CASE WHEN tvt >= m.lo AND tvt <= m.hi THEN 1.0 ELSE 0 END) AS cover_self,
  avg(CASE WHEN tvt >= least(m.lo, e.lo) AND tvt <= greatest(m.hi, e.hi) THEN 1.0 ELSE 0 END) AS cover_all FROM ev JOIN m USING (well), e WHERE seq >= cut GROUP BY ev.well""")
def reference_choice(spark, sf):
    """Own known part as reference curve, alone and with the external one; share of unknown rows inside its range."""
    s = B.evaluable(B.series(spark, sf))
    pre = F.col("seq") < F.col("cut")
    r = s.where(pre).groupBy("well", F.round("tvt", 2).alias("k")).agg(F.avg("md").alias("v"))
    m = r.groupBy("well").agg(F.count(F.lit(1)).alias("knots"), F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("one", F.lit(1))
    e = B.table(spark, sf, "part").agg(F.min("p_size").alias("elo"), F.max("p_size").alias("ehi")).withColumn("one", F.lit(1))
    t = s.where(~pre).join(m.join(e, "one"), "well")
    share = lambda lo, hi: F.avg(F.col("tvt").between(lo, hi).cast("double"))
    return t.groupBy("well", "knots").agg(share(F.col("lo"), F.col("hi")).alias("cover_self"),
                                          share(F.least("lo", "elo"), F.greatest("hi", "ehi")).alias("cover_all"))
