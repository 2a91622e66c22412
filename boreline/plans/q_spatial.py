"""Neighbour and surface queries on the point cloud of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import surface as SF
from ..operators.clusters import clusters
from ..operators.knn import knn, knn_stretched, nearest_groups
from ..operators.quantiles import group_quantiles
from ..sources.store import materialize
from . import bindings as B
from .registry import query

K = 8
HS = ["h1", "h2", "h3"]


def pts(spark, sf):
    return B.cloud(spark, sf).withColumnRenamed("x", "u").withColumnRenamed("y", "v")


def neighbours(spark, sf, k=K, values=()):
    """k neighbours of every point of the cloud, own group left out, with the named values of the neighbours."""
    p = materialize(pts(spark, sf).select("id", "grp", "u", "v", *values), "cloud")
    q = p.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v")
    return knn(q, p, k, values=list(values), written=True)


@query("knn_other_groups", "D5", "qid:l id:l dist:d rank:l")
def knn_other_groups(spark, sf):
    """Eight nearest points of other groups for every point (brute force in tests: the SQL is quadratic)."""
    return neighbours(spark, sf)


@query("nearest_distance", "D6", "grp:l d_min:d d_mean:d own_min:d")
def nearest_distance(spark, sf):
    """Distance to the nearest point of another group, and of any group but itself, summarised per group."""
    p = materialize(pts(spark, sf).select("id", "grp", "u", "v"), "cloud")
    q = p.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v", F.col("grp").alias("of"))
    a = knn(q, p, 1, marks=["of"], written=True)
    b = knn(q, p, 2, exclude_own=False, marks=["of"], written=True).where(F.col("id") != F.col("qid"))
    # Groups without a neighbour of another group are in neither table; in the others every point has both.
    a = a.groupBy("of").agg(F.min("dist").alias("d_min"), F.avg("dist").alias("d_mean"))
    return a.join(b.groupBy("of").agg(F.min("dist").alias("own_min")), "of").withColumnRenamed("of", "grp")


SMALL = """sp AS (SELECT s_suppkey AS id, s_nationkey AS grp, s_acctbal / 10 AS u, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) AS v FROM supplier)"""


def small(spark, sf):
    """Supplier points: a few per group, small enough for a quadratic check in SQL."""
    return B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("grp"), (F.col("s_acctbal") / 10).alias("u"),
        (F.col("s_suppkey") * 7919 % 1000).cast("double").alias("v"))


def small_knn(spark, sf, k, **kw):
    p = small(spark, sf)
    return knn(p.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v"), p, k, **kw)


NBR = SMALL + """, nb AS (SELECT a.id AS qid, a.grp AS qgrp, b.id, b.grp, sqrt((a.u-b.u)**2 + (a.v-b.v)**2) AS dist, b.u - a.u AS du, b.v - a.v AS dv,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.u-b.u)**2 + (a.v-b.v)**2), b.id) AS rank FROM sp a JOIN sp b ON a.grp <> b.grp QUALIFY rank <= 8)"""


@query("knn_suppliers", "D5", "qid:l id:l dist:d rank:l", f"WITH {NBR} SELECT qid, id, dist, rank FROM nb")
def knn_suppliers(spark, sf):
    return small_knn(spark, sf, K)


@query("group_nearest_distance", "D7", "grp:l d:d", f"WITH {NBR} SELECT qgrp AS grp, min(dist) AS d FROM nb GROUP BY qgrp")
def group_nearest_distance(spark, sf):
    """Exact nearest distance between a group and all others."""
    p = small(spark, sf).select(F.col("id").alias("qid"), F.col("grp"))
    return small_knn(spark, sf, 1).join(p, "qid").groupBy("grp").agg(F.min("dist").alias("d"))


CENT = B.CLOUD + ", ce AS (SELECT grp AS id, avg(x) AS u, avg(y) AS v, avg(h1) AS h FROM cloud GROUP BY grp)"


def centroids(spark, sf):
    return B.cloud(spark, sf).groupBy("grp").agg(F.avg("x").alias("u"), F.avg("y").alias("v"), F.avg("h1").alias("h")).select(
        F.col("grp").alias("id"), "grp", "u", "v", "h")


def centroid_knn(spark, sf, k):
    c = centroids(spark, sf)
    return c, knn(c.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v"), c, k)


@query("centroid_neighbours", "D8", "qid:l id:l dist:d rank:l", f"""
WITH {CENT} SELECT a.id AS qid, b.id, sqrt((a.u-b.u)**2 + (a.v-b.v)**2) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY (a.u-b.u)**2 + (a.v-b.v)**2, b.id) AS rank
FROM ce a JOIN ce b ON a.id <> b.id QUALIFY rank <= 5""")
def centroid_neighbours(spark, sf):
    return centroid_knn(spark, sf, 5)[1]


@query("offset_smoothness", "D8 E29", "n:l med:d mean:d", f"""
WITH {CENT}, nb AS (SELECT a.id, abs(a.h - b.h) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.u-b.u)**2 + (a.v-b.v)**2, b.id) AS r FROM ce a JOIN ce b ON a.id <> b.id QUALIFY r <= 5),
g AS (SELECT id, avg(d) AS d FROM nb GROUP BY id) SELECT count(*) AS n, median(d) AS med, avg(d) AS mean FROM g""", digits=3)
def offset_smoothness(spark, sf):
    """How much a group constant differs from those of its five nearest groups."""
    c, nb = centroid_knn(spark, sf, 5)
    t = nb.join(c.select("id", F.col("h").alias("hb")), "id").join(c.select(F.col("id").alias("qid"), "h"), "qid")
    g = t.groupBy("qid").agg(F.avg(F.abs(F.col("h") - F.col("hb"))).alias("d"))
    q = group_quantiles(g, [], F.col("d"), {"med": 0.5}).withColumn("one", F.lit(1))
    return q.join(g.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean")).withColumn("one", F.lit(1)), "one")


def supplier_values(spark, sf, k=K):
    p = small(spark, sf)
    v = p.select("id", "grp", F.col("u").alias("pu"), F.col("v").alias("pv"), F.when(F.col("id") % 5 != 0, F.col("u") * 2 + F.col("v")).alias("h"),
                 (F.col("u") * F.col("v") / 100).alias("h2"))
    nb = small_knn(spark, sf, k).join(v, "id").join(p.select(F.col("id").alias("qid"), "u", "v"), "qid")
    return nb.withColumn("du", F.col("pu") - F.col("u")).withColumn("dv", F.col("pv") - F.col("v"))


VAL = NBR + """, nv AS (SELECT nb.*, CASE WHEN nb.id % 5 <> 0 THEN s.u * 2 + s.v END AS h, s.u * s.v / 100 AS h2, 1 / greatest(dist, 0.001) ** 2 AS w FROM nb JOIN sp s ON s.id = nb.id)"""


@query("idw_single", "I1", "qid:l nn:d p15:d soft:d", f"""
WITH {VAL} SELECT qid, min(dist) AS nn, sum(h2 / greatest(dist, 0.001) ** 1.5) / sum(1 / greatest(dist, 0.001) ** 1.5) AS p15,
  sum(h2 / (dist*dist + 1e-6)) / sum(1 / (dist*dist + 1e-6)) AS soft FROM nv GROUP BY qid""")
def idw_single(spark, sf):
    w, s = SF.idw_weight(F.col("dist"), 1.5), SF.idw_weight(F.col("dist"), 2, "soft")
    return supplier_values(spark, sf).groupBy("qid").agg(
        F.min("dist").alias("nn"), (F.sum(w * F.col("h2")) / F.sum(w)).alias("p15"), (F.sum(s * F.col("h2")) / F.sum(s)).alias("soft"))


@query("idw_masked_multi", "I2", "qid:l nn:d h:d h2:d", f"""
WITH {VAL} SELECT qid, min(dist) AS nn, sum(w * h) / sum(w) FILTER (h IS NOT NULL) AS h, sum(w * h2) / sum(w) AS h2 FROM nv GROUP BY qid""")
def idw_masked_multi(spark, sf):
    return SF.idw(supplier_values(spark, sf), ["qid"], ["h", "h2"])


@query("neighbour_dispersion", "I3", "qid:l mean:d std:d", f"""
WITH {VAL}, a AS (SELECT qid, sum(w * h2) / sum(w) AS mean, sum(w * h2 * h2) / sum(w) AS q FROM nv GROUP BY qid) SELECT qid, mean, sqrt(greatest(q - mean * mean, 0)) AS std FROM a""", digits=4)
def neighbour_dispersion(spark, sf):
    return SF.dispersion(supplier_values(spark, sf), ["qid"], "h2")


def sql_plane(src):
    return f"""pg AS (SELECT qid, any_value(hh) AS h, sum(w) AS s, sum(w*x) AS a, sum(w*y) AS b, sum(w*x*x) AS aa, sum(w*x*y) AS ab, sum(w*y*y) AS bb, sum(w*v) AS z, sum(w*x*v) AS az, sum(w*y*v) AS bz
  FROM (SELECT qid, w, du / hh AS x, dv / hh AS y, h2 AS v, hh FROM (SELECT *, avg(sqrt(du*du+dv*dv)) OVER (PARTITION BY qid) AS hh FROM {src})) GROUP BY qid),
pm AS (SELECT qid, z / s AS base, a / s AS p, b / s AS q, aa / s + 0.01 AS r, ab / s AS t, bb / s + 0.01 AS u, z / s AS x, az / s AS y, bz / s AS v FROM pg)
SELECT qid, base, base + least(greatest(((r*u-t*t)*x + (q*t-p*u)*y + (p*t-q*r)*v) / ((r*u-t*t) + p*(q*t-p*u) + q*(p*t-q*r)) - base, -500), 500) AS plane FROM pm"""


GRID_K, GRID_P = [2, 4, 6, 8], [1.0, 1.5, 2.0, 3.0]


@query("neighbour_grid", "G11", "k:l power:d method:s n:l rmse:d", f"""
WITH {SMALL}, nb AS (SELECT a.id AS qid, a.u * a.v / 100 AS truth, sqrt((a.u-b.u)**2 + (a.v-b.v)**2) AS dist, b.u - a.u AS du, b.v - a.v AS dv, CASE WHEN b.id % 5 <> 0 THEN b.u * b.v / 100 END AS val,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.u-b.u)**2 + (a.v-b.v)**2), b.id) AS rank FROM sp a JOIN sp b ON a.grp <> b.grp QUALIFY rank <= 8),
s AS (SELECT *, avg(sqrt(du*du+dv*dv)) OVER (PARTITION BY qid, k, power) AS h, CASE WHEN val IS NOT NULL THEN 1 / greatest(dist, 0.001) ** power END AS w
  FROM nb, (SELECT unnest({GRID_K}) AS k), (SELECT unnest({GRID_P})::DOUBLE AS power) WHERE rank <= k),
g AS (SELECT qid, k, power, any_value(truth) AS truth, sum(w) AS s, sum(w*du/h) AS a, sum(w*dv/h) AS b, sum(w*du*du/h/h) AS aa, sum(w*du*dv/h/h) AS ab, sum(w*dv*dv/h/h) AS bb,
  sum(w*val) AS z, sum(w*du*val/h) AS az, sum(w*dv*val/h) AS bz FROM s GROUP BY qid, k, power),
m AS (SELECT qid, k, power, truth, a / s AS p, b / s AS q, aa / s + 0.01 AS r, ab / s AS t, bb / s + 0.01 AS u, z / s AS x, az / s AS y, bz / s AS v FROM g),
e AS (SELECT k, power, truth, x AS base, x + least(greatest(((r*u-t*t)*x + (q*t-p*u)*y + (p*t-q*r)*v) / ((r*u-t*t) + p*(q*t-p*u) + q*(p*t-q*r)) - x, -500), 500) AS plane FROM m WHERE x IS NOT NULL)
SELECT k, power, 'idw' AS method, count(*) AS n, sqrt(avg((base - truth) ** 2)) AS rmse FROM e GROUP BY k, power
UNION ALL SELECT k, power, 'plane', count(*), sqrt(avg((plane - truth) ** 2)) FROM e GROUP BY k, power""", digits=4)
def neighbour_grid(spark, sf):
    """32 settings of neighbours, power and surface from one search at the largest k, scored at the query points."""
    p = small(spark, sf).withColumn("truth", F.col("u") * F.col("v") / 100)
    nb = small_knn(spark, sf, max(GRID_K)).join(p.select("id", F.col("u").alias("pu"), F.col("v").alias("pv"), F.when(F.col("id") % 5 != 0, F.col("truth")).alias("val")), "id")
    q = p.select(F.col("id").alias("qid"), "u", "v", "truth")
    nb = nb.join(q.drop("truth"), "qid").withColumn("du", F.col("pu") - F.col("u")).withColumn("dv", F.col("pv") - F.col("v"))
    g = SF.neighbour_grid(nb, ["qid"], "val", GRID_K, GRID_P, 0.01, limit=500.0).where(F.col("base").isNotNull()).join(q.select("qid", "truth"), "qid")
    e = g.groupBy("k", "power").agg(F.count(F.lit(1)).alias("n"), *[F.sqrt(F.avg((F.col(c) - F.col("truth")) ** 2)).alias(c) for c in ("base", "plane")])
    return e.select("k", "power", "n", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("rmse")) for m, c in (("idw", "base"), ("plane", "plane"))])))


@query("local_ridge_plane", "I4", "qid:l base:d plane:d", f"WITH {VAL}, {sql_plane('nv')}", digits=4)
def local_ridge_plane(spark, sf):
    return SF.local_plane(supplier_values(spark, sf), ["qid"], "h2", 0.01, limit=500.0)


PERG = VAL.replace("QUALIFY rank <= 8", "") + """, gm AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY dist, id) AS ig FROM nv QUALIFY ig = 1),
gt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM gm QUALIFY rk <= 4)"""


def one_per_group(spark, sf, m=4):
    """Nearest point of each of the m nearest foreign groups."""
    p = small(spark, sf)
    q = p.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v")
    near = nearest_groups(q, p, m)
    v = p.select("id", F.col("u").alias("pu"), F.col("v").alias("pv"), (F.col("u") * F.col("v") / 100).alias("h2"))
    t = near.join(v, "id").join(q.select("qid", "u", "v"), "qid")
    return t.withColumn("du", F.col("pu") - F.col("u")).withColumn("dv", F.col("pv") - F.col("v"))


@query("nearest_of_each_group", "D9", "qid:l grp:l id:l dist:d rank:l", f"WITH {PERG} SELECT qid, grp, id, dist, rk AS rank FROM gt")
def nearest_of_each_group(spark, sf):
    return one_per_group(spark, sf)


@query("one_per_group_surface", "I5", "qid:l base:d plane:d", f"WITH {PERG}, {sql_plane('gt')}", digits=4)
def one_per_group_surface(spark, sf):
    return SF.local_plane(one_per_group(spark, sf), ["qid"], "h2", 0.01, limit=500.0)


@query("aligned_metric_neighbours", "I6", "qid:l id:l dist:d rank:l", f"""
WITH {SMALL}, th AS (SELECT grp, round(0.5 * atan2(2 * covar_pop(u, v), var_pop(u) - var_pop(v)) / (pi() / 4)) * (pi() / 4) AS t FROM sp GROUP BY grp),
nb AS (SELECT a.id AS qid, b.id, sqrt((4 * ((b.u-a.u)*cos(t) + (b.v-a.v)*sin(t)))**2 + ((b.v-a.v)*cos(t) - (b.u-a.u)*sin(t))**2) AS dist
  FROM sp a JOIN th ON th.grp = a.grp JOIN sp b ON a.grp <> b.grp)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM nb QUALIFY rank <= 4""", digits=5)
def aligned_metric_neighbours(spark, sf):
    """Metric stretched along the direction of the query's own series, directions snapped to a few angles.

    One search per angle over all points: the number of angles is fixed, it does not grow with the data."""
    import math
    p = small(spark, sf)
    th = M.principal_direction(p, ["grp"], "u", "v").select("grp", F.round(F.col("theta") / (math.pi / 4)).cast("int").alias("a"))
    out = None
    for a in range(-2, 3):
        t = a * math.pi / 4
        rot = lambda d: d.withColumn("__u", 4 * (F.col("u") * math.cos(t) + F.col("v") * math.sin(t))).withColumn(
            "v", F.col("v") * math.cos(t) - F.col("u") * math.sin(t)).drop("u").withColumnRenamed("__u", "u")
        q = rot(p.join(th.where(F.col("a") == a), "grp", "left_semi"))
        r = knn(q.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v"), rot(p), 4)
        out = r if out is None else out.unionByName(r)
    return out


@query("aligned_metric_exact", "I6", "qid:l id:l dist:d rank:l", f"""
WITH {SMALL}, th AS (SELECT grp, 0.5 * atan2(2 * covar_pop(u, v), var_pop(u) - var_pop(v)) AS t FROM sp GROUP BY grp),
nb AS (SELECT a.id AS qid, b.id, sqrt((4 * ((b.u-a.u)*cos(t) + (b.v-a.v)*sin(t)))**2 + ((b.v-a.v)*cos(t) - (b.u-a.u)*sin(t))**2) AS dist
  FROM sp a JOIN th ON th.grp = a.grp JOIN sp b ON a.grp <> b.grp)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM nb QUALIFY rank <= 4""", digits=5)
def aligned_metric_exact(spark, sf):
    """As aligned_metric_neighbours with the exact direction of the query's own series."""
    p = small(spark, sf)
    th = M.principal_direction(p, ["grp"], "u", "v").select("grp", "theta")
    return knn_stretched(p.join(th, "grp").select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v", "theta"), p, 4, 4.0)


@query("aligned_metric_chord", "I6", "qid:l id:l dist:d rank:l", f"""
WITH {SMALL}, th AS (SELECT grp, atan2(arg_max(v, id) - arg_min(v, id), arg_max(u, id) - arg_min(u, id)) AS t FROM sp GROUP BY grp),
nb AS (SELECT a.id AS qid, b.id, sqrt((4 * ((b.u-a.u)*cos(t) + (b.v-a.v)*sin(t)))**2 + ((b.v-a.v)*cos(t) - (b.u-a.u)*sin(t))**2) AS dist
  FROM sp a JOIN th ON th.grp = a.grp JOIN sp b ON a.grp <> b.grp)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM nb QUALIFY rank <= 4""", digits=5)
def aligned_metric_chord(spark, sf):
    """Neighbours in the metric stretched along the line from the first to the last point of the query's own series."""
    p = small(spark, sf)
    th = M.chord_direction(p, ["grp"], "u", "v", F.col("id"))
    return knn_stretched(p.join(th, "grp").select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v", "theta"), p, 4, 4.0)


@query("surface_prediction", "I7", "qgrp:l c:d nn:d rmse:d n:l", f"""
WITH {VAL}, s AS (SELECT qid, qgrp, min(dist) AS nn, sum(w * h2) / sum(w) AS s FROM nv GROUP BY qid, qgrp),
t AS (SELECT s.*, u * v / 100 AS truth, v / 10 AS z, row_number() OVER (PARTITION BY qgrp ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY qgrp) AS k FROM s JOIN sp ON sp.id = qid),
c AS (SELECT qgrp, median(truth - (s - z)) AS c FROM t WHERE i < k // 2 GROUP BY qgrp)
SELECT qgrp, c, avg(nn) AS nn, sqrt(avg((truth - (s - z + c))**2)) AS rmse, count(*) AS n FROM t JOIN c USING (qgrp) WHERE i >= k // 2 GROUP BY qgrp, c""", digits=4)
def surface_prediction(spark, sf):
    """Interpolated surface minus elevation plus the offset calibrated on the known half of each series."""
    from ..operators.ordering import number_rows
    s = SF.idw(supplier_values(spark, sf), ["qid"], ["h2"])
    p = number_rows(small(spark, sf), ["grp"], "id", "id").select(
        F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "seq", "n", (F.col("u") * F.col("v") / 100).alias("truth"), (F.col("v") / 10).alias("z"))
    t = s.join(p, "qid").withColumn("base", F.col("h2") - F.col("z"))
    known = F.col("seq") < F.floor(F.col("n") / 2)
    c = group_quantiles(t.where(known), ["qgrp"], F.col("truth") - F.col("base"), {"c": 0.5})
    e = F.col("truth") - F.col("base") - F.col("c")
    return t.where(~known).join(c, "qgrp").groupBy("qgrp", "c").agg(
        F.avg("nn").alias("nn"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("surface_over_cloud", "I2 I4", "qid:l nn:d h1:d h2:d h3:d")
def surface_over_cloud(spark, sf):
    """Three surfaces at every point of the cloud from its eight foreign neighbours (checked by brute force in tests)."""
    return SF.idw(neighbours(spark, sf, values=HS), ["qid"], HS)


@query("quadratic_trend", "E27", "n:l r2:d resid_sd:d")
def quadratic_trend(spark, sf):
    """Six-term trend of the first horizon over the whole cloud and the spread that remains."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    t = B.cloud(spark, sf).select((F.col("x") / 5000).alias("a"), (F.col("y") / 2500).alias("b"), F.col("h3").alias("label"))
    t = t.select("label", "a", "b", (F.col("a") * F.col("a")).alias("aa"), (F.col("a") * F.col("b")).alias("ab"), (F.col("b") * F.col("b")).alias("bb"))
    f = VectorAssembler(inputCols=["a", "b", "aa", "ab", "bb"], outputCol="features").transform(t)
    p = LinearRegression(solver="normal").fit(f).transform(f)
    e = F.col("label") - F.col("prediction")
    return p.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2"), F.stddev_pop(e).alias("resid_sd"))


@query("density_clusters", "E30", "cluster:l size:l core:l")
def density_clusters(spark, sf):
    """Centroid clusters: neighbours within three median distances, cores have three, borders join the lowest label.

    Cells have a diagonal of eps, so the cores of a cell are one cluster and the graph has one node per cell."""
    c = materialize(centroids(spark, sf).select("id", "u", "v"), "centroids")
    q = c.withColumn("grp", F.col("id"))
    nn = knn(q.select(F.col("id").alias("qid"), F.col("grp").alias("qgrp"), "u", "v"), q, 1)
    eps = 3 * group_quantiles(nn, [], F.col("dist"), {"m": 0.5}).first()["m"]
    return clusters(c, eps, 3, lambda d: materialize(d, "cluster"))
