"""Density clusters of points by cells, without pairs inside a cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .surface import components

SPLIT = 8


def clusters(points: DataFrame, eps: float, min_pts: int, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Clusters of points (id, u, v): label, size, number of cores; label -1 counts the points in none.

    A cell of diagonal eps with `min_pts` points makes all of them cores, and all cores of a cell belong
    together, so cells are the nodes of the graph.  Two cells are linked through parts of cells that lie
    within eps as a whole; single points are compared only for parts where that is undecided, and only
    for cells not linked yet.  Only points of cells with fewer than `min_pts` points count neighbours.
    With eps 0 only points at one place are neighbours."""
    if eps <= 0:
        places = points.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("head"))
        dense = F.col("k") >= min_pts
        return places.groupBy(F.when(dense, F.col("head")).otherwise(-1).alias("cluster")).agg(
            F.sum("k").alias("size"), F.sum(F.when(dense, F.col("k")).otherwise(0)).alias("core"))
    side = eps / 1.4142137
    c = points.withColumn("cx", F.floor(F.col("u") / side)).withColumn("cy", F.floor(F.col("v") / side))
    size = c.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("k"))
    c = c.join(size, ["cx", "cy"])
    full = F.col("k") >= min_pts
    off = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-2, 3) for j in range(-2, 3)])
    gap = F.hypot(F.col("u") - F.col("u2"), F.col("v") - F.col("v2"))

    def around(df):
        rest = [x for x in df.columns if x not in ("cx", "cy")]
        t = df.select(*rest, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.inline(off))
        return t.select(*rest, "ax", "ay", (F.col("ax") + F.col("dx")).alias("cx"), (F.col("ay") + F.col("dy")).alias("cy"))

    thin = around(c.where(~full).select("id", "u", "v", "cx", "cy"))
    every = c.select(F.col("id").alias("id2"), F.col("u").alias("u2"), F.col("v").alias("v2"), "cx", "cy")
    deg = thin.join(every, ["cx", "cy"]).where(gap <= eps).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    flags = checkpoint(c.join(deg, "id", "left").select(
        "id", "u", "v", "cx", "cy", full.alias("full"), (full | (F.coalesce("deg", F.lit(0)) >= min_pts)).alias("core")))

    part = side / SPLIT
    core = flags.where("core").withColumn("sx", F.floor(F.col("u") / part)).withColumn("sy", F.floor(F.col("v") / part))
    heads = checkpoint(core.groupBy("cx", "cy").agg(F.min("id").alias("head")))
    parts = core.select("cx", "cy", "sx", "sy").distinct()
    pp = around(parts).join(parts.select("cx", "cy", F.col("sx").alias("tx"), F.col("sy").alias("ty")), ["cx", "cy"])
    pp = pp.where((F.col("ax") < F.col("cx")) | ((F.col("ax") == F.col("cx")) & (F.col("ay") < F.col("cy"))))
    wx, wy = F.abs(F.col("sx") - F.col("tx")), F.abs(F.col("sy") - F.col("ty"))
    far = F.hypot((wx + 1) * part, (wy + 1) * part)
    near = F.hypot(F.greatest(wx - 1, F.lit(0)) * part, F.greatest(wy - 1, F.lit(0)) * part)
    pp = checkpoint(pp.withColumn("sure", far <= eps).where(near <= eps))
    pair = ["ax", "ay", "cx", "cy"]
    sure = pp.where("sure").select(*pair).distinct()
    open_ = pp.where(~F.col("sure")).join(sure, pair, "left_anti")
    a = core.select(F.col("u"), F.col("v"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), "sx", "sy")
    b = core.select(F.col("u").alias("u2"), F.col("v").alias("v2"), "cx", "cy", F.col("sx").alias("tx"), F.col("sy").alias("ty"))
    tested = open_.join(a, ["ax", "ay", "sx", "sy"]).join(b, ["cx", "cy", "tx", "ty"]).where(gap <= eps).select(*pair).distinct()
    links = sure.unionByName(tested)
    edges = links.join(heads.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("head").alias("a")), ["ax", "ay"]).join(
        heads.withColumnRenamed("head", "b"), ["cx", "cy"]).select("a", "b")
    lab = components(edges, heads.select(F.col("head").alias("node")), checkpoint)
    cells = checkpoint(heads.join(lab, F.col("head") == F.col("node")).select("cx", "cy", "label"))

    near_core = every.join(flags.where("core").select(F.col("id").alias("id2")), "id2", "left_semi").join(cells, ["cx", "cy"])
    border = thin.join(flags.where(~F.col("core")).select("id"), "id", "left_semi").join(near_core, ["cx", "cy"]).where(gap <= eps)
    border = border.groupBy("id").agg(F.min("label").alias("l2"))
    out = flags.join(cells, ["cx", "cy"], "left").join(border, "id", "left")
    name = F.when(F.col("core"), F.col("label")).otherwise(F.coalesce("l2", F.lit(-1)))
    return out.groupBy(name.alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("core").cast("long")).alias("core"))
