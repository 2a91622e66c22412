"""Curve lookups: a row finds its segment by going down the knots' ranks, FAN to one, in equi-joins.

The knots of a curve are numbered; every FAN-th of them, every FAN**2-th and so on are the upper levels.  At each level a row
meets the at most FAN knots below the one it has come to, so neither wide gaps nor crowded places cost anything, and a curve
of up to FAN knots is one join, which Spark broadcasts where the curves are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from .ordering import framed, largest, number_rows

ONE = "__one"
FAN = 64


def _knots(curve: DataFrame, keys: list[str], k: str, v: str) -> DataFrame:
    """Knots averaged per key and numbered within their curve."""
    c = curve.where(F.col(k).isNotNull() & F.col(v).isNotNull())
    c = c.groupBy(*keys, F.col(k).cast("double").alias("k0")).agg(F.avg(v).alias("v0"))
    if not keys:
        c = c.withColumn(ONE, F.lit(1))
    return number_rows(materialize(c, "knots"), keys or [ONE], "k0", "k0").drop("order0")


def _with_next(knots: DataFrame, gk: list[str], every: int = 1) -> DataFrame:
    """Every so many-th knot with the next of these (k1, v1; null on the last)."""
    some = knots.where(F.col("seq") % every == 0).withColumn("__at", (F.col("seq") / every).cast("long"))
    return framed(some, gk, 1, lambda w: {"k1": F.lead("k0").over(w), "v1": F.lead("v0").over(w)}, seq="__at").drop("__at")


def segments(curve: DataFrame, keys: list[str], k: str = "k", v: str = "v") -> DataFrame:
    """Knots averaged per key, each with its successor (k1, v1; null on the last knot)."""
    gk = keys or [ONE]
    return _with_next(_knots(curve, keys, k, v), gk).select(*gk, "k0", "v0", "k1", "v1")


def segment_join(df: DataFrame, key: Column, curve: DataFrame, keys: list[str], k: str = "k", v: str = "v") -> DataFrame:
    """Each row with the segment its key falls in (columns key, k0, v0, k1, v1).

    Keys beyond an end get the end segment with `key` moved to the end; a null key gets nulls."""
    gk = keys or [ONE]
    knots = materialize(_knots(curve, keys, k, v), "numbered-knots")
    most, levels = largest(knots, "n"), 1
    while FAN ** levels < most:
        levels += 1
    rows = df if keys else df.withColumn(ONE, F.lit(1))
    rows = rows.withColumn("__q", key.cast("double")).withColumn("__c", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        every = FAN ** level
        s = _with_next(knots, gk, every).select(
            *gk, F.floor(F.col("seq") / (every * FAN)).cast("long").alias("__p"), F.floor(F.col("seq") / every).cast("long").alias("__i"), "k0", "v0", "k1", "v1",
            F.when(F.col("seq") == 0, F.lit(float("-inf"))).otherwise(F.col("k0")).alias("__from"))
        on = F.col("r.__c") == F.col("s.__p")
        for c in gk:
            on = on & (F.col(f"r.{c}") == F.col(f"s.{c}"))
        on = on & (F.col("r.__q") >= F.col("s.__from")) & (F.col("s.k1").isNull() | (F.col("r.__q") < F.col("s.k1")))
        met = rows.alias("r").join(s.alias("s"), on, "left")
        if level:
            rows = met.select(*[f"r.{c}" for c in rows.columns if c != "__c"], F.col("s.__i").alias("__c"))
        else:
            at = F.when((F.col("r.__q") < F.col("s.k0")) | F.col("s.k1").isNull(), F.col("s.k0")).otherwise(F.col("r.__q"))
            return met.select(*[f"r.{c}" for c in df.columns], at.alias("key"), "s.k0", "s.v0", "s.k1", "s.v1")


def curve_lookup(df: DataFrame, key: Column, curve: DataFrame, keys: list[str], out: str,
                 k: str = "k", v: str = "v") -> DataFrame:
    """Piecewise-linear value of the curve at `key`, held constant outside its range."""
    t = segment_join(df, key, curve, keys, k, v)
    val = F.coalesce(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("key") - F.col("k0"))
                     / (F.col("k1") - F.col("k0")), F.col("v0"))
    return t.select(*df.columns, val.alias(out))


def nearest_knot(df: DataFrame, key: Column, curve: DataFrame, keys: list[str]) -> DataFrame:
    """Closest knot (`near_k`, `near_v`); the lower one wins ties."""
    t = segment_join(df, key, curve, keys)
    low = F.col("k1").isNull() | (F.col("key") - F.col("k0") <= F.col("k1") - F.col("key"))
    return t.select(*df.columns, F.when(low, F.col("k0")).otherwise(F.col("k1")).alias("near_k"),
                    F.when(low, F.col("v0")).otherwise(F.col("v1")).alias("near_v"))


def dense_grid(curve: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Curve values on the grid kmin + i*cell; the last grid point may pass the end and is held there."""
    seg = segments(curve, keys)
    gk = keys or [ONE]
    ends = seg.groupBy(*gk).agg(F.min("k0").alias("kmin"), F.max("k0").alias("kmax"))
    s = seg.join(ends, gk)
    lo = F.ceil((F.col("k0") - F.col("kmin")) / cell)
    hi = F.when(F.col("k1").isNull(), F.ceil((F.col("kmax") - F.col("kmin")) / cell)).otherwise(
        F.ceil((F.col("k1") - F.col("kmin")) / cell) - 1)
    s = s.where(hi >= lo).withColumn("g", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    at = F.col("kmin") + F.col("g") * cell
    val = F.coalesce(F.col("v0") + (F.col("v1") - F.col("v0")) * (at - F.col("k0")) / (F.col("k1") - F.col("k0")),
                     F.col("v0"))
    return s.select(*gk, "g", val.alias("gv"), "kmin", "kmax")


def grid_lookup(df: DataFrame, key: Column, grid: DataFrame, keys: list[str], cell: float, out: str) -> DataFrame:
    """Linear value between the two grid cells around `key`: two equi-joins on the cell number."""
    gk = keys or [ONE]
    ends = grid.groupBy(*gk).agg(F.first("kmin").alias("__lo"), F.max("g").alias("__gm"))
    rows = df if keys else df.withColumn(ONE, F.lit(1))
    pos = F.least(F.greatest((key - F.col("__lo")) / cell, F.lit(0.0)), F.col("__gm").cast("double"))
    rows = rows.join(ends, gk).withColumn("__p", pos).withColumn(
        "__g", F.least(F.floor("__p"), F.greatest(F.col("__gm") - 1, F.lit(0))).cast("long"))
    a = grid.select(*gk, F.col("g").alias("__g"), F.col("gv").alias("__v0"))
    b = grid.select(*gk, (F.col("g") - 1).alias("__g"), F.col("gv").alias("__v1"))
    t = rows.join(a, [*gk, "__g"]).join(b, [*gk, "__g"], "left")
    val = F.coalesce(F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__p") - F.col("__g")), F.col("__v0"))
    return t.select(*df.columns, val.alias(out))
