"""Reweighted polynomial projection of whole series, as rounds of aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.small_solve import solve_definite
from .calibrate import parabola
from .quantiles import group_quantiles


def project_parabola(df: DataFrame, key: str, x: str, u: str, checkpoint: Callable[[DataFrame], DataFrame],
                     rounds: int = 4, cval: float = 4.0, loss: str = "cauchy", min_rows: int = 7) -> DataFrame:
    """Robust degree-2 fit of u over x per series; adds `fit` (null where no fit is possible).

    x is mapped to [-1, 1].  The weight multiplies both sides of the least-squares system, so the normal
    equations carry its square.  Scale is 1.4826 times the median absolute deviation around the median."""
    b = df.groupBy(key).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.count(F.lit(1)).alias("__k"))
    t = df.join(b, key).withColumn("__t", F.when(
        (F.col("__k") >= min_rows) & (F.col("__x1") > F.col("__x0")),
        2 * (F.col(x) - F.col("__x0")) / (F.col("__x1") - F.col("__x0")) - 1)).drop("__x0", "__x1", "__k")
    t = checkpoint(t)
    cur = t.withColumn("__w", F.lit(1.0))
    for i in range(rounds):
        beta = parabola(cur, [key], F.col("__t"), F.col(u), F.col("__w") * F.col("__w"))
        cur = t.join(beta, key).withColumn("fit", F.col("c0") + F.col("c1") * F.col("__t") + F.col("c2") * F.col("__t") * F.col("__t"))
        cur = cur.withColumn("__r", F.col(u) - F.col("fit"))
        if i == rounds - 1:
            break
        cur = checkpoint(cur.drop("c0", "c1", "c2"))
        med = group_quantiles(cur, [key], F.col("__r"), {"__m": 0.5})
        dev = group_quantiles(cur.join(med, key), [key], F.abs(F.col("__r") - F.col("__m")), {"__d": 0.5})
        sc = cval * (1.4826 * F.col("__d") + 1e-6)
        if loss == "cauchy":
            w = 1 / (1 + (F.col("__r") / sc) * (F.col("__r") / sc))
        else:
            w = 1 / F.greatest(F.lit(1.0), F.abs("__r") / sc)
        cur = cur.join(dev, key).withColumn("__w", w).drop("__d")
    return cur.select(*df.columns, "fit")


def polynomial(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column, degree: int) -> DataFrame:
    """Weighted least squares per group from power sums, coefficients c0 to c<degree>; null where the sums are singular."""
    power = [F.lit(1.0)]
    for _ in range(2 * degree):
        power.append(power[-1] * x)
    sums = [F.sum(w * e).alias(f"__s{i}") for i, e in enumerate(power)] + [F.sum(w * e * y).alias(f"__r{i}") for i, e in enumerate(power[: degree + 1])]
    g = df.groupBy(*keys).agg(*sums)
    names = [f"c{i}" for i in range(degree + 1)]
    a = [[f"__s{i + j}" for j in range(i + 1)] for i in range(degree + 1)]
    return solve_definite(g, a, [f"__r{i}" for i in range(degree + 1)], names).select(*keys, *names)


def project(df: DataFrame, key: str, x: str, u: str, checkpoint: Callable[[DataFrame], DataFrame], degree: int = 3, rounds: int = 4,
            cval: float = 4.0, loss: str = "cauchy") -> DataFrame:
    """Robust polynomial fit of u over x per series, of any degree up to 5; adds `fit`, null where a series has fewer than
    degree + 5 rows, no span, or singular sums.

    As in `project_parabola`, x is mapped to [-1, 1], weights enter squared and the scale is 1.4826 times the median absolute
    deviation around the median.  loss: "cauchy" or "huber".  One table is written a round; the rows are joined to it and to
    the input once."""
    if loss not in ("cauchy", "huber"):
        raise ValueError(f"unknown loss {loss}")
    if not 1 <= degree <= 5:
        raise ValueError("the degree is from 1 to 5")
    b = df.groupBy(key).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.count(F.lit(1)).alias("__k"))
    t = df.join(b, key).withColumn("__t", F.when(
        (F.col("__k") >= degree + 5) & (F.col("__x1") > F.col("__x0")),
        2 * (F.col(x) - F.col("__x0")) / (F.col("__x1") - F.col("__x0")) - 1)).drop("__x0", "__x1", "__k")
    t = checkpoint(t)
    cur = t.withColumn("__w", F.lit(1.0))
    names = [f"c{i}" for i in range(degree + 1)]
    for i in range(rounds):
        beta = polynomial(cur.where(F.col("__t").isNotNull()), [key], F.col("__t"), F.col(u), F.col("__w") * F.col("__w"), degree)
        value = F.col(names[-1])
        for n in reversed(names[:-1]):
            value = value * F.col("__t") + F.col(n)
        cur = t.join(beta, key, "left").withColumn("fit", value).withColumn("__r", F.col(u) - F.col("fit")).drop(*names)
        if i == rounds - 1:
            break
        cur = checkpoint(cur)
        med = group_quantiles(cur, [key], F.col("__r"), {"__m": 0.5})
        dev = group_quantiles(cur.join(med, key), [key], F.abs(F.col("__r") - F.col("__m")), {"__d": 0.5})
        r = F.abs("__r") / (cval * (1.4826 * F.col("__d") + 1e-6))
        w = 1 / (1 + r * r) if loss == "cauchy" else 1 / F.greatest(F.lit(1.0), r)
        cur = cur.join(dev, key).select(*t.columns, w.alias("__w"))
    return cur.select(*df.columns, "fit")
