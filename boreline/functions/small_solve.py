"""Small symmetric systems as column expressions: closed forms for two and three unknowns, a Cholesky factor for more.

Each returns null where the system is singular, so callers can fall back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def _ratio(num: Column, det: Column, scale: Column) -> Column:
    return F.when(F.abs(det) > TINY * F.greatest(F.abs(scale), F.lit(1e-300)), num / det)


def solve2(a11, a12, a22, b1, b2) -> list[Column]:
    det = a11 * a22 - a12 * a12
    sc = a11 * a22
    return [_ratio(b1 * a22 - a12 * b2, det, sc), _ratio(a11 * b2 - a12 * b1, det, sc)]


def solve3(a11, a12, a13, a22, a23, a33, b1, b2, b3) -> list[Column]:
    """Cofactors of a symmetric matrix applied to the right-hand side."""
    c11, c12, c13 = a22 * a33 - a23 * a23, a13 * a23 - a12 * a33, a12 * a23 - a13 * a22
    c22, c23, c33 = a11 * a33 - a13 * a13, a12 * a13 - a11 * a23, a11 * a22 - a12 * a12
    det = a11 * c11 + a12 * c12 + a13 * c13
    sc = a11 * a22 * a33
    return [
        _ratio(c11 * b1 + c12 * b2 + c13 * b3, det, sc),
        _ratio(c12 * b1 + c22 * b2 + c23 * b3, det, sc),
        _ratio(c13 * b1 + c23 * b2 + c33 * b3, det, sc),
    ]


#: A pivot below this share of its diagonal entry means a singular system.
PIVOT = 1e-11


def solve_definite(df: DataFrame, a: list[list[str]], b: list[str], out: list[str], ridge: float = 0.0) -> DataFrame:
    """df with `out`, the solution of a positive definite system whose lower triangle a[i][j] (j <= i) and right side b are
    names of columns; null where a pivot falls below PIVOT of its diagonal entry.

    The factor is made column by column, each in a projection of its own, so no expression is repeated inside another."""
    p, t = len(b), df
    c, name = F.col, lambda i, j: f"__l{i}_{j}"
    for j in range(p):
        diagonal = c(a[j][j]) + ridge
        rest = diagonal
        for k in range(j):
            rest = rest - c(name(j, k)) * c(name(j, k))
        t = t.withColumn("__d", rest).withColumn(name(j, j), F.when((diagonal > 0) & (c("__d") > PIVOT * diagonal), F.sqrt("__d")))
        below = {}
        for i in range(j + 1, p):
            e = c(a[i][j])
            for k in range(j):
                e = e - c(name(i, k)) * c(name(j, k))
            below[name(i, j)] = e / c(name(j, j))
        if below:
            t = t.withColumns(below)
    for i in range(p):
        e = c(b[i])
        for k in range(i):
            e = e - c(name(i, k)) * c(f"__y{k}")
        t = t.withColumn(f"__y{i}", e / c(name(i, i)))
    for i in reversed(range(p)):
        e = c(f"__y{i}")
        for k in range(i + 1, p):
            e = e - c(name(k, i)) * c(out[k])
        t = t.withColumn(out[i], e / c(name(i, i)))
    return t.drop("__d", *[name(i, j) for i in range(p) for j in range(i + 1)], *[f"__y{i}" for i in range(p)])
