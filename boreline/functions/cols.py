"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo, hi) -> Column:
    """Bound a column; a null stays null (greatest/least alone would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def safe_div(num: Column, den: Column) -> Column:
    """num/den, null where den is zero or null."""
    return F.when(den != 0, num / den)


def sq(c: Column) -> Column:
    return c * c


def rms(e: Column) -> Column:
    """Aggregate: root mean square."""
    return F.sqrt(F.avg(e * e))


def add(*cs: Column) -> Column:
    return reduce(lambda a, b: a + b, cs)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def digitize(x: Column, edges: list[float], closed: str = "left") -> Column:
    """Bin number 0..len(edges)-2; closed='left' is [lo,hi), 'right' is (lo,hi]; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        inside = (x >= lo) & (x < hi) if closed == "left" else (x > lo) & (x <= hi)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def bin_centers(edges: list[float]) -> list[float]:
    """Midpoints; an open last bin ends at twice its lower edge."""
    cap = 2.0 * edges[-2]
    return [0.5 * (lo + min(hi, cap)) for lo, hi in zip(edges[:-1], edges[1:])]


def curve_value(x: Column, knots: list[float], values: list) -> Column:
    """Piecewise-linear lookup on a short literal curve, held constant outside it."""
    vals = [v if isinstance(v, Column) else F.lit(float(v)) for v in values]
    out = vals[-1]
    for i in reversed(range(len(knots) - 1)):
        k0, k1 = float(knots[i]), float(knots[i + 1])
        seg = vals[i] + (vals[i + 1] - vals[i]) * ((x - k0) / (k1 - k0))
        out = F.when(x < k1, seg).otherwise(out)
    return F.when(x.isNotNull(), F.when(x < float(knots[0]), vals[0]).otherwise(out))


def sigmoid_gate(x: Column, x0: float, scale: float) -> Column:
    """Falls from 1 to 0 as x passes x0."""
    return 1.0 / (1.0 + F.exp(clip((x - x0) / scale, -50, 50)))


def ramp_up(x: Column, tau: float) -> Column:
    """0 at x=0, tending to 1."""
    return 1.0 - F.exp(-F.greatest(x, F.lit(0.0)) / tau)


def softmax(scores: list[Column]) -> list[Column]:
    """Softmax over columns of one row, shifted by the maximum."""
    top = F.greatest(*scores)
    ex = [F.exp(s - top) for s in scores]
    tot = add(*ex)
    return [e / tot for e in ex]


def rotate_stretch(x: Column, y: Column, theta: float, along: float = 1.0, across: float = 1.0):
    """Coordinates along / across a direction, each axis scaled."""
    c, s = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    return (x * c + y * s) * along, (y * c - x * s) * across


def row_median(cs: list[Column]) -> Column:
    """Median of a few columns of one row, nulls left out."""
    a = F.array_sort(F.array_compact(F.array(*cs)))
    n = F.size(a)
    lo = F.get(a, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def row_mean(cs: list[Column]) -> Column:
    n = add(*[F.when(c.isNotNull(), 1).otherwise(0) for c in cs])
    return F.when(n > 0, add(*[F.coalesce(c, F.lit(0.0)) for c in cs]) / n)


def row_std(cs: list[Column]) -> Column:
    """Population standard deviation across columns of one row (no nulls expected)."""
    m = add(*cs) / len(cs)
    return F.sqrt(add(*[(c - m) * (c - m) for c in cs]) / len(cs))
