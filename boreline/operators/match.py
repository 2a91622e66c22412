"""Matching of series: near-copies of a path, shifts along a curve, shapes inside a series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import framed

#: Values of a band of paths, and runs of places whose sums bound a distance.
CELLS, RUNS = 1 << 20, 8


def _dense(places: list, values: list, lo: int, width: int) -> np.ndarray:
    """Rows of values at the places lo .. lo+width-1, NaN where a path has none."""
    out = np.full((len(places), width), np.nan)
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    col = np.concatenate(places) - lo
    ok = (col >= 0) & (col < width)
    out[row[ok], col[ok]] = np.concatenate(values)[ok]
    return out


def _closest(key: str, tol: float, cover: float, pdf: pd.DataFrame) -> pd.DataFrame:
    """Closest path of side 1 below `tol` for each path of side 0 of one tile; of equally close ones the smallest key.

    Paths go in bands of CELLS values at most, so memory is bounded.  Sums over runs of places bound a distance
    from below (|sum of differences| <= sum of |differences|); only pairs whose bound is below the best so far are
    compared in full, and paths of a like mean are met first, which makes that best small early."""
    out = {key: [], "match": [], "dist": [], "cover": []}
    pdf = pdf.sort_values(key, ignore_index=True)  # an index of a row is its rank by key
    g, x, y = (list(pdf[c]) for c in ("g", "x", "y"))
    g0, g1, keys, side = (pdf[c].to_numpy() for c in ("g0", "g1", key, "side"))
    mean = np.array([np.nanmean(p + q) if np.isfinite(p + q).any() else 0.0 for p, q in zip(x, y)])
    mean = np.where(np.isfinite(mean), mean, 0.0)
    order = np.lexsort((mean, g0))
    todo, others = order[side[order] == 0], np.flatnonzero(side == 1)
    at = 0
    while at < len(todo):
        lo, hi, end = g0[todo[at]], g1[todo[at]], at + 1
        while end < len(todo) and end - at < 256:
            wide = max(hi, g1[todo[end]])
            if (end - at + 1) * (wide - lo + 1) > CELLS:
                break
            hi, end = wide, end + 1
        a, at, width = todo[at:end], end, int(hi - lo + 1)
        ax, ay = (_dense([g[i] for i in a], [v[i] for i in a], lo, width) for v in (x, y))
        runs = np.unique(np.linspace(0, width, min(width, RUNS) + 1).astype(int))[:-1]
        asum = np.add.reduceat(ax + ay, runs, axis=1)
        size = (~np.isnan(ax + ay)).sum(axis=1)
        best, match, share = np.full(len(a), tol), np.full(len(a), len(keys)), np.zeros(len(a))
        b_all = others[(g0[others] <= hi) & (g1[others] >= lo)]
        b_all = b_all[np.argsort(np.abs(mean[b_all] - mean[a].mean()), kind="stable")]
        done = 0
        while done < len(b_all):
            b = b_all[done:done + max(1, min(256 if done == 0 else 2048, CELLS // width))]
            done += len(b)
            bx, by = (_dense([g[i] for i in b], [v[i] for i in b], lo, width) for v in (x, y))
            bsum = np.add.reduceat(bx + by, runs, axis=1)
            least = np.zeros((len(a), len(b)))
            for r in range(len(runs)):
                d = asum[:, r, None] - bsum[None, :, r]
                least += np.fmax(np.abs(d, out=d), 0.0, out=d)
            slack = 1e-9 * (1.0 + max((np.abs(s[np.isfinite(s)]).max(initial=0.0) for s in (asum, bsum))))
            ia, ib = np.nonzero(least - slack <= (best * size)[:, None])
            over = np.minimum(g1[a[ia]], g1[b[ib]]) - np.maximum(g0[a[ia]], g0[b[ib]])
            ok = (a[ia] != b[ib]) & (keys[a[ia]] != keys[b[ib]]) & (over >= cover * (g1[a[ia]] - g0[a[ia]]))
            ia, ib, over = ia[ok], ib[ok], over[ok]
            if not len(ia):
                continue
            dist, step = np.empty(len(ia)), max(1, CELLS // width)
            for k in range(0, len(ia), step):
                i, j = ia[k:k + step], ib[k:k + step]
                d = np.abs(ax[i] - bx[j]) + np.abs(ay[i] - by[j])
                joint = ~(np.isnan(ax[i]) | np.isnan(bx[j]) | np.isnan(ay[i]) | np.isnan(by[j]))
                m = joint.sum(axis=1)
                dist[k:k + step] = np.where(m > 0, np.where(joint, d, 0.0).sum(axis=1) / np.maximum(m, 1), np.inf)
            first = np.lexsort((b[ib], dist, ia))
            first = first[np.r_[True, np.diff(ia[first]) > 0]]
            i, j, d = ia[first], b[ib[first]], dist[first]
            better = (d < best[i]) | ((d == best[i]) & (d < tol) & (j < match[i]))
            i, j, d = i[better], j[better], d[better]
            best[i], match[i], share[i] = d, j, over[first][better] / (g1[a[i]] - g0[a[i]])
        hit = match < len(keys)
        for name, v in ((key, keys[a[hit]]), ("match", keys[match[hit]]), ("dist", best[hit]), ("cover", share[hit])):
            out[name].extend(v)
    return pd.DataFrame(out)


def path_matches(grids: DataFrame, key: str, tol: float, checkpoint: Callable[[DataFrame], DataFrame], min_rows: int = 10,
                 cover: float = 0.5, pack: int = 8192) -> DataFrame:
    """Closest near-copy of each path (columns key, g, x, y on a common grid) with mean L1 distance below `tol`.

    Exact, and no table of pairs is written:
    * identical paths are found by hash and answered at once, one of them stands for all afterwards;
    * a path is one row, and packs of paths meet each other in tiles: at most about `pack` of those that still need a match
      against four times as many others, or as many as hold 128 places each.  Tiles are dealt out by hash and hand on one row a
      path, so what is shuffled is the paths, once a pack, whatever their number of near pairs."""
    span = grids.groupBy(key).agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count(F.lit(1)).alias("rows"), *[
        F.sum(F.xxhash64("g", "x", "y", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)])
    same = ["g0", "g1", "rows", "s1", "s2"]
    grp = span.groupBy(*same).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"))
    who = checkpoint(span.join(grp, same).select(key, "g0", "g1", "rows", "rep", "copies"))
    long = F.col("g1") - F.col("g0") + 1 >= min_rows
    second = who.where(F.col(key) != F.col("rep")).groupBy("rep").agg(F.min(key).alias("second"))
    twin = who.where((F.col("copies") > 1) & long).join(second, "rep").select(
        key, F.when(F.col(key) == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("match"), F.lit(0.0).alias("dist"), F.lit(1.0).alias("cover"))
    reps = who.where(F.col(key) == F.col("rep")).select(key, "g0", "g1", "rows", ((F.col("copies") == 1) & long).alias("todo"))
    need, all_, need_rows, all_rows = reps.agg(
        F.count(F.when(F.col("todo"), 1)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("todo"), F.col("rows"))), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if need == 0:
        return twin
    na, nb = (max(1, -(-n // size), -(-v // (128 * size))) for n, v, size in ((need, need_rows, pack), (all_, all_rows, 4 * pack)))
    # NaN stands for a missing value in a tile; a value that is NaN is as far as can be from any other.
    num = {c: F.when(F.isnan(c), F.lit(float("inf"))).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))) for c in ("x", "y")}
    packed = grids.join(reps.select(key, "todo"), key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), *[v.alias(c) for c, v in num.items()]))).alias("p"),
        F.min("g").cast("long").alias("g0"), F.max("g").cast("long").alias("g1"), F.first("todo").alias("todo"))
    packed = checkpoint(packed.select(key, "g0", "g1", "todo", *[F.col("p")[c].alias(c) for c in ("g", "x", "y")]))
    row, col = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(na)), F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(nb))
    names = [key, "g0", "g1", "g", "x", "y"]
    a = packed.where("todo").select(*names, F.lit(0).alias("side"), F.explode(F.sequence(row * nb, row * nb + nb - 1)).alias("tile"))
    b = packed.select(*names, F.lit(1).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(na - 1)), lambda i: i * nb + col)).alias("tile"))
    kt = grids.schema[key].dataType.simpleString()
    near = a.unionByName(b).repartition(na * nb, "tile").groupBy("tile").applyInPandas(
        lambda pdf: _closest(key, tol, cover, pdf), f"{key} {kt}, match {kt}, dist double, cover double")
    best = near.groupBy(key).agg(F.min(F.struct("dist", "match", "cover")).alias("m"))
    best = checkpoint(best.select(key, F.col("m")["match"].alias("match"), F.col("m")["dist"].alias("dist"), F.col("m")["cover"].alias("cover")))
    return twin.unionByName(best)


def grid_at(arr: Column, pos: Column) -> Column:
    """Linear value of an evenly spaced array at a fractional position, held at both ends."""
    p = F.least(F.greatest(pos, F.lit(0.0)), (F.size(arr) - 1).cast("double"))
    i = F.least(F.floor(p).cast("int"), F.size(arr) - 2)
    lo, hi = F.get(arr, i), F.get(arr, i + 1)
    return lo + (hi - lo) * (p - i)


def shift_scores(df: DataFrame, keys: list[str], obs: str, at: Column, curve: str, shifts: list[float], k0: float, cell: float) -> DataFrame:
    """Moments of observation against the shifted curve per group and shift, in one aggregation.

    `curve` is an array column on the grid k0 + i*cell.  Each row adds to one small array of sums, so
    shifts are columns of an aggregate and not copies of the rows."""
    ok = F.col(obs).isNotNull() & at.isNotNull()
    t = df.where(ok).withColumn("__at", at)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(obs).alias("so"), F.sum(F.col(obs) * F.col(obs)).alias("soo")]
    for i, s in enumerate(shifts):
        p = grid_at(F.col(curve), (F.col("__at") + s - k0) / cell)
        aggs += [F.sum(p).alias(f"p{i}"), F.sum(p * p).alias(f"q{i}"), F.sum(p * F.col(obs)).alias(f"r{i}")]
    g = t.groupBy(*keys).agg(*aggs)
    items = F.array(*[F.struct(F.lit(float(s)).alias("shift"), F.lit(i).alias("i"), F.col(f"p{i}").alias("sp"),
                               F.col(f"q{i}").alias("spp"), F.col(f"r{i}").alias("spo")) for i, s in enumerate(shifts)])
    return g.select(*keys, "n", "so", "soo", F.inline(items))


def best_shift(scores: DataFrame, keys: list[str], score: Column, digits: int) -> DataFrame:
    """Shift with the highest score; the first one when scores agree to `digits`."""
    t = scores.withColumn("__s", score)
    g = t.groupBy(*keys).agg(F.min(F.struct((-F.round("__s", digits)).alias("a"), "i", "shift", "__s", "n")).alias("m"))
    return g.select(*keys, F.col("m")["shift"].alias("shift"), F.col("m")["__s"].alias("score"), F.col("m")["n"].alias("n"))


def shift_correlations(df: DataFrame, keys: list[str], obs: str, at: Column, curve: str, shifts: list[float], k0: float, cell: float) -> DataFrame:
    """keys, n, shift, i, r: correlation of observation and shifted curve, 0 where either side is constant.

    As shift_scores, but with central moments: plain sums of squares of values far from 0 lose the digits that
    tell a constant side, and shifts that tie, apart."""
    t = df.where(F.col(obs).isNotNull() & at.isNotNull()).withColumn("__at", at)
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop(obs).alias("so")]
    for i, s in enumerate(shifts):
        p = grid_at(F.col(curve), (F.col("__at") + s - k0) / cell)
        aggs += [F.covar_pop(obs, p).alias(f"c{i}"), F.stddev_pop(p).alias(f"s{i}")]
    g = t.groupBy(*keys).agg(*aggs)
    r = [F.when((F.col("so") > 0) & (F.col(f"s{i}") > 0), F.col(f"c{i}") / F.col("so") / F.col(f"s{i}")).otherwise(0.0) for i in range(len(shifts))]
    items = F.array(*[F.struct(F.lit(float(s)).alias("shift"), F.lit(i).alias("i"), r[i].alias("r")) for i, s in enumerate(shifts)])
    return g.select(*keys, "n", F.inline(items))


def log_likelihood(a: Column, b: Column, sigma: Column) -> Column:
    """Sum of -((o - a p - b)/sigma)^2 / 2 from the moments."""
    c = F.col
    sse = (c("soo") - 2 * a * c("spo") - 2 * b * c("so") + a * a * c("spp") + 2 * a * b * c("sp") + c("n") * b * b)
    return -0.5 * sse / (sigma * sigma)


def window_shapes(df: DataFrame, keys: list[str], v: str, half: int, out: str) -> DataFrame:
    """Array of the 2*half+1 values around each row, end values repeated, scaled to mean 0 and deviation 1."""
    def make(w):
        return {"__a": F.collect_list(v).over(w.rowsBetween(-half, half)),
                "__k": F.count(F.lit(1)).over(w.rowsBetween(-half, -1))}
    t = framed(df, keys, half, make)
    n = 2 * half + 1
    pad = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.col("__a"), F.greatest(
        F.lit(0), F.least(F.size("__a") - 1, i - half + F.col("__k").cast("int")))))
    t = t.withColumn("__p", pad)
    t = t.withColumn("__m", F.aggregate("__p", F.lit(0.0), lambda s, x: s + x) / n)
    t = t.withColumn("__d", F.sqrt(F.aggregate("__p", F.lit(0.0), lambda s, x: s + (x - F.col("__m")) * (x - F.col("__m"))) / n) + 1e-6)
    t = t.withColumn(out, F.transform("__p", lambda x: (x - F.col("__m")) / F.col("__d")))
    return t.withColumn("__whole", (F.col("__k") == half) & (F.size("__a") == n)).drop("__a", "__k", "__p", "__m", "__d")


def best_templates(rows: DataFrame, templates: DataFrame, key: str, value: str, width: int, block: int = 256) -> DataFrame:
    """For each row (key, seq, z) the template (key, i, value, z) of its series with the highest product sum.

    Templates are packed into arrays of at most `block`; a row meets each array once and keeps one
    candidate per array, so pairs exist only inside an expression.  Arrays of one series are separate
    join keys, which spreads a long series over many tasks.  Ties go to the lowest i."""
    t = templates.withColumn("__b", F.floor(F.col("i") / (3 * block)).cast("long"))
    packed = t.groupBy(key, "__b").agg(F.collect_list(F.struct("i", F.col(value).alias("v"), "z")).alias("tpl"))
    span = packed.groupBy(key).agg(F.max("__b").alias("__last"))
    r = rows.select(key, "seq", "z").join(span, key).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))))
    j = r.join(packed, [key, "__b"])
    dot = lambda p: F.aggregate(F.zip_with(F.col("z"), p["z"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    best = F.array_min(F.transform("tpl", lambda p: F.struct((-F.round(dot(p) / width, 9)).alias("neg"), p["i"].alias("i"), p["v"].alias("v"))))
    g = j.select(key, "seq", best.alias("b")).groupBy(key, "seq").agg(F.min("b").alias("b"))
    return g.select(key, "seq", F.col("b")["v"].alias("best"), (-F.col("b")["neg"]).alias("score"))
