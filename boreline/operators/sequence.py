"""Estimation over a discretised state along each series, for series of any length.

A series is cut into blocks of knots.  A block acts on the state as a linear map
(sum-product for smoothing, min-plus for cheapest paths), so series that span
several blocks are handled as a scan: the maps of all blocks are built in parallel,
combined in groups of `fan` level by level, and every block then gets the state
that enters it from the left and from the right.  Series of one block skip the scan.
Spark deals the blocks out in packs of about PACK_ROWS rows; inside a pack numpy takes
one step of all blocks at a time, so short series cost no Python call per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the blocks that one Python call works on together.
PACK_ROWS = 8192


def _blur(x: np.ndarray, sigma: float | np.ndarray, axis: int = 0) -> np.ndarray:
    """Gaussian smoothing along an axis, end values repeated, cut at 4 sigma; an array of sigmas has one per column of x."""
    if np.ndim(sigma):
        return _blur_each(x, sigma)
    r = int(4.0 * sigma + 0.5)
    if r == 0:
        return x
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    n = x.shape[axis]
    at = np.clip(np.arange(n)[:, None] + np.arange(-r, r + 1)[None, :], 0, n - 1)
    moved = np.moveaxis(x, axis, 0)
    return np.moveaxis(np.einsum("k,nk...->n...", k, moved[at]), 0, axis)


def _blur_each(x: np.ndarray, sigma: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
    """_blur along axis 0 with one sigma per column: a matrix of kernel values per column, whose first and last column take
    the tails that the repeated end values get."""
    n = len(x)
    r = (4.0 * sigma + 0.5).astype(int)
    out = np.empty_like(x)
    order = np.argsort(r, kind="stable")
    gap = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    at = 0
    while at < len(order):
        # columns of alike radius together, as many as fit
        size = max(1, cells // (max(int(r[order[min(at + 255, len(order) - 1)]]) + 1, n * n)))
        cols = order[at:at + min(size, 256)]
        at += len(cols)
        d = np.arange(max(int(r[cols].max()), n - 1) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            k = np.where(d[None, :] <= r[cols, None], np.exp(-0.5 * (d[None, :] / sigma[cols, None]) ** 2), 0.0)
        k[:, 0] = 1.0
        k /= (2.0 * k.sum(1) - k[:, 0])[:, None]
        tail = np.cumsum(k[:, ::-1], axis=1)[:, ::-1][:, :n]
        m = k[:, gap]
        if n > 1:
            m[:, :, 0], m[:, :, -1] = tail, tail[:, ::-1]
        else:
            m[:] = 1.0
        out[:, cols] = np.matmul(m, x[:, cols].T[:, :, None])[:, :, 0].T
    return out


def _by_state(obs: np.ndarray) -> np.ndarray:
    """Observations of one step: a vector for all columns of the state, or one column for each."""
    return obs if obs.ndim == 2 else obs[:, None]


class Diffusion:
    """State r on `grid`; it spreads by a Gaussian per step.  obs = emission per state, aux = width in cells."""

    plus = True

    def __init__(self, grid):
        self.grid = np.asarray(grid, float)
        self.size = len(self.grid)

    def forward(self, x, obs, aux, first):
        return (x if first else _blur(x, aux)) * _by_state(obs)

    def backward(self, x, obs, aux):
        return _blur(x * _by_state(obs), aux)

    def estimate(self, alpha, beta):
        return float(self.estimates(alpha[:, None], beta[:, None])[0])

    def estimates(self, alpha, beta):
        """One estimate per column."""
        post = alpha * beta
        return self.grid @ post / np.maximum(post.sum(0), 1e-300)


class Drift(Diffusion):
    """State (v, r): r moves by v cells per step, v spreads by `sigma_v`.  obs = emission per r."""

    def __init__(self, grid, vmax, sigma_v):
        super().__init__(grid)
        self.ng, self.nv, self.sv = self.size, 2 * vmax + 1, sigma_v
        self.size = self.ng * self.nv
        self.at = np.stack([np.clip(np.arange(self.ng) - v, 0, self.ng - 1) for v in range(-vmax, vmax + 1)])

    def _move(self, m):
        return _blur(np.stack([m[i][self.at[i]] for i in range(self.nv)]), self.sv, axis=0)

    def _cube(self, x):
        return x.reshape(self.nv, self.ng, -1)

    def forward(self, x, obs, aux, first):
        m = self._cube(x)
        m = m if first else self._move(m)
        return (m * _by_state(obs)[None]).reshape(x.shape)

    def backward(self, x, obs, aux):
        return self._move(self._cube(x) * _by_state(obs)[None]).reshape(x.shape)

    def estimates(self, alpha, beta):
        post = self._cube(alpha * beta).sum(0)
        return self.grid @ post / np.maximum(post.sum(0), 1e-300)


class CheapestPath:
    """Index on a curve moves at most `reach` per step; cost obs[i] + move * |d|.  Ties go to the lower index."""

    plus = False

    def __init__(self, values, move, reach=2):
        self.values = np.asarray(values, float)
        self.size, self.move, self.reach = len(self.values), move, reach

    def _step(self, x):
        out = np.full_like(x, np.inf)
        n = self.size
        for d in range(-self.reach, self.reach + 1):
            a, b = max(0, d), min(n, n + d)
            out[a:b] = np.minimum(out[a:b], x[a - d:b - d] + self.move * abs(d))
        return out

    def forward(self, x, obs, aux, first):
        return self._step(x) + _by_state(obs)

    def backward(self, x, obs, aux):
        return self._step(x + _by_state(obs))

    def estimates(self, alpha, beta):
        return self.values[np.argmin(np.round(alpha + beta, 9), axis=0)]


class CheapestPaths:
    """Cheapest paths under several settings in one pass: setting s costs (value - curve)**2 / scale[s] + move[s] * |d| for a step
    of at most `reach[s]` knots of the curve.  The state is (setting, knot); settings never mix, so the map of a block holds one
    matrix a setting.  A row brings the values (column `values`, one per setting), the first row of a block the curve
    (column `curve`); the costs are made inside the block.  est: the knot's number under every setting, ties to the lower."""

    plus, est = False, "array<double>"

    def __init__(self, knots: int, move: list[float], scale: list[float], reach: list[int]):
        self.knots, self.settings = knots, len(move)
        self.size = knots * self.settings
        self.move, self.scale = np.asarray(move, float), np.asarray(scale, float)
        self.reach = np.asarray(reach)

    def observe(self, pdf, part=None):
        """Costs per row; part: the number of each row's block, in ascending order (one block if left out)."""
        part = np.zeros(len(pdf), int) if part is None else part
        held = pdf["curve"].notna().to_numpy()
        _, own = np.unique(part[held], return_index=True)
        curve = np.stack([np.asarray(c, float) for c in pdf["curve"].to_numpy()[held][own]])[part]
        value = np.stack([np.asarray(v, float) for v in pdf["values"]])
        return ((value[:, :, None] - curve[:, None, :]) ** 2 / self.scale[:, None]).reshape(len(value), -1)

    def _step(self, x):
        cube = x.reshape(self.settings, self.knots, -1)
        out = np.full_like(cube, np.inf)
        for d in range(-int(self.reach.max()), int(self.reach.max()) + 1):
            a, b = max(0, d), min(self.knots, self.knots + d)
            cost = np.where(self.reach >= abs(d), self.move * abs(d), np.inf)[:, None, None]
            if a < b:
                out[:, a:b] = np.minimum(out[:, a:b], cube[:, a - d:b - d] + cost)
        return out.reshape(x.shape)

    def forward(self, x, obs, aux, first):
        return self._step(x) + _by_state(obs)

    def backward(self, x, obs, aux):
        return self._step(x + _by_state(obs))

    def scaled(self, x, columns=False):
        if columns:
            cube = x.reshape(self.settings, self.knots, -1)
            low = cube.min(1, keepdims=True)
            return (cube - np.where(np.isfinite(low), low, 0.0)).reshape(x.shape)
        cube = x.reshape(self.settings, -1)
        low = cube.min(1, keepdims=True)
        return (cube - np.where(np.isfinite(low), low, 0.0)).reshape(x.shape)

    def eye(self):
        return np.tile(np.where(np.eye(self.knots) > 0, 0.0, np.inf), (self.settings, 1))

    def apply(self, m, v):
        return (m.reshape(self.settings, self.knots, self.knots) + v.reshape(self.settings, 1, self.knots)).min(2).ravel()

    def chain(self, a, b):
        a, b = (x.reshape(self.settings, self.knots, self.knots) for x in (a, b))
        return np.stack([np.min(q[:, :, None] + p[None, :, :], axis=1) for p, q in zip(a, b)]).reshape(self.size, self.knots)

    def estimates(self, alpha, beta):
        return list(np.argmin(np.round(alpha + beta, 9).reshape(self.settings, self.knots, -1), axis=1).astype(float).T)


def _eye(model):
    if hasattr(model, "eye"):
        return model.eye()
    if model.plus:
        return np.eye(model.size)
    return np.where(np.eye(model.size) > 0, 0.0, np.inf)


def _scaled(model, x):
    if hasattr(model, "scaled"):
        return model.scaled(x)
    if model.plus:
        top = x.max()
        return x / top if top > 0 else np.full_like(x, 1.0)
    low = x.min()
    return x - low if np.isfinite(low) else x


def _scaled_columns(model, x):
    """Every column scaled by itself, as _scaled does with a state of one column."""
    if hasattr(model, "scaled"):
        return model.scaled(x, True)
    if model.plus:
        top = x.max(0)
        return np.where(top > 0, x / np.where(top > 0, top, 1.0), 1.0)
    low = x.min(0)
    return x - np.where(np.isfinite(low), low, 0.0)


def _apply(model, m, v):
    if hasattr(model, "apply"):
        return model.apply(m, v)
    return m @ v if model.plus else (m + v[None, :]).min(1)


def _chain(model, a, b):
    """Map of `a` followed by `b`."""
    if hasattr(model, "chain"):
        return model.chain(a, b)
    return b @ a if model.plus else np.min(b[:, :, None] + a[None, :, :], axis=1)


def _neutral(model):
    return np.ones(model.size) if model.plus else np.zeros(model.size)


def _rows(pdf, name):
    return [np.asarray(v, float) for v in pdf[name]]


def _observed(model, pdf, part=None):
    return model.observe(pdf, part) if hasattr(model, "observe") else np.stack(_rows(pdf, "obs"))


def smooth(knots: DataFrame, key: str, model, block: int = 2048, fan: int = 64) -> DataFrame:
    """knots: key, j (0-based), seq, obs array<double>, aux double, init array<double> (state before j=0; needed where j is 0 only).
    A model that observes by itself names its own columns in place of obs.

    Returns key, seq, est: posterior mean or cheapest path at every knot."""
    spark, kt = knots.sparkSession, knots.schema[key].dataType.simpleString()
    k = knots.withColumn("blk", F.floor(F.col("j") / block).cast("long")).withColumn("init", F.when((F.col("j") == 0) | F.col(key).isNull(), F.col("init")))
    sizes = k.groupBy(key).agg(F.max("blk").alias("__last"), F.count(F.lit(1)).alias("__rows"))
    long = sizes.where(F.col("__last") > 0)
    top, rows = sizes.agg(F.max("__last"), F.sum("__rows")).first()
    if not top:
        entered = k.withColumn("fin", F.lit(None).cast("array<double>")).withColumn("bin", F.lit(None).cast("array<double>"))
    else:
        maps = k.join(long.select(key), key, "left_semi").groupBy(key, "blk").applyInPandas(
            lambda ids, pdf: _block_map(model, key, ids, pdf), f"{key} {kt}, blk long, f array<double>, g array<double>")
        start = k.where("j = 0").join(long.select(key), key, "left_semi").select(key, "init")
        ends = _scan(maps, start.withColumn("out", F.lit(None).cast("array<double>")), key, kt, model, int(top), fan)
        entered = k.join(ends.hint("merge"), [key, "blk"], "left")
    # Small inputs would be merged into one task, and the work per row is large.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    packs = max(parts, -(-(rows or 0) // PACK_ROWS))
    # Rows without a key keep to themselves: pandas would make other keys inexact beside them.
    pack = F.when(F.col(key).isNull(), -1 - F.col("blk")).otherwise(F.pmod(F.xxhash64(key, "blk"), F.lit(packs)))
    entered = entered.withColumn("__pack", pack).repartition(parts, "__pack")
    return entered.groupBy("__pack").applyInPandas(lambda pdf: _inside(model, key, pdf), f"{key} {kt}, seq long, est {getattr(model, 'est', 'double')}")


def _block_map(model, key, ids, pdf):
    pdf = pdf.sort_values("j")
    obs, aux, j = _observed(model, pdf), pdf["aux"].to_numpy(float), pdf["j"].to_numpy()
    f, g = _eye(model), _eye(model)
    for o, a, i in zip(obs, aux, j):
        f = _scaled(model, model.forward(f, o, a, i == 0))
    for o, a in zip(obs[::-1], aux[::-1]):
        g = _scaled(model, model.backward(g, o, a))
    return pd.DataFrame({key: [ids[0]], "blk": [ids[1]], "f": [f.ravel()], "g": [g.ravel()]})


def _scan(maps, start, key, kt, model, top, fan):
    """State entering each block from the left (fin) and from the right (bin)."""
    schema = f"{key} {kt}, blk long, fin array<double>, bin array<double>"
    n = model.size

    def fold(ids, pdf):
        pdf = pdf.sort_values("blk")
        f, g = [x.reshape(n, -1) for x in _rows(pdf, "f")], [x.reshape(n, -1) for x in _rows(pdf, "g")]
        v = np.asarray(pdf["init"].iloc[0], float)
        o = pdf["out"].iloc[0]
        u = _neutral(model) if o is None else np.asarray(o, float)
        fin, bin_ = [], [None] * len(f)
        for m in f:
            fin.append(v)
            v = _scaled(model, _apply(model, m, v))
        for i in reversed(range(len(g))):
            bin_[i] = u
            u = _scaled(model, _apply(model, g[i], u))
        return pd.DataFrame({key: ids[0], "blk": pdf["blk"].to_numpy(), "fin": fin, "bin": bin_})

    if top < fan:
        return maps.join(start, key).groupBy(key).applyInPandas(fold, schema)

    def product(ids, pdf):
        pdf = pdf.sort_values("blk")
        f, g = None, None
        for a, b in zip(_rows(pdf, "f"), _rows(pdf, "g")):
            a, b = a.reshape(n, -1), b.reshape(n, -1)
            f = a if f is None else _scaled(model, _chain(model, f, a))
            g = b if g is None else _scaled(model, _chain(model, b, g))
        return pd.DataFrame({key: [ids[0]], "blk": [ids[1]], "f": [f.ravel()], "g": [g.ravel()]})

    up = F.floor(F.col("blk") / fan).cast("long")
    merged = maps.withColumn("grp", up).groupBy(key, "grp").applyInPandas(product, f"{key} {kt}, blk long, f array<double>, g array<double>")
    outer = _scan(merged, start, key, kt, model, top // fan, fan)
    into = outer.select(key, F.col("blk").alias("grp"), F.col("fin").alias("init"), F.col("bin").alias("out"))
    return maps.withColumn("grp", up).join(into, [key, "grp"]).groupBy(key, "grp").applyInPandas(fold, schema)


def _inside(model, key, pdf):
    """Estimates of a pack of blocks, all blocks taking a step at a time: the longest come first, so the blocks that still
    have a row are the first columns."""
    part = pdf.groupby([key, "blk"], dropna=False, sort=False).ngroup().to_numpy()
    size = np.bincount(part)
    place = np.empty(len(size), int)
    place[np.argsort(-size, kind="stable")] = np.arange(len(size))
    pdf = pdf.iloc[np.lexsort((pdf["j"].to_numpy(), place[part]))].reset_index(drop=True)
    size = np.sort(size)[::-1]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    obs = _observed(model, pdf, np.repeat(np.arange(len(size)), size))
    aux, opens = pdf["aux"].to_numpy(float), pdf["j"].to_numpy()[first] == 0
    fin, out, init = pdf["fin"].to_numpy(), pdf["bin"].to_numpy(), pdf["init"].to_numpy()
    x = np.stack([np.asarray(init[i] if fin[i] is None else fin[i], float) for i in first], axis=1)
    alpha = np.empty((len(pdf), model.size))
    for t in range(size[0]):
        m = np.searchsorted(-size, -t)
        at = first[:m] + t
        o, a, x = obs[at].T, aux[at], x[:, :m]
        if t:
            x = model.forward(x, o, a, False)
        else:
            new = np.empty_like(x)
            for when in (True, False):
                c = np.flatnonzero(opens == when)
                if len(c):
                    new[:, c] = model.forward(x[:, c], o[:, c], a[c], when)
            x = new
        x = _scaled_columns(model, x)
        alpha[at] = x.T
    u = np.stack([_neutral(model) if out[i] is None else np.asarray(out[i], float) for i in first], axis=1)
    est = np.empty(len(pdf), object)
    for t in reversed(range(size[0])):
        m = np.searchsorted(-size, -t)
        at = first[:m] + t
        for i, e in zip(at, model.estimates(alpha[at].T, u[:, :m])):
            est[i] = e
        u[:, :m] = _scaled_columns(model, model.backward(u[:, :m], obs[at].T, aux[at]))
    ids = None if pdf[key].isna().all() else pdf[key]
    return pd.DataFrame({key: ids, "seq": pdf["seq"].to_numpy(), "est": est})
