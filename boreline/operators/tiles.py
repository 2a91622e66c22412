"""Tiles of points for the neighbour search, and the search of the queries of one tile by arrays.

A tile is a cell of a quadtree that holds at most some number of points while its parent holds more.  Only the tiles'
numbers, boxes and counts are known everywhere (a row per tile); points and queries are dealt to tiles by Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

#: Levels of the quadtree, queries compared at a time, queries of a tile in one call, bits of a key that number such calls, entries of a
#: table of queries by tiles, and room for the rounding of squares.
BITS, BLOCK, BATCH, ROOM, MANY, SLACK = 31, 128, 65536, 24, 1 << 21, 1 + 1e-12


def numbered(*columns: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Equal values of all columns get equal numbers, null is -1."""
    parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    parts = [c.cast(parts[0].type) for c in parts]
    codes = pa.concat_arrays(parts).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(p) for p in parts])[:-1])


def values_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def place_codes(frame: tuple[float, float, float], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers of the finest cells along the quadtree; places outside count as the nearest ones inside."""
    def spread(c, origin):
        x = np.clip((c - origin) / frame[2] * 2.0**BITS, 0, 2.0**BITS - 1).astype(np.int64)
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << by)) & mask
        return x

    return spread(u, frame[0]) | (spread(v, frame[1]) << 1)


@dataclass
class Tiles:
    """Tiles in the order of their first cells: box (u from, u to, v from, v to) and number of their points, and of a tile whose
    points are all of one group, that group."""

    frame: tuple[float, float, float]
    start: np.ndarray
    box: np.ndarray
    n: np.ndarray
    pure: np.ndarray
    group: pa.Array

    def at(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The tile of each point; for places without points, some tile."""
        return np.maximum(np.searchsorted(self.start, place_codes(self.frame, u, v), side="right") - 1, 0)

    def gap(self, u: np.ndarray, v: np.ndarray, tiles: np.ndarray) -> np.ndarray:
        """Least distance of each place to the box of each tile."""
        b = self.box[tiles]
        du = np.maximum(np.maximum(b[:, 0] - u[:, None], u[:, None] - b[:, 1]), 0.0)
        return np.hypot(du, np.maximum(np.maximum(b[:, 2] - v[:, None], v[:, None] - b[:, 3]), 0.0))

    def far(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Largest distance of any of the places to any point of each tile, from the places' box."""
        b = self.box
        du = np.maximum(np.abs(b[:, 0] - u.max()), np.abs(b[:, 1] - u.min()))
        return np.hypot(np.maximum(du, np.maximum(np.abs(b[:, 0] - u.min()), np.abs(b[:, 1] - u.max()))), np.maximum(
            np.maximum(np.abs(b[:, 2] - v.max()), np.abs(b[:, 3] - v.min())), np.maximum(np.abs(b[:, 2] - v.min()), np.abs(b[:, 3] - v.max()))))

    def near(self, u: np.ndarray, v: np.ndarray, reach: float) -> np.ndarray:
        """Tiles that may be within reach of some of the places."""
        b = self.box
        du = np.maximum(np.maximum(b[:, 0] - u.max(), u.min() - b[:, 1]), 0.0)
        return np.flatnonzero(np.hypot(du, np.maximum(np.maximum(b[:, 2] - v.max(), v.min() - b[:, 3]), 0.0)) <= reach * SLACK)


def cells_of(points: DataFrame, frame: tuple[float, float, float], depth: int, within: tuple[int, np.ndarray] | None = None) -> pa.Table:
    """Cells of a depth (inside the given cells of another) with the count, box and smallest and largest group of their points."""
    kind = points.schema["grp"].dataType.simpleString()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = place_codes(frame, values_of(b["u"]), values_of(b["v"]))
            t = pa.table({"cell": z >> 2 * (BITS - depth), "u": b["u"], "v": b["v"], "grp": b["grp"]})
            if within is not None:
                t = t.filter(pa.array(np.isin(z >> 2 * (BITS - within[0]), within[1])))
            yield from t.to_batches()

    found = points.select("u", "v", "grp").mapInArrow(place, f"cell long, u double, v double, grp {kind}").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"),
        F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.count("grp").alias("gn"))
    return found.toArrow().sort_by("cell")


def crowded_cells(cells: pa.Table, size: int) -> np.ndarray:
    return values_of(cells["cell"])[values_of(cells["n"]) > size]


def flagged(points: DataFrame, frame: tuple[float, float, float], depth: int, cells: np.ndarray) -> DataFrame:
    """Points with a column that says whether they lie in one of the cells."""
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = place_codes(frame, values_of(b["u"]), values_of(b["v"])) >> 2 * (BITS - depth)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.isin(z, cells))], [*b.schema.names, "inside"])

    return points.mapInArrow(place, StructType([*points.schema, StructField("inside", BooleanType())]))


def first_depth(n: int, size: int) -> int:
    """Cells of this depth hold an eighth of a tile, were the points spread evenly."""
    return int(min(BITS, max(1, np.ceil(np.log2(max(1.0, 8.0 * n / size)) / 2))))


def tiles_of(points: DataFrame, frame: tuple[float, float, float], depth: int, cells: pa.Table, size: int, recount: bool) -> Tiles:
    """Tiles of at most `size` points (points of one finest cell stay together), from the cells of a depth.

    Cells that hold more are counted again four levels deeper, in as many rounds as the densest needs; `recount`: their points
    have changed since they were counted."""
    found, top = [], 0
    while True:
        cell, n = values_of(cells["cell"]), values_of(cells["n"])
        box = np.stack([values_of(cells[c]) for c in ("u0", "u1", "v0", "v1")], axis=1).reshape(-1, 4)
        lo, hi = numbered(cells["g0"], cells["g1"])
        lo = np.where(values_of(cells["gn"]) < n, -1, lo)  # some group is null: as if it were the smallest
        left = np.ones(len(cell), bool)
        for level in range(top, depth + 1):
            i = np.flatnonzero(left)
            if not len(i):
                break
            code = cell[i] >> 2 * (depth - level)
            first = np.flatnonzero(np.r_[True, np.diff(code) != 0])
            total = np.add.reduceat(n[i], first)
            done = (total <= size) | (level == BITS)
            if recount and level == depth:
                done &= total <= size
            least, most = np.minimum.reduceat(box[i], first, axis=0), np.maximum.reduceat(box[i], first, axis=0)
            g0, g1 = (f.reduceat(f(lo[i], hi[i]), first) for f in (np.minimum, np.maximum))
            kept = cells["g1"].combine_chunks().take(pa.array(i[first][done]))
            found.append((code[first][done] << 2 * (BITS - level), np.stack([least[done, 0], most[done, 1], least[done, 2], most[done, 3]], axis=1),
                          total[done], (g0 == g1)[done], kept))
            left[i[np.repeat(done, np.diff(np.r_[first, len(i)]))]] = False
        if not left.any():
            break
        crowded, top = cell[left], depth
        within, depth = (depth, crowded), min(depth + 4, BITS)
        cells, recount = cells_of(points, frame, depth, within), False
    start, box, n, pure = (np.concatenate(x) for x in list(zip(*found))[:4])
    order = np.argsort(start)
    group = pa.concat_arrays([f[4] for f in found]).take(pa.array(order))
    return Tiles(frame, start[order], box[order], n[order], pure[order], group)


def _rank(new: np.ndarray) -> np.ndarray:
    """Numbers from 0 inside runs that begin where `new` is true."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _thinned(u: np.ndarray, v: np.ndarray, g: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of points at one place those that can be among k neighbours of any group (see knn.thin_coincident)."""
    i = np.lexsort((order, g, v, u))
    change = lambda c: np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
    i = i[_rank(change(u[i]) | change(v[i]) | change(g[i])) < k]
    i = i[np.lexsort((order[i], v[i], u[i]))]
    return i[_rank(change(u[i]) | change(v[i])) < 2 * k]


def nearest(u: np.ndarray, v: np.ndarray, g: np.ndarray, order: np.ndarray, qu: np.ndarray, qv: np.ndarray, qg: np.ndarray | None,
            reach: np.ndarray, k: int, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries, points, distances and ranks from 0 of the k nearest points of other groups (of all: qg None), ties by `order`.

    `reach` bounds the k-th distance of each query or is infinite; `unit` is a power of two about the size of the square,
    which keeps squares from overflowing.  Queries are met in small blocks that lie close together; a block is first compared
    with the points nearest to its box, then with all within the largest k-th distance, if these are more."""
    keep = _thinned(u, v, g, order, k)
    u, v, g, order = u[keep], v[keep], g[keep], order[keep]
    su, sv, out = u / unit, v / unit, []
    m, some = len(qu), BLOCK + 32 * k
    strips = max(1, int(np.sqrt(m / BLOCK)))
    strip = np.empty(m, np.int64)
    strip[np.argsort(qu, kind="stable")] = np.arange(m) * strips // max(m, 1)
    line = np.lexsort((qv, strip))

    def squares(c, a):
        d = su[c] - qu[a, None] / unit
        d *= d
        e = sv[c] - qv[a, None] / unit
        d += np.multiply(e, e, out=e)
        if qg is not None:
            d[g[c] == qg[a, None]] = np.inf
        return d, np.partition(d, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(a), np.inf)

    for at in range(0, m, BLOCK):
        a = line[at:at + BLOCK]
        x, y = qu[a], qv[a]
        gap = np.maximum(np.maximum(x.min() - u, u - x.max()), np.maximum(y.min() - v, v - y.max())) / unit
        limit = (reach[a] / unit) ** 2
        wide = np.sqrt(limit.max())
        if np.isfinite(wide):
            c = np.flatnonzero(gap <= wide * SLACK)
            d, kth = squares(c, a)
        else:
            c = np.argpartition(gap, some - 1)[:some] if len(u) > some else np.arange(len(u))
            d, kth = squares(c, a)
            if len(c) < len(u):
                within = np.flatnonzero(gap <= np.sqrt(np.minimum(kth, limit).max()) * SLACK)
                if len(within) > len(c):
                    c = within
                    d, kth = squares(c, a)
        i, j = np.nonzero((d <= (np.minimum(kth, limit) * SLACK + 1e-300)[:, None]) & (d < np.inf))
        p, i = c[j], a[i]
        dist = np.hypot(u[p] - qu[i], v[p] - qv[i])
        s = np.lexsort((order[p], dist, i))
        p, i, dist = p[s], i[s], dist[s]
        rank = _rank(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        s = rank < k
        out.append((i[s], keep[p[s]], dist[s], rank[s]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))


def search(tiles: Tiles, k: int, own: bool, schema: pa.Schema, found: set[str], visits: set[str], first: bool, points: pa.Table, queries: pa.Table) -> pa.Table:
    """Neighbours of the queries of one tile among its points; `found` and `visits` name the columns of the two kinds of rows.

    Visitors (not `first`) have a reach (r), and all they find is returned.  At first a query is settled when no other tile
    with points of other groups is within its k-th distance; neighbours of the settled ones are returned if `found` is not
    empty, and if `visits` is not, a row for each tile that one not settled must visit (its own too), or one with tile -1 if its
    own tile has fewer than k such points.  `own`: points of the query's own group count as well."""
    parts = [pa.Table.from_arrays([pa.array([], f.type) for f in schema], schema=schema)]
    if not queries.num_rows or not points.num_rows:
        return parts[0]
    qu, qv = values_of(queries["u"]), values_of(queries["v"])
    tile = int(values_of(queries["key"])[0]) >> ROOM
    g, qg, pure = numbered(points["grp"], queries["qgrp"], tiles.group)
    ids = points["id"].combine_chunks()
    order = np.empty(len(ids), np.int64)
    order[values_of(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
    unit = 2.0 ** np.ceil(np.log2(tiles.frame[2]))
    reach = np.full(len(qu), np.inf) if first else values_of(queries["r"])
    i, p, dist, rank = nearest(values_of(points["u"]), values_of(points["v"]), g, order, qu, qv, None if own else qg, reach, k, unit)
    if first and len(tiles.n) > 1:
        r = np.full(len(qu), np.inf)
        r[i[rank == k - 1]] = dist[rank == k - 1]
        some, unknown = np.flatnonzero(np.isfinite(r)), np.flatnonzero(np.isinf(r))
        who, where = [unknown], [np.full(len(unknown), -1)]
        others = tiles.near(qu[some], qv[some], r[some].max()) if len(some) else np.zeros(0, np.int64)
        others = others[others != tile]
        step = max(1, MANY // max(1, len(others)))
        for at in range(0, len(some) if len(others) else 0, step):
            a = some[at:at + step]
            touch = tiles.gap(qu[a], qv[a], others) <= r[a, None] * SLACK
            if not own:
                touch &= ~(tiles.pure[others] & (pure[others] == qg[a, None]))
            b, t = np.nonzero(touch)
            go = np.unique(a[b])
            who, where = [*who, a[b], go], [*where, others[t], np.full(len(go), tile)]
        who, where = np.concatenate(who), np.concatenate(where)
        if visits:
            parts.append(_table(schema, visits, {"r": r[who], "tile": where}, queries, who, points, None))
        settled = np.ones(len(qu), bool)
        settled[who] = False
        i, p, dist, rank = (x[settled[i]] for x in (i, p, dist, rank))
    if found:
        parts.append(_table(schema, found, {"dist": dist, "rank": rank + 1}, queries, i, points, p))
    return pa.concat_tables(parts)


def _table(schema: pa.Schema, names: set[str], made: dict, queries: pa.Table, who: np.ndarray, points: pa.Table, p: np.ndarray | None) -> pa.Table:
    """The named columns, made here or taken from the queries or the points; the others are null."""
    cols = []
    for f in schema:
        if f.name not in names:
            c = pa.nulls(len(who), f.type)
        elif f.name in made:
            c = pa.array(made[f.name])
        else:
            c = queries[f.name].take(pa.array(who)) if f.name in queries.column_names else points[f.name].take(pa.array(p))
        cols.append(c.cast(f.type))
    return pa.Table.from_arrays(cols, schema=schema)


def _targets(tiles: Tiles, k: int, own: bool, top: pa.Array, top_n: np.ndarray, queries: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (places in the batch), reach and tile of every visit.

    A tile holds at least as many points of other groups as are outside its largest group, and for any other group at least as
    many as that group.  Tiles are counted from the nearest on until they surely hold k, which bounds the reach."""
    qu, qv = values_of(queries["u"]), values_of(queries["v"])
    tile = tiles.at(qu, qv)
    qg, top_g = numbered(queries["qgrp"], top)
    who, reach, where = [], [], []
    line = np.lexsort((qg, tile))
    cuts = np.flatnonzero((np.diff(tile[line]) != 0) | (np.diff(qg[line]) != 0)) + 1
    for a in np.split(line, cuts):
        least = tiles.n if own else np.where(top_g == qg[a[0]], tiles.n - top_n, np.maximum(tiles.n - top_n, top_n))
        far = tiles.far(qu[a], qv[a])
        near = np.argsort(far, kind="stable")
        enough = np.searchsorted(np.cumsum(least[near]), k)
        r = far[near[enough]] * SLACK if enough < len(near) else np.inf
        t = np.flatnonzero(least > 0)
        step = max(1, MANY // max(1, len(t)))
        for at in range(0, len(a), step):
            b = a[at:at + step]
            x, y = np.nonzero(tiles.gap(qu[b], qv[b], t) <= r * SLACK)
            who, reach, where = [*who, b[x]], [*reach, np.full(len(x), r)], [*where, t[y]]
    return np.concatenate(who), np.concatenate(reach), np.concatenate(where)


def targeted(queries: DataFrame, points: DataFrame, tiles: Tiles, k: int, own: bool) -> DataFrame:
    """Queries whose own tile has fewer than k points of other groups, a row for each tile (tile) they must visit with their reach (r)."""
    once = deal(points, tiles, np.ones(len(tiles.n), np.int64), "point").groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    tops = once.groupBy("key").agg(F.max(F.struct("n", "grp")).alias("m")).select("key", "m.n", "m.grp").toArrow().sort_by("key")
    top, top_n = tops["grp"].combine_chunks(), values_of(tops["n"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                who, reach, where = _targets(tiles, k, own, top, top_n, b)
                t = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(reach), pa.array(where)], [*t.schema.names, "r", "tile"])

    return queries.mapInArrow(place, StructType([*queries.schema, StructField("r", DoubleType()), StructField("tile", LongType())]))


def deal(rows: DataFrame, tiles: Tiles, calls: np.ndarray, kind: str) -> DataFrame:
    """Rows with the key of their call: the tile and, where its queries need several calls, the number of the call.

    `kind` says where a row goes: a "point" to all calls of its tile, a "query" to one of them by its column h, a "visit" likewise
    at its column tile."""
    names = [*rows.columns]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile = values_of(b["tile"]) if kind == "visit" else tiles.at(values_of(b["u"]), values_of(b["v"]))
            many = calls[tile]
            if kind == "point" and (many != 1).any():
                i = np.repeat(np.arange(len(tile)), many)
                b, tile, call = b.take(pa.array(i)), tile[i], _rank(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            else:
                call = 0 if kind == "point" else np.mod(values_of(b["h"]), many)
            yield pa.RecordBatch.from_arrays([pa.array((tile << ROOM) + call, pa.int64()), *[b[n] for n in names]], ["key", *names])

    return rows.mapInArrow(place, StructType([StructField("key", LongType()), *rows.schema]))


def calls_of(tiles: Tiles, rows: DataFrame, kind: str) -> np.ndarray:
    """Calls that each tile's queries or visitors need; none where there are none."""
    dealt = deal(rows, tiles, np.ones(len(tiles.n), np.int64), kind)
    found = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).toArrow()
    calls = np.zeros(len(tiles.n), np.int64)
    calls[values_of(found["key"]) >> ROOM] = -(-values_of(found["n"]) // BATCH)
    return calls
