"""Hard negatives by inner product: a multiway hyperplane tree (`gnat`) over all vectors, searched exactly.

The tree's split points come from SAMPLE rows; every row goes to a leaf, and the ranges of distances are those of all rows.
Anchors are searched in packs of neighbours: a pack goes to the leaves that its annuli reach, where all products of the
pack and a block of the leaf are one matrix product.  A leaf has blocks of BLOCK rows and an anchor's rows leave a block
cut to the best few of each window, so nothing grows with a leaf, a label or a group of equal vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreline.llm import gnat
from boreline.llm.shared import written

#: Rows that the split points are taken from: those of the smallest hashes of the id.
SAMPLE = 1 << 14
#: Levels are added until a leaf has about so many rows, up to LEVELS.
LEAF_ROWS = 1 << 12
LEVELS = 3
BLOCK = 1 << 11
PACK = 1 << 8
#: Scores are exact below this squared norm.
EXACT = 1 << 53


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of an array of lists of longs, one a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of every row: the highest scores, ties by id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    start = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0))
    return order[rank < k]


def _points(rows: DataFrame, id_: str, label: str, vector: str) -> DataFrame:
    """id, label, v of the rows that take part; one row an id."""
    kind = rows.schema[label].dataType.typeName()
    as_long = F.col(label).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(F.col(label))
    ok = F.col(id_).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    some = rows.filter(ok).select(F.col(id_).cast("long").alias("id"), as_long.alias("label"), F.col(vector).cast("array<bigint>").alias("v"))
    points = written(some.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "points")
    dims = points.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "dim").limit(1).collect()
    return points.filter(F.size("v") == dims[0].dim) if dims else points


def _ranges(placed: DataFrame, tree: gnat.Tree, dim: int) -> None:
    """Fills in the distance ranges of all rows; a task sends one row for each pair of split point and child it has met."""
    bare = placed.sparkSession.sparkContext.broadcast(tree)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bare.value
        low, high = {}, {}

        def note(k: int, to: np.ndarray, d: np.ndarray) -> None:
            m = d.shape[1]
            if k not in low:
                low[k], high[k] = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            for j in np.unique(to):
                some = d[to == j]
                low[k][:, j] = np.minimum(low[k][:, j], some.min(0))
                high[k][:, j] = np.maximum(high[k][:, j], some.max(0))

        for batch in batches:
            if batch.num_rows:
                gnat.descend(t, _matrix(batch.column("v"), dim), note)
        for k in low:
            i, j = np.nonzero(low[k] <= high[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(low[k][i, j]), pa.array(high[k][i, j])], ["node", "i", "j", "low", "high"])

    found = placed.select("v").mapInArrow(measure, "node int, i int, j int, low double, high double")
    # one row a pair of siblings in the tree, whose size has a bound
    for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high


def _packs(counts: dict[int, int], leaves: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First pack and number of packs of every leaf's anchors; leaves with few share one."""
    base, many = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    at, held = 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if held and held + n > size:
            at, held = at + 1, 0
        base[leaf], many[leaf] = at, -(-n // size) or 1
        if n > size:
            at += int(many[leaf])
        else:
            held += n
    return base, many


def _search(anchors: DataFrame, blocks: DataFrame, tree: gnat.Tree, dim: int, keep: int, home: bool, same: bool) -> DataFrame:
    """id, k, other, score: per anchor and window the first `keep` rows of each block that meets it.  anchors: id, label, v, leaf, pack,
    low, high (arrays of windows).  same: other rows of its label, else rows of other labels.  home: only in the anchors' own leaves."""
    spark = anchors.sparkSession
    known = spark.sparkContext.broadcast(tree)
    single = tree.top < 1 << 24
    packs = written(anchors.groupBy("pack").agg(F.collect_list(F.struct("id", "label", "v", "leaf", "low", "high")).alias("a")), "packs")

    def fields(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        return rows.field("id").to_numpy(), rows.field("label").to_numpy(), _matrix(rows.field("v"), dim)

    def windows(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (rows.field(c).flatten().to_numpy().reshape(len(rows), -1) for c in ("low", "high"))
        return low, high

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("a")[i].values
                if home:
                    to = np.unique(rows.field("leaf").to_numpy())
                else:
                    low, high = windows(rows)
                    to = gnat.visit(t, fields(rows)[2], low.astype(np.float64), high.astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), batch.column("pack")[i].as_py())), pa.array(to)], ["pack", "leaf"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].values, batch.column("b")[i].values
                ida, la, va = fields(a)
                idb, lb, vb = fields(b)
                low, high = windows(a)
                score = (va.astype(np.float32) @ vb.astype(np.float32).T if single else va @ vb.T)
                may = (score >= low.min(1)[:, None]) & (score <= high.max(1)[:, None]) & ((la[:, None] == lb) == same) & (ida[:, None] != idb)
                row, col = np.nonzero(may)
                s = score[row, col].astype(np.int64)
                for k in range(low.shape[1]):
                    at = np.flatnonzero((s >= low[row, k]) & (s <= high[row, k]))
                    at = at[_best(row[at], s[at], idb[col[at]], keep)]
                    yield pa.RecordBatch.from_arrays([pa.array(ida[row[at]]), pa.array(np.full(len(at), k, np.int32)), pa.array(idb[col[at]]), pa.array(s[at])],
                                                     ["id", "k", "other", "score"])

    tiles = written(packs.mapInArrow(route, "pack long, leaf long"), "tiles")
    met = tiles.join(blocks, "leaf").join(packs, "pack").select("a", "b")
    rows = met.mapInArrow(meet, "id long, k int, other long, score long")
    place = F.row_number().over(Window.partitionBy("id", "k").orderBy(F.desc("score"), "other"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= keep)


def mine(rows: DataFrame, anchor: Callable[[Column], Column], id_: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5,
         low_percent: int = 80, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector: arrays of whole numbers; anchor: a condition on the id, as a function of its column.  Scores are inner products; higher come first, ties by id.
    For each anchor and each of its first `positives` other rows of its label (all, if fewer) the first `negatives` rows of other
    labels with low_percent * positive <= 100 * negative <= 100 * positive.  Rows with a null id, label, vector or component, or
    an empty vector, take no part; nor do those whose number of components is not the most common one (ties: the smaller).
    Rows that share an id count once, that with the smallest label and vector.  An anchor without rows to return has none.
    Labels that are not whole numbers are told apart by 64-bit hashes.  Vectors with a squared norm of 2**53 or more are refused,
    as their scores would not be exact.  An empty table gives no rows.  Other columns are ignored."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    points = _points(rows, id_, label, vector)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("dim")).first()
    if not facts.n:
        return spark.createDataFrame([], schema)
    if facts.top >= EXACT:
        raise ValueError("the components are too large for exact scores")
    dim, depth = facts.dim, min(LEVELS, int(np.ceil(np.log(max(facts.n / leaf_rows, 1)) / np.log(gnat.FANOUT))))
    some = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    tree = gnat.grow(_matrix(some, dim), float(facts.top), depth)
    _ranges(points, tree, dim)
    known = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = gnat.descend(known.value, _matrix(batch.column("v"), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "label", "v", "leaf"])

    placed = written(points.mapInArrow(assign, "id long, label long, v array<bigint>, leaf long"), "placed")
    # one row a leaf, of which the tree has a bounded number
    sizes = {r.leaf: (r.n, r.a) for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(anchor(F.col("id"))).alias("a")).collect()}
    parts = F.array(*[F.lit(-(-sizes.get(k, (1, 0))[0] // block)) for k in range(tree.leaves)])
    own = F.pmod(F.xxhash64("id"), F.get(parts, F.col("leaf").cast("int")))
    blocks = written(placed.withColumn("part", own).groupBy("leaf", "part").agg(F.collect_list(F.struct("id", "label", "v")).alias("b")).select("leaf", "b"), "blocks")
    base, many = _packs({k: a for k, (_, a) in sizes.items()}, tree.leaves, pack)
    leaf = F.col("leaf").cast("int")
    first, several = (F.get(F.array(*[F.lit(int(x)) for x in xs]), leaf) for xs in (base, many))
    anchors = written(placed.filter(anchor(F.col("id"))).withColumn("pack", first.cast("long") + F.pmod(F.xxhash64(F.lit(7), F.col("id")), several)), "anchors")

    wide = int(2 * facts.top) + 1
    window = lambda low, high: (F.array(low).cast("array<bigint>").alias("low"), F.array(high).cast("array<bigint>").alias("high"))
    near = _search(anchors.select("*", *window(F.lit(-wide), F.lit(wide))), blocks, tree, dim, positives, home=True, same=True)
    fifth = written(near.filter(F.col("rank") == positives).select("id", F.col("score").alias("floor")), "floors")
    bounded = anchors.join(fifth, "id", "left").select(*anchors.columns, *window(F.coalesce("floor", F.lit(-wide)), F.lit(wide)))
    good = written(_search(bounded, blocks, tree, dim, positives, home=False, same=True).select(
        "id", (F.col("rank") - 1).alias("k"), F.col("other").alias("positive"), F.col("score").alias("positive_score"),
        F.expr(f"({low_percent} * score + pmod(-{low_percent} * score, 100)) div 100").alias("least")), "positives")
    per = good.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "least", "positive_score"))).alias("p"))
    lows = F.array(*[F.coalesce(F.get("p", F.lit(i))["least"], F.lit(wide)) for i in range(positives)])
    highs = F.array(*[F.coalesce(F.get("p", F.lit(i))["positive_score"], F.lit(-wide)) for i in range(positives)])
    ringed = anchors.join(per, "id").select(*anchors.columns, lows.alias("low"), highs.alias("high"))
    bad = _search(ringed, blocks, tree, dim, negatives, home=False, same=False)
    return bad.join(good, ["id", "k"]).select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                              F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

