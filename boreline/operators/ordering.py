"""Order-dependent primitives that never put one long series into one task.

A series is cut into cells (by order value, before row numbers exist) or into
blocks of equal row count (once they do).  Windows run inside a cell or block;
what has to cross a boundary travels as one small row per cell or block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import materialize

CELL_ROWS = 500_000
BLOCK_ROWS = 250_000


#: Steps of the counted quantiles; a group of more than CUTS cells has larger cells.
CUTS = 1000


def _quantiles(value: Column) -> Column:
    """Aggregate: values at steps of 1/CUTS, from a summary of bounded size that is merged map-side."""
    return F.percentile_approx(value.cast("double"), [i / CUTS for i in range(1, CUTS)], 10 * CUTS)


def _picked(quantiles: Column, cells: Column) -> Column:
    """The distinct cuts between `cells` cells of alike numbers of rows."""
    at = F.transform(F.sequence(F.lit(1), F.least(cells, F.lit(CUTS)) - 1), lambda i: F.get(quantiles, F.floor(i * CUTS / F.least(cells, F.lit(CUTS))).cast("int") - 1))
    return F.array_distinct(F.when(cells > 1, at))


def cell_of(value: Column, cuts: Column) -> Column:
    """Cells in the order of values, nulls first: every cut is a cell of its own, and so is every gap between two; 0 without cuts.
    The cuts below a value are counted by halving steps."""
    v = value.cast("double")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CUTS.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < v, at + step).otherwise(at))
    return F.when(cuts.isNull(), 0).otherwise(2 * below + F.coalesce(F.get(cuts, below) == v, F.lit(False)).cast("int")).cast("long")


def value_cuts(df: DataFrame, keys: list[str], value: str, sizes: DataFrame, size: str, cell_rows: int) -> DataFrame:
    """keys, __cuts of the groups with more than cell_rows rows; sizes: one row per group.  Nothing is read for the others."""
    big = sizes.where(F.col(size) > cell_rows).select(*keys, F.ceil(F.col(size) / cell_rows).cast("int").alias("__cells"))
    q = df.join(big, keys).groupBy(*keys).agg(_quantiles(F.col(value)).alias("__q"), F.max("__cells").alias("__cells"))
    return q.select(*keys, _picked(F.col("__q"), F.col("__cells")).alias("__cuts"))


def same_keys(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Join condition on keys where null equals null."""
    e = F.lit(True)
    for k in keys:
        e = e & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return e


def largest(counts: DataFrame, column: str) -> int:
    """The greatest count of a table of counts; what comes to the driver is one number."""
    return counts.agg(F.max(column)).first()[0] or 0


def number_rows(df: DataFrame, keys: list[str], order: str, tie: str,
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add `seq` (0-based rank by order, tie), `n` (rows of the series) and `order0` (first order value); columns of these
    names are replaced, and may be the order or the tie.

    The rows of every series are counted first, which reads the keys alone.  Series of up to cell_rows rows are numbered by
    one window, so the input is read once; only larger ones are told apart and cut into cells."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("order0"))
    if largest(stats, "n") <= cell_rows:
        return _number_small(df, keys, order, tie)
    big = materialize(stats.where(F.col("n") > cell_rows), "big")
    small = df.alias("l").join(big.alias("r"), same_keys(keys), "left_anti")
    return _number_small(small, keys, order, tie).unionByName(_number_large(df, keys, order, tie, big, cell_rows))


def _number_small(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumns({"n": F.count(F.lit(1)).over(w), "order0": F.min(order).over(w),
                           "seq": F.row_number().over(w.orderBy(order, tie)).cast("long") - 1})


def _number_large(df: DataFrame, keys: list[str], order: str, tie: str, big: DataFrame, cell_rows: int) -> DataFrame:
    """Series of `big` are cut at counted quantiles of the order, so outliers and heavy tails do not fill a cell; order
    values that more than cell_rows rows share are cut again by the tie, where that is a number."""
    names = df.columns
    big = big.withColumnsRenamed({"n": "__n", "order0": "__order0"})
    rows = df.alias("l").join(big.alias("r"), same_keys(keys)).select("l.*", "r.__n", "r.__order0")
    q = rows.groupBy(*keys).agg(_quantiles(F.col(order)).alias("__q"), F.ceil(F.max("__n") / cell_rows).cast("int").alias("__cells"))
    cuts = q.select(*keys, _picked(F.col("__q"), F.col("__cells")).alias("__cuts"))
    placed = rows.alias("l").join(cuts.alias("r"), same_keys(keys)).select("l.*", cell_of(F.col(f"l.{order}"), F.col("__cuts")).alias("__cell"))
    placed = materialize(placed, "placed")
    place = [*keys, "__cell"]
    numeric = dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    sub = F.lit(0).cast("long")
    if numeric:
        own = placed.where(F.col("__cell") % 2 == 1)
        shared = own.groupBy(*place).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > cell_rows)
        again = own.alias("l").join(shared.alias("r"), same_keys(place)).select("l.*", "r.__m").groupBy(*place) \
            .agg(_quantiles(F.col(tie)).alias("__q"), F.max("__m").alias("__m"))
        again = materialize(again.select(*place, _picked(F.col("__q"), F.ceil(F.col("__m") / cell_rows).cast("int")).alias("__cuts")), "tie-cuts")
        placed = placed.alias("l").join(again.alias("r"), same_keys(place), "left").select("l.*", "r.__cuts")
        sub = cell_of(F.col(tie), F.col("__cuts"))
    placed = placed.withColumn("__sub", sub).select(*names, "__n", "__order0", "__cell", "__sub")
    cell = [*place, "__sub"]
    before = W.partitionBy(*keys).orderBy("__cell", "__sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__c")) \
        .select(*cell, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    ranked = placed.withColumn("__r", F.row_number().over(W.partitionBy(*cell).orderBy(order, tie)))
    return ranked.alias("l").join(offsets.alias("r"), same_keys(cell)) \
        .select(*[f"l.{c}" for c in names if c not in ("n", "order0", "seq")], F.col("l.__n").alias("n"), F.col("l.__order0").alias("order0"),
                (F.col("l.__r") - 1 + F.col("r.__off")).alias("seq"))


def _blk(seq: str, block: int) -> Column:
    return F.floor(F.col(seq) / block).cast("long")


def running_sum(df: DataFrame, keys: list[str], sums: dict[str, Column], seq: str = "seq",
                block: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive cumulative sums: inside blocks, plus the total of all earlier blocks."""
    tmp = df
    for name, e in sums.items():
        tmp = tmp.withColumn(f"__in_{name}", e)
    tmp = tmp.withColumn("__b", _blk(seq, block))
    tot = tmp.groupBy(*keys, "__b").agg(*[F.sum(f"__in_{s}").alias(f"__t_{s}") for s in sums])
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.select(*keys, "__b", *[
        F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = W.partitionBy(*keys, "__b").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    for s in sums:
        tmp = tmp.withColumn(f"__c_{s}", F.coalesce(F.sum(f"__in_{s}").over(inside), F.lit(0)))
    tmp = tmp.join(tot, [*keys, "__b"])
    return tmp.select(*df.columns, *[(F.col(f"__c_{s}") + F.col(f"__o_{s}")).alias(s) for s in sums])


def framed(df: DataFrame, keys: list[str], radius: int, make: Callable[[W], dict[str, Column]],
           seq: str = "seq", block: int = BLOCK_ROWS) -> DataFrame:
    """Window columns that look at most `radius` rows away.

    Rows close to a block edge are copied into the neighbouring block, so every
    frame is whole inside its block; copies are dropped afterwards."""
    block = max(block, radius)
    pos = F.col(seq) % block
    home = _blk(seq, block)
    targets = F.array_compact(F.array(
        home,
        F.when((pos < radius) & (home > 0), home - 1),
        F.when(pos >= block - radius, home + 1)))
    tmp = df.withColumn("__b", F.explode(targets))
    w = W.partitionBy(*keys, "__b").orderBy(seq)
    for name, e in make(w).items():
        tmp = tmp.withColumn(name, e)
    return tmp.where(F.col("__b") == _blk(seq, block)).drop("__b")


def neighbours_known(df: DataFrame, keys: list[str], value: str, seq: str = "seq",
                     block: int = BLOCK_ROWS, at: Column | None = None) -> DataFrame:
    """Add structs `prev` and `next` = (position, value) of the nearest non-null value at or
    before / at or after each row.  `at` is the position stored (default: seq)."""
    at = F.col(seq) if at is None else at
    known = F.when(F.col(value).isNotNull(),
                   F.struct(F.col(seq).alias("i"), at.alias("k"), F.col(value).alias("v")))
    tmp = df.withColumn("__k", known).withColumn("__b", _blk(seq, block))
    edge = tmp.groupBy(*keys, "__b").agg(F.max("__k").alias("__last"), F.min("__k").alias("__first"))
    wb = W.partitionBy(*keys).orderBy("__b")
    edge = edge.select(
        *keys, "__b",
        F.max("__last").over(wb.rowsBetween(W.unboundedPreceding, -1)).alias("__pb"),
        F.min("__first").over(wb.rowsBetween(1, W.unboundedFollowing)).alias("__nb"))
    wi = W.partitionBy(*keys, "__b").orderBy(seq)
    tmp = (tmp.withColumn("__p", F.last("__k", True).over(wi.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("__n", F.first("__k", True).over(wi.rowsBetween(0, W.unboundedFollowing)))
           .join(edge, [*keys, "__b"]))
    return tmp.select(*df.columns, F.coalesce("__p", "__pb").alias("prev"),
                      F.coalesce("__n", "__nb").alias("next"))


def fill_linear(df: DataFrame, keys: list[str], value: str, out: str, seq: str = "seq",
                default: Column | None = None, block: int = BLOCK_ROWS,
                at: Column | None = None) -> DataFrame:
    """Gaps filled linearly between known neighbours, both ends held; `default` if nothing is known."""
    t = neighbours_known(df, keys, value, seq, block, at)
    here = F.col(seq) if at is None else at
    p, n = F.col("prev"), F.col("next")
    span = n["k"] - p["k"]
    lerp = F.when(span > 0, p["v"] + (n["v"] - p["v"]) * (here - p["k"]) / span).otherwise(p["v"])
    val = (F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(lerp))
    if default is not None:
        val = F.coalesce(val, default)
    return t.withColumn(out, val).drop("prev", "next")
