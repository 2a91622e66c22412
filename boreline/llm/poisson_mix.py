"""Mixing sources to target weights by Poisson replication.

A source with target share w of the mix repeats its documents at a mean rate w * total / size of the source.  Each
document's count is the inverse of the Poisson distribution at a uniform number hashed from a seed and the document's
key; the document is exploded by its count and all copies are dealt out in the order of a second hash.  Rates above
MAX_RATE are sums of several independent draws of at most that mean, so the inversion never runs out of precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.llm.shared import written

MAX_RATE = 8.0
#: At a mean of MAX_RATE a count beyond this has a chance below 1e-20, less than the uniform numbers resolve.
MAX_COUNT = 60
#: Shares of the mix follow sizes raised to this power, where no weights are given.
TEMPERATURE = 0.7


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The smallest k whose cumulative chance exceeds u, for rates up to MAX_RATE."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("upto"), F.lit(0).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(k.alias("k"), p.alias("p"), (a["upto"] + p).alias("upto"), (a["n"] + F.when(a["upto"] <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COUNT)), start, step)["n"]


def _counts(seed: int, key: Column, rate: Column) -> Column:
    draws = F.greatest(F.ceil(rate / MAX_RATE), F.lit(1)).cast("int")
    one = rate / draws
    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0),
                       lambda n, i: n + poisson(one, uniform(F.lit(seed), F.lit("count"), i, key)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, repeats: float = 1.0, source: str = "source", size: Column | None = None) -> DataFrame:
    """__source, rate: mean copies of each document.  The mix has `repeats` times the size of docs (size: characters, null
    as none); weights are target shares of sources, by default sizes to the power TEMPERATURE.  A source without a
    weight, or of no size, has rate 0."""
    size = size if size is not None else F.length("text")
    s = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.coalesce(size, F.lit(0))).cast("double").alias("size"))
    if weights is None:
        s = s.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "w_source string, weight double")
        s = s.join(given, F.col("__source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    total = s.withColumn("one", F.lit(1)).groupBy("one").agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))
    s = s.withColumn("one", F.lit(1)).join(total, "one")
    rate = F.col("weight") / F.col("weights") * F.col("all") * repeats / F.col("size")
    return s.select("__source", F.coalesce(F.when(F.col("size") > 0, rate), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, repeats: float = 1.0, seed: int = 0, key: str = "doc_id",
        source: str = "source", size: Column | None = None) -> DataFrame:
    """docs with each row repeated by its Poisson count, and with rate, copy (from 0) and place, a hash of key and copy in
    whose order the rows are dealt out over all partitions.

    Null source: a source of its own.  Null key: hashed as "null".  Null or empty texts have no size but are drawn at their
    source's rate.  Repeated rows have equal keys and so equal counts.  An empty table gives an empty mix.  Columns of
    docs named rate, copy or place are replaced."""
    docs = docs.drop("rate", "copy", "place")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    # once written, the table's size is known: a small one is broadcast, and the texts stay where they are
    drawn = docs.join(written(rates(docs, weights, repeats, source, size), "rates"), F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    n = _counts(seed, name, F.col("rate"))
    copies = drawn.withColumn("__n", n.cast("int")).filter(F.col("__n") > 0) \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    # the place is spread evenly whatever the keys are, so ranges of it are equal parts of the mix in random order
    placed = copies.withColumn("place", uniform(F.lit(seed), F.lit("place"), F.col("copy"), name))
    return placed.repartitionByRange("place").sortWithinPartitions("place")
