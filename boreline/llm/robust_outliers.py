"""Quality rules with a robust multivariate outlier test, all in DataFrame expressions.

Texts of one language and source are compared by a vector of transformed statistics.  Location and scatter are
minimum-covariance-determinant estimates: from medians and central ranges, concentration steps keep the three quarters
of the rows that are nearest by Mahalanobis distance and estimate anew from these.  Rows beyond CUTOFF are rejected.

Quantiles come from counts of fine bins, so no group is gathered, and what a step passes on is one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreline.llm.shared import written
from boreline.llm.text_stats import STATS, with_stats

#: Transformed statistic -> smallest standard deviation that counts as spread.
FEATURES = {"word_length": 0.03, "symbols": 0.05, "dup_lines": 0.05, "repeats": 0.1, "size": 0.3}
#: Squared distances beyond this are outliers.  Text statistics have heavier tails than the normal
#: distribution, whose 1 - 1e-9 quantile for five dimensions is 51.
CUTOFF = 80.0
KEEP = 0.75
#: Scatter of the nearest three quarters -> scatter of normal rows, for five dimensions.
CONSISTENCY = 1.6
STEPS = 3
#: Smaller groups are judged by their language's estimates, then by those of all texts.
MIN_ROWS = 50
BINS = 64
NAMES = list(FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "symbols": F.sqrt(F.col("n_symbols") / n),
            "dup_lines": F.sqrt(F.col("n_dup_lines") / n), "repeats": F.sqrt(F.col("n_repeat_words") / n), "size": F.log(n)}


def _key(level: int, *parts: Column) -> Column:
    """A group's name; a null value is a value of its own."""
    return F.concat_ws("\x1f", F.lit(str(level)), *[F.when(p.isNull(), "0").otherwise(F.concat(F.lit("1"), p.cast("string"))) for p in parts])


def _groups(rows: DataFrame) -> DataFrame:
    """g_lang, g_source, model: the finest of their three groups with MIN_ROWS rows, or null; wanted: all groups that
    their rows help to estimate and that some model needs."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n2")).withColumn("one", F.lit(1))
    langs = sizes.groupBy(F.col("lang").alias("l")).agg(F.sum("n2").alias("n1"))
    every = sizes.groupBy("one").agg(F.sum("n2").alias("n0"))
    named = sizes.join(langs, F.col("lang").eqNullSafe(F.col("l"))).join(every, "one").select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.array(_key(0), _key(1, F.col("lang")), _key(2, F.col("lang"), F.col("source"))).alias("own"),
        F.when(F.col("n2") >= MIN_ROWS, _key(2, F.col("lang"), F.col("source")))
        .when(F.col("n1") >= MIN_ROWS, _key(1, F.col("lang"))).when(F.col("n0") >= MIN_ROWS, _key(0)).alias("model"))
    named = written(named, "groups")
    used = named.select(F.col("model").alias("m")).distinct()
    wanted = named.select("g_lang", "g_source", F.explode("own").alias("m")).join(used, "m") \
        .groupBy("g_lang", "g_source").agg(F.collect_list("m").alias("wanted"))
    return written(named.alias("n").join(wanted.alias("w"), F.expr("n.g_lang <=> w.g_lang AND n.g_source <=> w.g_source"), "left")
                   .select("n.g_lang", "n.g_source", "n.model", "w.wanted"), "groups")


def _at_share(counts: DataFrame, keys: list[str], shares: list[float], names: list[str]) -> DataFrame:
    """Per key the smallest bins that hold the given shares of the rows; counts: keys, bin, c."""
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(s * F.col("total")), F.col("bin"))).alias(n)
                                       for s, n in zip(shares, names)])


def _start(members: DataFrame) -> DataFrame:
    """model, mu, spread: middle and central range of every statistic, to the width of a bin, without correlations."""
    long = members.select("own", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.floor(F.col(c) * BINS).alias("bin"))
                                                     for i, c in enumerate(NAMES)])).alias("v")).select("own", "v.f", "v.bin")
    counts = long.groupBy("own", "f", "bin").agg(F.count(F.lit(1)).alias("c"))
    at = _at_share(counts, ["own", "f"], [0.16, 0.5, 0.84], ["lo", "mid", "hi"])
    wide = at.groupBy("own").agg(*[F.max(F.when(F.col("f") == i, (F.col("mid") + 0.5) / BINS)).alias(f"m{i}") for i in range(len(NAMES))],
                                 *[F.max(F.when(F.col("f") == i, (F.col("hi") - F.col("lo")) / (2.0 * BINS))).alias(f"s{i}")
                                   for i in range(len(NAMES))])
    p = range(len(NAMES))
    return wide.select("own", *[f"m{i}" for i in p], *[(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}")
                                                       for i in p for j in range(i + 1)])


def _factor(params: DataFrame) -> DataFrame:
    """own, m*, l*: the Cholesky factor of the scatter with its floor, column by column."""
    p = len(NAMES)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FEATURES[NAMES[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return params.drop(*[f"c{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance(rows: DataFrame) -> DataFrame:
    """rows joined with factors -> with d2, the squared Mahalanobis distance, by forward substitution."""
    for i, c in enumerate(NAMES):
        rest = F.col(c) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(NAMES))), F.col("y0") * F.col("y0"))
    return rows.withColumn("d2", d2).drop(*[f"y{i}" for i in range(len(NAMES))])


def _bin(d2: Column) -> Column:
    return F.floor(16 * F.log2(1 + 64 * d2))


def _step(members: DataFrame, factors: DataFrame) -> DataFrame:
    """One concentration step: new factors from the nearest rows of every group."""
    near = _distance(members.join(factors, "own")).withColumn("bin", _bin(F.col("d2")))
    counts = near.groupBy("own", "bin").agg(F.count(F.lit(1)).alias("c"))
    edge = written(factors.join(_at_share(counts, ["own"], [KEEP], ["edge"]), "own"), "edges")
    near = _distance(members.join(edge, "own")).filter(_bin(F.col("d2")) <= F.col("edge"))
    p = range(len(NAMES))
    got = near.groupBy("own").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(NAMES)],
                                  *[(CONSISTENCY * F.covar_pop(NAMES[i], NAMES[j])).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    return written(_factor(got), "factors")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, STATS, base_failed, distance2 (null where base_failed or no group is large enough), kept; one row per row.

    docs needs `key`, `text`, lang and source.  Null text: no words, base_failed.  Null lang or source: a group of its
    own.  Rows that fail the base rules take no part in the estimates.  Fewer than MIN_ROWS rows in all: nothing is
    rejected beyond the base rules.  Repeated rows and keys count as often as they stand; other columns are ignored."""
    rows = with_stats(docs.select(F.col(key).alias("key"), F.col(text).alias("__text"), "lang", "source"), "__text").drop("__text")
    rows = written(rows.withColumn("base_failed", base_failed()), "text-stats")
    same = F.expr("lang <=> g_lang AND source <=> g_source")
    sound = rows.filter(~F.col("base_failed"))
    groups = _groups(sound)
    members = written(sound.select("lang", "source", *[c.alias(n) for n, c in _features().items()]).join(groups, same)
                      .select(F.explode("wanted").alias("own"), *NAMES), "vectors")
    factors = written(_factor(_start(members)), "factors")
    for _ in range(STEPS):
        factors = _step(members, factors)
    found = _distance(rows.withColumns(_features()).join(groups, same, "left").join(factors, F.col("model") == F.col("own"), "left"))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return found.select(F.col("key").alias(key), *STATS, "base_failed", d2.alias("distance2"),
                        (~F.col("base_failed") & ~F.coalesce(d2 > CUTOFF, F.lit(False))).alias("kept"))
