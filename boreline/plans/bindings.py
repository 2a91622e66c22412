"""Logical tables of the toolkit bound to the driver tables, in Spark and in SQL.

series: events, one series per user; md in units of six minutes since its first event
curve : part, average retail price by size (50 knots)
cloud : orders joined to customer, points with three horizon values
cand  : rows after the cut of each series with four candidate predictions
ens   : cand times eight deterministic replicas with a log-likelihood per replica
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import row_std
from ..operators.ordering import number_rows, running_sum

TAIL = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(ts: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone is."""
    c = F.col(ts)
    sec = F.expr(f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")
    return (F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000
            + F.minute(c).cast("long") * 60_000_000 + sec)


def series(spark: SparkSession, sf: str, xy: bool = False) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("well"), "event_id", F.col("value").alias("tvt"), micros("ts").alias("us"))
    s = number_rows(e, ["well"], "us", "event_id")
    s = s.select(
        "well", "seq", "n", "event_id", ((F.col("us") - F.col("order0")) / 3.6e8).alias("md"),
        F.col("tvt").alias("gr"), F.when(F.col("event_id") % 7 != 0, F.col("tvt")).alias("grn"), "tvt",
        (F.col("event_id") % 97).cast("double").alias("z"),
        F.bround(0.65 * F.col("n")).cast("long").alias("cut"))
    if xy:
        s = running_sum(s, ["well"], {"x": F.col("tvt"), "y": (F.col("event_id") % 11).cast("double")})
    return s


def evaluable(df: DataFrame) -> DataFrame:
    """A series counts when at least 20 rows are known and at least one is not."""
    return df.where((F.col("cut") >= 20) & (F.col("cut") < F.col("n")))


def anchors(s: DataFrame) -> DataFrame:
    """Per-series scalars of the known part, one aggregate."""
    seq, cut = F.col("seq"), F.col("cut")
    at = seq == cut - 1
    pre = seq < cut
    tail = pre & (seq >= cut - TAIL)
    return evaluable(s).groupBy("well", "cut", "n").agg(
        F.max(F.when(at, F.col("tvt"))).alias("f"), F.max(F.when(at, F.col("z"))).alias("z0"),
        F.max(F.when(at, F.col("md"))).alias("md0"), F.avg(F.when(pre, F.col("tvt"))).alias("p"),
        F.median(F.when(tail, F.col("tvt"))).alias("s"),
        F.regr_slope(F.when(pre, F.col("tvt")), F.when(pre, F.col("md"))).alias("sl"),
        F.regr_intercept(F.when(pre, F.col("tvt")), F.when(pre, F.col("md"))).alias("ic"))


def cand(spark: SparkSession, sf: str, s: DataFrame | None = None) -> DataFrame:
    """`s`: the series, where the caller has written them already."""
    s = series(spark, sf) if s is None else s
    post = evaluable(s).where(F.col("seq") >= F.col("cut")).drop("n", "cut")
    return post.join(anchors(s), "well").select(
        "well", "seq", "event_id", "n", "cut", "md", "z", F.col("tvt").alias("y"), "f", "s", "p",
        (F.col("ic") + F.col("sl") * F.col("md")).alias("g"), "z0", "md0",
        (10 * F.abs(F.col("z") - F.col("z0"))).alias("nn"), (F.col("md") - F.col("md0")).alias("md_since"),
        (F.col("n") - F.col("cut")).alias("n_pred"))


def masked(s: DataFrame, fracs: list[float], min_cut: int = 20, min_tail: int = 5) -> DataFrame:
    """Masked-tail view of the known part: for each fraction the rows before `cut` get a new, earlier cut."""
    pairs = F.explode(F.array(*[F.lit(float(f)) for f in fracs]))
    m = s.where(F.col("seq") < F.col("cut")).withColumn("frac", pairs)
    m = m.withColumn("cut2", F.bround(F.col("frac") * F.col("cut")).cast("long"))
    return m.where((F.col("cut2") >= min_cut) & (F.col("cut") - F.col("cut2") >= min_tail))


def backtest(spark: SparkSession, sf: str, fracs=(0.5, 0.65, 0.75), s: DataFrame | None = None) -> DataFrame:
    """Candidates re-predicted on the masked tail, long over `frac`."""
    m = masked(evaluable(series(spark, sf) if s is None else s), list(fracs))
    seq, cut = F.col("seq"), F.col("cut2")
    pre = seq < cut
    a = m.groupBy("well", "frac").agg(
        F.max(F.when(seq == cut - 1, F.col("tvt"))).alias("f"),
        F.max(F.when(seq == cut - 1, F.col("md"))).alias("md0"),
        F.avg(F.when(pre, F.col("tvt"))).alias("p"),
        F.median(F.when(pre & (seq >= cut - TAIL), F.col("tvt"))).alias("s"),
        F.regr_slope(F.when(pre, F.col("tvt")), F.when(pre, F.col("md"))).alias("sl"),
        F.regr_intercept(F.when(pre, F.col("tvt")), F.when(pre, F.col("md"))).alias("ic"))
    return m.where(seq >= cut).join(a, ["well", "frac"]).select(
        "well", "frac", "seq", F.col("tvt").alias("y"), "f", "s", "p",
        (F.col("ic") + F.col("sl") * F.col("md")).alias("g"), (F.col("md") - F.col("md0")).alias("md_since"))


SEEDS = 8


def replica(seed) -> tuple:
    """Values of one seed of the two ensembles: around s and around p."""
    noise = ((F.col("event_id") * 7919 + seed * 104729) % 2001 - 1000) / 100.0
    noise2 = ((F.col("event_id") * 6151 + seed * 92821) % 1601 - 800) / 100.0
    return F.col("s") + noise, F.col("p") + noise2


def spreads() -> tuple:
    """Deviations of both ensembles over the seeds of one candidate row."""
    return tuple(row_std(list(v)) for v in zip(*[replica(F.lit(i).cast("long")) for i in range(1, SEEDS + 1)]))


def ens(spark: SparkSession, sf: str, c: DataFrame | None = None) -> DataFrame:
    """Two replica ensembles of eight seeds: value around s, value2 around p.  `c`: the candidates, where they are written already."""
    c = (cand(spark, sf) if c is None else c).select("well", "seq", "event_id", "y", "s", "p")
    c = c.withColumn("seed", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SEEDS).cast("long"))))
    value, value2 = replica(F.col("seed"))
    return c.withColumn("value", value).withColumn("value2", value2).drop("event_id", "p")


def ens_ll(e: DataFrame) -> DataFrame:
    d = F.col("value") - F.col("s")
    return e.groupBy("well", "seed").agg((-0.5 * F.avg(d * d)).alias("ll"))


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("k")).agg(
        F.avg("p_retailprice").alias("v"))


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"),
        (F.col("o_totalprice") / 100).alias("x"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("y"),
        F.col("o_totalprice").alias("h1"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), "c_acctbal")
    # Customers grow with the orders: sorted, as their file's size would let Spark broadcast millions of them.
    return o.join(c.hint("merge"), "grp").select(
        "id", "grp", "x", "y", "h1", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("h2"),
        (F.col("grp") % 1000).cast("double").alias("h3"))


# --------------------------------------------------------------------------- SQL twins
SERIES = """
s0 AS (SELECT user_id AS well, event_id, value, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         count(*) OVER (PARTITION BY user_id) AS n, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us0
       FROM events),
series AS (SELECT well, seq, n, event_id, (us - us0) / 3.6e8 AS md, value AS gr,
         CASE WHEN event_id % 7 <> 0 THEN value END AS grn, value AS tvt, CAST(event_id % 97 AS DOUBLE) AS z,
         CAST(round_even(0.65 * n, 0) AS BIGINT) AS cut,
         sum(value) OVER w AS x, CAST(sum(event_id % 11) OVER w AS DOUBLE) AS y
       FROM s0 WINDOW w AS (PARTITION BY well ORDER BY seq)),
ev AS (SELECT * FROM series WHERE cut >= 20 AND cut < n)"""
CAND = SERIES + """,
anch AS (SELECT well, cut, n, max(tvt) FILTER (seq = cut - 1) AS f, max(z) FILTER (seq = cut - 1) AS z0,
         max(md) FILTER (seq = cut - 1) AS md0, avg(tvt) FILTER (seq < cut) AS p,
         median(tvt) FILTER (seq < cut AND seq >= cut - 10) AS s,
         regr_slope(tvt, md) FILTER (seq < cut) AS sl, regr_intercept(tvt, md) FILTER (seq < cut) AS ic
       FROM ev GROUP BY well, cut, n),
cand AS (SELECT e.well, e.seq, e.event_id, e.n, e.cut, e.md, e.z, e.tvt AS y, f, s, p, ic + sl * e.md AS g, z0, md0,
         10 * abs(e.z - z0) AS nn, e.md - md0 AS md_since, e.n - e.cut AS n_pred
       FROM ev e JOIN anch a ON e.well = a.well WHERE e.seq >= e.cut)"""
BACKTEST = SERIES + """,
m0 AS (SELECT ev.*, frac, CAST(round_even(frac * cut, 0) AS BIGINT) AS cut2
       FROM ev, (SELECT unnest([0.5::DOUBLE, 0.65, 0.75]) AS frac) WHERE seq < cut),
m AS (SELECT * FROM m0 WHERE cut2 >= 20 AND cut - cut2 >= 5),
ba AS (SELECT well, frac, max(tvt) FILTER (seq = cut2 - 1) AS f, max(md) FILTER (seq = cut2 - 1) AS md0,
         avg(tvt) FILTER (seq < cut2) AS p, median(tvt) FILTER (seq < cut2 AND seq >= cut2 - 10) AS s,
         regr_slope(tvt, md) FILTER (seq < cut2) AS sl, regr_intercept(tvt, md) FILTER (seq < cut2) AS ic
       FROM m GROUP BY well, frac),
bt AS (SELECT m.well, m.frac, m.seq, m.tvt AS y, f, s, p, ic + sl * m.md AS g, m.md - md0 AS md_since
       FROM m JOIN ba ON m.well = ba.well AND m.frac = ba.frac WHERE m.seq >= m.cut2)"""
ENS = CAND + """,
ens AS (SELECT well, seq, y, s, seed, s + ((event_id * 7919 + seed * 104729) % 2001 - 1000) / 100.0 AS value
        FROM cand, (SELECT unnest(range(1, 9)) AS seed)),
ensll AS (SELECT well, seed, -0.5 * avg((value - s) * (value - s)) AS ll FROM ens GROUP BY well, seed)"""
CURVE = "curve AS (SELECT CAST(p_size AS DOUBLE) AS k, avg(p_retailprice) AS v FROM part GROUP BY p_size)"
CLOUD = """cloud AS (SELECT o_orderkey AS id, o_custkey AS grp, o_totalprice / 100 AS x,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y, o_totalprice AS h1,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS h2, CAST(o_custkey % 1000 AS DOUBLE) AS h3
       FROM orders JOIN customer ON o_custkey = c_custkey)"""
