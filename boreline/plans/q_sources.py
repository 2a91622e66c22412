"""Sources, sinks, projections, predicates and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cols as C
from ..operators.quantiles import group_quantiles
from ..sources import logs, store
from . import bindings as B
from .registry import query


@query("scan_key_from_file", "A1", "src:s rows:l keys:l", """
SELECT 'nation.parquet' AS src, count(*) AS rows, count(DISTINCT n_regionkey) AS keys FROM nation
UNION ALL SELECT 'supplier.parquet', count(*), count(DISTINCT s_nationkey) FROM supplier
UNION ALL SELECT 'customer.parquet', count(*), count(DISTINCT c_nationkey) FROM customer""")
def scan_key_from_file(spark, sf):
    """Several files of unlike columns, each row labelled with the name of its file."""
    parts = [spark.read.parquet(f"{sf}/{t}.parquet").select(logs.file_key().alias("src"), F.col(c).alias("k"))
             for t, c in [("nation", "n_regionkey"), ("supplier", "s_nationkey"), ("customer", "c_nationkey")]]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("k").alias("keys"))


@query("series_files", "A1", "well:l seq:l md:d gr:d tvt_input:d", f"""
WITH {B.SERIES} SELECT well, seq, md, gr, CASE WHEN seq < cut THEN tvt END AS tvt_input FROM ev""")
def series_files(spark, sf):
    """The series as a collection of CSV files, read back by a glob; ids come from the files' paths, rows are numbered anew."""
    path = store.new_path(spark, "series-files")
    s = B.evaluable(B.series(spark, sf)).select("well", "seq", "md", "z", "gr", F.when(F.col("seq") < F.col("cut"), F.col("tvt")).alias("tvt_input"))
    logs.write_wells(s.withColumn("x", F.lit(0.0)).withColumn("y", F.col("seq").cast("double")), path)
    t = logs.read_wells(spark, path, truth=False, order="Y", files="*.csv", key=logs.folder_key(), nested=True)
    return t.withColumn("well", F.col("well").cast("long"))


@query("pruned_scan", "A2", "l_suppkey:l qty:d", """
SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_suppkey""")
def pruned_scan(spark, sf):
    return (B.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
            .where("l_discount >= 0.05D").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty")))


@query("sidecar_with_fallback", "A3", "well:l knots:l", """
SELECT user_id AS well, coalesce(any_value(k), 0) AS knots FROM events LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders
WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' GROUP BY o_custkey) ON o_custkey = user_id GROUP BY user_id""")
def sidecar_with_fallback(spark, sf):
    w = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("well")).agg(F.count(F.lit(1)).alias("n"))
    c = B.table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("well"))
    return logs.with_sidecar(w, c)


@query("fill_template", "A4", "id:s tvt:d", f"""
WITH {B.CAND}, p AS (SELECT well || '_' || seq AS id, g AS tvt FROM cand WHERE well % 3 <> 0), m AS (SELECT median(tvt) AS m FROM p)
SELECT c.well || '_' || c.seq AS id, coalesce(p.tvt, m.m) AS tvt FROM cand c LEFT JOIN p ON p.id = c.well || '_' || c.seq, m""")
def fill_template(spark, sf):
    c = B.cand(spark, sf).withColumn("id", F.concat_ws("_", "well", "seq"))
    return logs.fill_template(c, c.where("well % 3 <> 0").select("id", F.col("g").alias("tvt")))


@query("store_meta", "A5", "well:l n:l first_seq:l last_seq:l nn_mean:d", f"""
WITH {B.CAND} SELECT well, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, avg(nn) AS nn_mean FROM cand GROUP BY well""")
def store_meta(spark, sf):
    """Candidates written to a store partitioned by split, read back, described per series."""
    d = B.cand(spark, sf).select("well", "seq", "nn", (F.col("well") % 4).alias("split"))
    path = f"{store.checkpoint_dir(spark)}/cand-{uuid.uuid4().hex}"
    store.write_store(d, path, "split")
    return store.store_meta(spark.read.parquet(path))


@query("append_only_new", "A6", "o_orderkey:l total:d", """
SELECT o_orderkey, o_totalprice AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def append_only_new(spark, sf):
    todo = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    done = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.pending(todo, done, ["o_orderkey"])


@query("first_source_wins", "A7", "k:l v:d source:l", """
WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
SELECT k, v, 0 AS source FROM a UNION ALL SELECT k, v, 1 FROM b WHERE k NOT IN (SELECT k FROM a)""")
def first_source_wins(spark, sf):
    a = B.table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    b = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return store.first_source([a, b], ["k"])


@query("coverage_report", "A8", "well:l expected:l delivered:l missing:l not_finite:l", f"""
WITH {B.CAND} SELECT well, count(*) AS expected, count(*) FILTER (event_id % 10 <> 0) AS delivered,
  count(*) FILTER (event_id % 10 = 0) AS missing, count(*) FILTER (event_id % 10 = 1) AS not_finite FROM cand GROUP BY well""")
def coverage_report(spark, sf):
    c = B.cand(spark, sf)
    d = c.where("event_id % 10 <> 0").select("well", "seq", F.when(F.col("event_id") % 10 == 1, float("nan")).otherwise(F.col("g")).alias("v"))
    return store.coverage(c.select("well", "seq"), d, ["well", "seq"], "v", "well")


@query("json_parameters", "A9", "event_type:s n:l k_sum:l k_max:l", """
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max
FROM events GROUP BY event_type""")
def json_parameters(spark, sf):
    k = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"]
    return B.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("hide_answers", "B1", "well:l seq:l md:d tvt_input:d", f"""
WITH {B.SERIES} SELECT well, seq, md, CASE WHEN seq < cut THEN tvt END AS tvt_input FROM series""")
def hide_answers(spark, sf):
    return B.series(spark, sf).select("well", "seq", "md", F.when(F.col("seq") < F.col("cut"), F.col("tvt")).alias("tvt_input"))


@query("key_membership", "B2", "c_custkey:l kept:b", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS kept FROM customer
WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def key_membership(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey")
    rich = B.table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    out = c.join(B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti")
    a = out.join(rich, "c_custkey", "left_semi").withColumn("kept", F.lit(True))
    return a.unionByName(out.join(rich, "c_custkey", "left_anti").withColumn("kept", F.lit(False)))


@query("evaluable_series", "B3", "well:l n:l cut:l strict:b", f"""
WITH {B.SERIES} SELECT well, any_value(n) AS n, any_value(cut) AS cut, any_value(cut) >= 40 AS strict FROM ev GROUP BY well""")
def evaluable_series(spark, sf):
    e = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("well")).agg(F.count(F.lit(1)).alias("n"))
    return B.evaluable(e.withColumn("cut", F.bround(0.65 * F.col("n")).cast("long"))).withColumn("strict", F.col("cut") >= 40)


@query("clean_curve", "B4", "k:d v:d", """
SELECT p_size AS k, avg(p_retailprice) AS v FROM part WHERE p_brand <> 'Brand#17' GROUP BY p_size""")
def clean_curve(spark, sf):
    p = B.table(spark, sf, "part").select(F.when(F.col("p_brand") != "Brand#17", F.col("p_size")).cast("double").alias("k"),
                                          F.col("p_retailprice").alias("v"))
    return p.dropna(subset=["k", "v"]).groupBy("k").agg(F.avg("v").alias("v")).orderBy("k")


@query("stride_sample", "B5", "well:l seq:l grn:d", f"""
WITH {B.SERIES} SELECT well, seq, grn FROM series WHERE seq % 10 = 0 AND grn IS NOT NULL""")
def stride_sample(spark, sf):
    """Every tenth row of each series, nulls dropped after the stride."""
    return B.series(spark, sf).where(F.pmod("seq", F.lit(10)) == 0).where(F.col("grn").isNotNull())


@query("box_prune", "B6", "grp:l near:l", f"""
WITH {B.CLOUD}, b AS (SELECT CAST(floor(x / 500) AS BIGINT) AS cell, min(x) - 50 AS x0, max(x) + 50 AS x1, min(y) - 50 AS y0, max(y) + 50 AS y1
  FROM cloud WHERE grp % 50 = 7 GROUP BY 1)
SELECT cell AS grp, count(*) AS near FROM b JOIN cloud c ON c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1 AND c.grp % 50 <> 7 GROUP BY cell""")
def box_prune(spark, sf):
    """Points of other groups inside the bounding box of a region plus a margin; boxes meet points by x cell."""
    c = B.cloud(spark, sf).select("grp", "x", "y")
    own = F.col("grp") % 50 == 7
    b = c.where(own).groupBy(F.floor(F.col("x") / 500).alias("cell")).agg(
        (F.min("x") - 50).alias("x0"), (F.max("x") + 50).alias("x1"), (F.min("y") - 50).alias("y0"), (F.max("y") + 50).alias("y1"))
    b = b.withColumn("h", F.explode(F.sequence(F.floor(F.col("x0") / 500), F.floor(F.col("x1") / 500))))
    t = c.where(~own).withColumn("h", F.floor(F.col("x") / 500)).join(b, "h")
    t = t.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return t.groupBy(F.col("cell").alias("grp")).agg(F.count(F.lit(1)).alias("near"))


@query("coverage_mask", "B7", "well:l covered:l total:l", f"""
WITH {B.SERIES}, r AS (SELECT well, min(md) AS lo, max(md) AS hi FROM ev WHERE seq >= 5 AND seq < cut GROUP BY well)
SELECT well, count(*) FILTER (md >= lo - 0.5 AND md <= hi + 0.5) AS covered, count(*) AS total FROM ev JOIN r USING (well) GROUP BY well""")
def coverage_mask(spark, sf):
    s = B.evaluable(B.series(spark, sf))
    r = s.where((F.col("seq") >= 5) & (F.col("seq") < F.col("cut"))).groupBy("well").agg(F.min("md").alias("lo"), F.max("md").alias("hi"))
    hit = F.col("md").between(F.col("lo") - 0.5, F.col("hi") + 0.5)
    return s.join(r, "well").groupBy("well").agg(F.count(F.when(hit, 1)).alias("covered"), F.count(F.lit(1)).alias("total"))


@query("clip_floor_divide", "B8", "s_suppkey:l clipped:d floored:d ratio:d", """
SELECT s_suppkey, least(greatest(s_acctbal / 10000, 0.05), 0.9) AS clipped, greatest(s_acctbal, 0.001) AS floored,
  s_acctbal / nullif(s_nationkey, 0) AS ratio FROM supplier""")
def clip_floor_divide(spark, sf):
    a = F.col("s_acctbal")
    return B.table(spark, sf, "supplier").select(
        "s_suppkey", C.clip(a / 10000, 0.05, 0.9).alias("clipped"), F.greatest(a, F.lit(0.001)).alias("floored"),
        C.safe_div(a, F.col("s_nationkey")).alias("ratio"))


@query("fallback_cascade", "B9", "via:s n:l total:d", f"""
WITH {B.CAND}, v AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'blend' WHEN event_id % 5 = 1 AND md_since > 100 THEN 'surf' WHEN n_pred > 22 THEN 'geo' ELSE 'flat' END AS via, * FROM cand)
SELECT via, count(*) AS n, sum(CASE via WHEN 'blend' THEN p WHEN 'surf' THEN s WHEN 'geo' THEN g ELSE f END) AS total FROM v GROUP BY via""")
def fallback_cascade(spark, sf):
    """Best stage that produced a finite value, with the name of the stage."""
    nan = F.lit(float("nan"))
    st = {"blend": C.finite(F.when(F.col("event_id") % 5 == 0, F.col("p")).otherwise(nan)),
          "surf": F.when((F.col("event_id") % 5 == 1) & (F.col("md_since") > 100), F.col("s")),
          "geo": F.when(F.col("n_pred") > 22, F.col("g")), "flat": F.col("f")}
    via = F.coalesce(*[F.when(e.isNotNull(), F.lit(k)) for k, e in st.items()])
    return B.cand(spark, sf).select(via.alias("via"), F.coalesce(*st.values()).alias("v")).groupBy("via").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("key_compose_split", "B10", "id:s well:l row:l", f"""
WITH {B.SERIES} SELECT well || '_' || seq AS id, well, seq AS row FROM series""")
def key_compose_split(spark, sf):
    t = B.series(spark, sf).select(F.concat_ws("_", "well", "seq").alias("id"))
    return t.select("id", F.substring_index("id", "_", 1).cast("long").alias("well"), F.split("id", "_")[1].cast("long").alias("row"))


@query("config_hash", "B11", "c_custkey:l h:s", """
SELECT c_custkey, substr(md5('s10_a16_' || c_custkey || '_24'), 1, 16) AS h FROM customer""")
def config_hash(spark, sf):
    """Stable 16-digit hash of a configuration and a key."""
    h = F.substring(F.md5(F.concat_ws("_", F.lit("s10_a16"), F.col("c_custkey"), F.lit(24))), 1, 16)
    return B.table(spark, sf, "customer").select("c_custkey", h.alias("h"))


@query("log_line_fields", "B12", "source:s lines:l hits:l digits:l", r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS lines, count(*) FILTER (regexp_matches(line, '([A-Za-z]+)\s*[:=]\s*([0-9]+)')) AS hits,
  sum(length(regexp_extract(line, '([A-Za-z]+)\s*[:=]\s*([0-9]+)', 2))) AS digits FROM l GROUP BY source""")
def log_line_fields(spark, sf):
    """`name: number` fields pulled from every line of every text."""
    pat = r"([A-Za-z]+)\s*[:=]\s*([0-9]+)"
    l = B.table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    return l.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("line").rlike(pat), 1)).alias("hits"),
                                   F.sum(F.length(F.regexp_extract("line", pat, 2))).alias("digits"))


THETA = 2.278489


@query("rotate_stretch", "B13", "id:l u:d v:d", f"""
WITH {B.CLOUD} SELECT id, (x * cos({THETA}) + y * sin({THETA})) * 16 AS u, y * cos({THETA}) - x * sin({THETA}) AS v FROM cloud""")
def rotate_stretch(spark, sf):
    u, v = C.rotate_stretch(F.col("x"), F.col("y"), THETA, along=16.0)
    return B.cloud(spark, sf).select("id", u.alias("u"), v.alias("v"))


@query("gates_and_softmax", "B14", "well:l seq:l gate:d ramp:d w1:d w2:d w3:d", f"""
WITH {B.CAND}, e AS (SELECT well, seq, 1 / (1 + exp(least(greatest((nn - 300) / 100, -50), 50))) AS gate, 1 - exp(-md_since / 500) AS ramp,
  exp(nn / 500 - greatest(nn / 500, 0, md_since / 900)) AS a, exp(0 - greatest(nn / 500, 0, md_since / 900)) AS b,
  exp(md_since / 900 - greatest(nn / 500, 0, md_since / 900)) AS c FROM cand)
SELECT well, seq, gate, ramp, a / (a + b + c) AS w1, b / (a + b + c) AS w2, c / (a + b + c) AS w3 FROM e""")
def gates_and_softmax(spark, sf):
    w = C.softmax([F.col("nn") / 500, F.lit(0.0), F.col("md_since") / 900])
    return B.cand(spark, sf).select("well", "seq", C.sigmoid_gate(F.col("nn"), 300, 100).alias("gate"),
                                    C.ramp_up(F.col("md_since"), 500.0).alias("ramp"), *[e.alias(f"w{i+1}") for i, e in enumerate(w)])


@query("standardise_impute", "B15", "well:l seq:l z:d", f"""
WITH {B.SERIES}, m AS (SELECT median(grn) AS med FROM series), f AS (SELECT well, seq, coalesce(grn, med) AS v FROM series, m),
a AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM f) SELECT well, seq, (v - mu) / (sd + 1e-9) AS z FROM f, a""")
def standardise_impute(spark, sf):
    """Nulls take the exact median of all rows, then mean 0 and deviation 1."""
    s = B.series(spark, sf).select("well", "seq", "grn").withColumn("one", F.lit(1))
    m = group_quantiles(s, [], F.col("grn"), {"med": 0.5}).withColumn("one", F.lit(1))
    f = s.join(m, "one").withColumn("v", F.coalesce("grn", "med"))
    a = f.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).withColumn("one", F.lit(1))
    return f.join(a, "one").select("well", "seq", ((F.col("v") - F.col("mu")) / (F.col("sd") + 1e-9)).alias("z"))


@query("log_feature_frame", "B16", "well:l log_nn:d log_dis:d npk:d w_s:d log_r:d", f"""
WITH {B.CAND}, w AS (SELECT well, avg(nn) AS nn, avg(abs(s - p)) AS dis, count(*) AS n, CASE WHEN well % 6 <> 0 THEN sqrt(avg((y - s) ** 2)) END AS r FROM cand GROUP BY well),
m AS (SELECT median(r) AS m FROM w)
SELECT well, ln(greatest(nn, 1)) AS log_nn, ln(greatest(dis, 0.001)) AS log_dis, n / 1000 AS npk,
  coalesce(CASE WHEN well % 6 <> 0 THEN 0.3 END, 0.45) AS w_s, ln(greatest(coalesce(r, m), 0.01)) AS log_r FROM w, m""")
def log_feature_frame(spark, sf):
    known = F.col("well") % 6 != 0
    w = B.cand(spark, sf).groupBy("well").agg(F.avg("nn").alias("nn"), F.avg(F.abs(F.col("s") - F.col("p"))).alias("dis"),
                                              F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("y") - F.col("s")) ** 2)).alias("r"))
    w = w.withColumn("r", F.when(known, F.col("r"))).withColumn("one", F.lit(1))
    m = group_quantiles(w, [], F.col("r"), {"m": 0.5}).withColumn("one", F.lit(1))
    lg = lambda c, lo: F.log(F.greatest(c, F.lit(lo)))
    return w.join(m, "one").select("well", lg(F.col("nn"), 1.0).alias("log_nn"), lg(F.col("dis"), 1e-3).alias("log_dis"),
                                   (F.col("n") / 1000).alias("npk"), F.coalesce(F.when(known, F.lit(0.3)), F.lit(0.45)).alias("w_s"),
                                   lg(F.coalesce("r", "m"), 1e-2).alias("log_r"))
