"""Queries on mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.poisson_mix import mix
from boreline.llm.registry import query, table

#: The steps of the inversion, unrolled: SQL keeps the running chance of every k in a recursive table per source.
SQL_MIX = """
WITH RECURSIVE s AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, pow(size, 0.7) AS weight FROM s),
t AS (SELECT sum(size) AS every, sum(weight) AS weights FROM w),
r AS (SELECT source, coalesce(CASE WHEN size > 0 THEN weight / weights * every * 1.0 / size END, 0.0) AS rate FROM w, t),
d AS (SELECT doc_id, documents.source, text, rate, greatest(CAST(ceil(rate / 8.0) AS INTEGER), 1) AS draws
      FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
one AS (SELECT DISTINCT rate, draws, rate / draws AS mean FROM d),
p(mean, k, p, upto) AS (SELECT DISTINCT mean, 0, exp(-mean), exp(-mean) FROM one
    UNION ALL SELECT mean, k + 1, p * mean / (k + 1), upto + p * mean / (k + 1) FROM p WHERE k < 59),
u AS (SELECT doc_id, source, text, rate, rate / draws AS mean, i,
             CAST(('0x' || substr(md5('0:count:' || i || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
                 / 4503599627370496.0 AS u
      FROM d, unnest(range(1, draws + 1)) AS x(i)),
c AS (SELECT doc_id, source, text, rate, CAST(sum((SELECT count(*) FROM p WHERE p.mean = u.mean AND p.upto <= u.u)) AS INTEGER) AS n
      FROM u GROUP BY doc_id, source, text, rate)
SELECT doc_id, source, round(rate, 9) AS rate, CAST(copy AS INTEGER) AS copy,
       CAST(('0x' || substr(md5('0:place:' || copy || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
           / 4503599627370496.0 AS place, text
FROM c, unnest(range(0, n)) AS y(copy)"""


@query("op9_poisson_mix", SQL_MIX)
def op9_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents by tempered source sizes."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.round("rate", 9).alias("rate"), "copy", "place", "text")
