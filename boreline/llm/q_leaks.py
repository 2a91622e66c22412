"""Query on benchmark passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.leak_search import find_leaks
from boreline.llm.registry import query, table

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_LEAKS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS} AS ws FROM benchmark),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 10 THEN list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9])
                                                    WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS x FROM b),
sizes AS (SELECT DISTINCT len(x) AS size FROM q),
places AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size),
m AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM places JOIN q ON ws[i:i + size - 1] = x),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op11_fm_index", SQL_LEAKS)
def op11_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    """Which words of every document stand in benchmark passages, and in which items'."""
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
