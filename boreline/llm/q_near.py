"""Queries on near-duplicate documents and repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boreline.llm.near_dedup import link
from boreline.llm.registry import query, table
from boreline.llm.suffix_index import remove_repeats


SQL_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]))
                         WHEN len(ws) > 0 THEN [ws] ELSE [] END AS shingles FROM w),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM s LEFT JOIN c ON doc_id = a"""

SQL_REPEATS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (SELECT doc_id, c, substr(h, 2 * c + 1, 1198) AS h, least(500, length(h) // 2 - 99 - c) AS n FROM d, unnest(range(0, length(h) // 2 - 99, 500)) AS t(c)),
w AS (SELECT doc_id, c + unnest(range(0, n)) AS s, unnest(list_transform(range(0, n), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS x FROM c),
f AS MATERIALIZED (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
b AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS s, unnest(regexp_extract_all(h, '..')) AS byte FROM d),
m AS (SELECT b.doc_id, b.s, byte, coalesce(max(f.s) OVER (PARTITION BY b.doc_id ORDER BY b.s) >= b.s - 99, false) AS gone
      FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.s = b.s),
g AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY s) AS opens FROM m),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
             string_agg(byte, '' ORDER BY s) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""


@query("op3_hyperminhash", SQL_NEAR)
def op3_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents among all documents."""
    return link(table(spark, folder, "documents"))


@query("op6_suffix_arrays", SQL_REPEATS)
def op6_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated 100-byte passages."""
    return remove_repeats(table(spark, folder, "documents"))
