"""Query on spelling variants in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.registry import query, table
from boreline.llm.spelling import variants

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"

SQL_SPELLING = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
u AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS m FROM r GROUP BY run, s),
y AS (SELECT run, m, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS bytes FROM u),
h AS (SELECT run, m, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM y, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
p AS (SELECT a.word, b.word AS near, b.n FROM g AS a JOIN g AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS top FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN near END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n
                   FROM v LEFT JOIN b USING (word)),
c AS (WITH RECURSIVE c AS (SELECT word, form AS root, 1 AS k FROM f WHERE form IS NOT NULL
                           UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
      SELECT word, arg_max(root, k) AS root FROM c GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN c USING (word)"""


def misspelt_words(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters of all documents, some with one letter less by the checksum of document and run."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h")).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.length("run")))
    word = h.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= 6)
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("op12_reduced_alphabet", SQL_SPELLING)
def op12_reduced_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(misspelt_words(table(spark, folder, "documents")))
