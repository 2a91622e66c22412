"""Query on hard negatives among embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.hard_negatives import mine
from boreline.llm.registry import query, table

SQL_NEGATIVES = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score
                   FROM r AS a, r AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id,
       CAST(p.score AS BIGINT) AS positive_score, CAST(s.score AS BIGINT) AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 5"""


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding in whole 256ths, null where a component is null or not finite; every seventh label is the next one."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.when(~bad, F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), whole.alias("embedding"))


@query("op13_gnat", SQL_NEGATIVES)
def op13_gnat(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return mine(whole_vectors(table(spark, folder, "embeddings")), lambda i: i % 100 == 0)
