"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boreline.llm.perspectives import rotate
from boreline.llm.registry import query, table

SQL_ROTATE = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
                  CAST(coalesce(floor(turn / 256), -1) AS BIGINT) AS part FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part
          ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS place FROM t),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
r AS (SELECT conv_id, speaker, part, CAST(floor(place / 256) AS BIGINT) AS slice, place, role IS NOT DISTINCT FROM speaker AS own, text,
             '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = speaker THEN 'assistant'
                 ELSE 'user name=' || coalesce(role, 'unknown') END || chr(10) AS front
      FROM n JOIN s ON conv_id IS NOT DISTINCT FROM c),
e AS (SELECT *, front || text || '<|im_end|>' || chr(10) AS said FROM r),
o AS (SELECT *, sum(length(said)) OVER (PARTITION BY conv_id, speaker, part, slice ORDER BY place) - 1 AS stop FROM e),
b AS (SELECT *, stop + 1 - length(said) + length(front) AS start FROM o)
SELECT conv_id, speaker, part, slice, count(*) AS n_turns, string_agg(said, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY place)
           FILTER (WHERE own), '') AS mask,
       CAST(sum(CASE WHEN own THEN stop - start ELSE 0 END) AS BIGINT) AS n_mask_chars
FROM b GROUP BY ALL"""


@query("op2_perspectives", SQL_ROTATE)
def op2_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations from the side of each of their speakers."""
    return rotate(table(spark, folder, "conversations"))
