"""Queries on document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boreline.llm.registry import query, table
from boreline.llm.spot_match import compare_and_match


@query("op10_spotsigs")
def op10_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts how alike they are, and the groups of documents that are alike."""
    return compare_and_match(table(spark, folder, "documents"))
