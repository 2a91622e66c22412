"""Queries on token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boreline.llm.piece_viterbi import encode_texts
from boreline.llm.registry import query, table
from boreline.llm.shared import new_path
from boreline.llm.token_cache import count_tokens
from boreline.llm.token_files import read_index, write_tokens


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, with a cache that begins empty."""
    return count_tokens(table(spark, folder, "documents"), new_path(spark, "token-counts"))


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of all documents and whether they decode to the text."""
    return encode_texts(table(spark, folder, "documents"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write the ids of all documents as grammars, read the files back and tell where each document is."""
    path = new_path(spark, "token-files")
    write_tokens(table(spark, folder, "documents"), path)
    return read_index(spark, path)
