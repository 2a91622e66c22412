"""Token counts through a cache of content digests.

A count depends on the text and on the tokenizer's file, so the cache is keyed by both digests.  Documents join it,
one document of every digest that has no count is encoded, and the new counts are appended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.chunks import default_path, encoder

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
ROWS = 256


def normalised(text: Column) -> Column:
    """What is counted: the text itself, null as empty.  Nothing else may change, or counts would differ."""
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """content, n_tokens of one tokenizer; an appended row may be there twice after a repeated write."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """content, text -> content, n_tokens.  Arrow batches are walked in small slices, whole texts each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, counts_only=True)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = list(own.values(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(count, "content binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """`key`, n_bytes, n_tokens, over_limit for every row; appends the counts it had to make to the Parquet folder `cache`.

    Null or empty text: 0 bytes, 0 tokens.  Repeated rows and equal texts: one row each, counted once.  Null keys are
    kept.  An empty table gives an empty result and appends nothing.  Other columns are ignored."""
    spark = docs.sparkSession
    path = tokenizer or default_path("byte_bpe_50k.json")
    version = tokenizer_digest(path)
    rows = docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("text")).withColumn("content", content_digest(F.col("text")))
    facts = rows.select("key", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    # the digest's smallest key stands for it; the text follows in a join by key, which has no hot values
    wanted = facts.groupBy("content").agg(F.min("key").alias("holder"))
    misses = wanted.join(read_cache(spark, cache, version).select("content"), "content", "left_anti")
    held = rows.alias("r").join(misses.alias("m"), F.expr("r.key <=> m.holder AND r.content = m.content")).select("r.content", "r.text")
    fresh = encode_counts(held, path).select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").parquet(cache)
    return facts.join(read_cache(spark, cache, version), "content").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
