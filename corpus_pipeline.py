"""From raw documents to mixed, encoded ones: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.llm.near_dedup import link
from boreline.llm.piece_viterbi import encode_texts
from boreline.llm.poisson_mix import mix
from boreline.llm.robust_outliers import judge
from boreline.llm.shared import without, written
from boreline.llm.suffix_index import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language and source go.  Where rows share a doc_id, a verdict
    against one of them is against all."""
    rejected = written(judge(docs).filter(~F.col("kept")).select("doc_id"), "rejected")
    return without(docs.select(*COLUMNS), "doc_id", rejected, "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id stays."""
    doubles = written(link(docs).filter(~F.col("kept")).select("doc_id"), "doubles")
    return without(docs.select(*COLUMNS), "doc_id", doubles, "doc_id")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 100-byte passages leave the texts; n_chars follows.  A document that loses all its bytes goes."""
    cut = remove_repeats(docs, carry=["text", "lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    left = cut.filter(~changed | (F.length("kept_text") > 0))
    return left.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
                       F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target rate says, all in a new order."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip of every row of the mix."""
    return encode_texts(docs)


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", encode_pieces)]

#: Near duplicates, byte spans and pieces have no SQL; tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
