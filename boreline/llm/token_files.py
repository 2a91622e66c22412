"""Token ids in blocks of Re-Pair grammars: a Parquet table (part, block, data) in ascending order of the documents' keys.

Parts are ranges of keys; a task encodes the documents of a part in order and closes a block at BLOCK_TOKENS.  `data`
is the format of `repair.to_bytes`: it holds the keys and lengths of its documents and decodes each of them alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreline.llm.chunks import default_path, encoder
from boreline.llm.ranges import as_number, begins, search
from boreline.llm.repair import build, count_tokens, expand_all, from_bytes, to_bytes

END_ID = 2
NO_KEY = -1 << 63
BLOCK_TOKENS = 1 << 20
#: Bytes of text that a task encodes at a time.
SLICE_BYTES = 8 << 20
BLOCKS = "part int, block int, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text",
                 block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append END_ID and write the blocks to the Parquet folder `path`.

    Keys are whole numbers; rows of one key are in the order of their texts.  Rows without a key come first, in the order of
    their texts, and are kept under NO_KEY, which no row may have; they are read back without one.  Null text: only the end id.  A document longer than a block has a block of its own.  No rows: an empty table.  Other columns are ignored."""
    file = tokenizer or default_path("byte_bpe_50k.json")
    rows = docs.select(F.col(key).cast("long").alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    begin = begins(rows, "key")
    dealt = rows.withColumn("part", search(as_number(F.col("key")), begin[1:])) \
        .repartitionById(max(len(begin), 1), F.col("part")).sortWithinPartitions("part", "key", "text")

    def pack(part: int, block: int, keys: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
        size = np.array([len(i) for i in ids], np.int64)
        g = build(np.concatenate(ids), np.array(keys, np.int64), size)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([to_bytes(g)], pa.binary())],
                                          ["part", "block", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        part, block, total = None, 0, 0
        keys: list[int] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(at, to - at)
                got, size = own.arrays(some.column("text"))
                stop = np.cumsum(size)
                got, stop = np.insert(got, stop, END_ID), (stop + np.arange(1, len(stop) + 1)).tolist()
                for p, k, a, b in zip(some.column("part").to_pylist(), some.column("key").to_pylist(), [0, *stop], stop):
                    if keys and (p != part or total + b - a > block_tokens):
                        yield pack(part, block, keys, ids)
                        block, keys, ids, total = block + 1, [], [], 0
                    if p != part:
                        part, block = p, 0
                    keys.append(NO_KEY if k is None else k)
                    ids.append(got[a: b])
                    total += b - a
        if keys:
            yield pack(part, block, keys, ids)

    dealt.mapInArrow(write, BLOCKS).write.parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """part, block, place (number in its block), key, before (ids of the block before it), n_tokens, ids_crc32 and, if asked
    for, ids (binary, little-endian 32 bits): one row per document, decoded from the files."""
    schema = "part int, block int, place int, key long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, b, data in zip(*(batch.column(c) for c in ("part", "block", "data"))):
                g = from_bytes(data.as_py())
                ids = expand_all(g).astype("<u4")
                stop = np.cumsum(g.tokens)
                parts = [ids[s - n: s] for s, n in zip(stop.tolist(), g.tokens.tolist())]
                n = len(parts)
                cols = [pa.array(np.full(n, p.as_py(), np.int32)), pa.array(np.full(n, b.as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(g.keys, mask=g.keys == NO_KEY), pa.array(stop - g.tokens), pa.array(g.tokens), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["part", "block", "place", "key", "before", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.tobytes() for x in parts], pa.binary())] if with_ids else []), names + ["ids"] * with_ids)

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(read, schema)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """part, block, start: the ids of all blocks before each, from the blocks' headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(d.as_py()) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), pa.array(n, pa.int64())], ["part", "block", "n"])

    sizes = spark.read.schema(BLOCKS).parquet(path).mapInArrow(read, "part int, block int, n long")
    # few rows reach the one window over everything: one a part
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    return sizes.withColumn("inside", inside).join(base, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("start"))


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """`key`, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    return read_documents(spark, path).join(read_sizes(spark, path), ["part", "block"]).select(
        F.col("key").alias(key), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
