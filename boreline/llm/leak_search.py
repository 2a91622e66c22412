"""Benchmark passages in training documents, by an FM-index per shard of the documents.

A shard is a run of documents of at most SHARD_WORDS words in one input split; longer documents are cut into pieces that
overlap by a window less one word, so every window is whole in one of them.  The shards' indexes are written once, as a
table that any benchmark can be searched in.  Test windows are the stated query set: they go to all shards in blocks of
at most BLOCK pairs of window and item, one pass over the indexes a block, so what is broadcast has a bound whatever the
size of the benchmark.  A shard is searched backward for all windows of a block at once; occurrences are located by the
sampled positions and merged into spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreline.llm import fm_index
from boreline.llm.blocks import LOWER, U64, prefix_hash, span_hash, text_blocks, word_spans
from boreline.llm.shared import new_path, written

WIDTH = 10
SHARD_WORDS = 1 << 19
#: Pairs of a window and an item in a block: 8 * WIDTH + some 40 bytes each.
BLOCK = 1 << 18
#: Occurrences or (document, window, item) triples that are held at once.
CHUNK = 1 << 20

_SHAPE = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SHAPE[_a: _b + 1] = 0x61


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the runs of digits, letters and characters beyond ASCII."""
    return word_spans(_SHAPE[data], offsets)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z as a-z, and the number of words of every row."""
    start, end, row = word_places(data, offsets)
    return span_hash(prefix_hash(LOWER[data]), start, end), np.bincount(row, minlength=len(offsets) - 1)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard, written: fm (binary), its pieces (row, first word) and the documents that begin in it (row, key, n_words).
    A row number tells rows apart that share a key."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"fm binary, piece_row array<bigint>, piece_at array<bigint>, doc_row array<bigint>, doc_key array<{kind}>, doc_words array<bigint>"
    names = ["fm", "piece_row", "piece_at", "doc_row", "doc_key", "doc_words"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt = TaskContext.get().partitionId() << 40
        words: list[np.ndarray] = []
        piece_row: list[int] = []
        piece_at: list[int] = []
        sizes: list[int] = []
        docs_of: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held
            f = fm_index.build(np.concatenate(words) if words else np.zeros(0, U64), np.array(sizes, np.int64))
            cols = [pa.array([fm_index.to_bytes(f)], pa.binary())]
            for x in (np.array(piece_row, np.int64), np.array(piece_at, np.int64), np.concatenate([d[0] for d in docs_of]) if docs_of else np.zeros(0, np.int64),
                      pa.concat_arrays([d[1] for d in docs_of]) if docs_of else None, np.concatenate([d[2] for d in docs_of]) if docs_of else np.zeros(0, np.int64)):
                flat = pa.nulls(0, key_type) if x is None else x if isinstance(x, pa.Array) else pa.array(x)
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            for x in (words, piece_row, piece_at, sizes, docs_of):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            keys, key_type = batch.column("key"), batch.schema.field("key").type
            for a, b, data, offsets in text_blocks(batch.column("text")):
                h, count = _hashes(data, offsets)
                bound = np.r_[0, np.cumsum(count)]
                rows = nxt + np.arange(b - a)
                nxt += b - a
                done = 0
                for i in range(b - a):
                    at, stop, lo = int(bound[i]), int(bound[i + 1]), int(bound[i])
                    while True:
                        # a piece takes what the shard still holds; a longer rest begins again a window less one word earlier
                        if held + 1 + min(stop - at, 2 * width) > shard_words and (held or sizes):
                            if done < i:
                                docs_of.append((rows[done:i], keys.slice(a + done, i - done), count[done:i]))
                                done = i
                            yield close()
                        to = min(stop, at + shard_words - held - 1)
                        words.append(h[at:to])
                        piece_row.append(int(rows[i]))
                        piece_at.append(at - lo)
                        sizes.append(to - at)
                        held += to - at + 1
                        if to == stop:
                            break
                        at = to - width + 1
                docs_of.append((rows[done:], keys.slice(a + done, b - a - done), count[done:]))
        if sizes:
            yield close()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return written(rows.mapInArrow(index, schema), "fm-index")


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (window, size, item): word hashes aligned to the right in `width` places; an item of fewer words is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column("text")):
                h, count = _hashes(data, offsets)
                bound, of = np.r_[0, np.cumsum(count)], batch.column("item").slice(a, b - a)
                owner = np.repeat(np.arange(b - a), count)
                at = np.flatnonzero(np.arange(len(h)) + width <= bound[1:][owner])
                full = h[at[:, None] + np.arange(width)]
                few = np.flatnonzero((count > 0) & (count < width))
                short = np.zeros((len(few), width), U64)
                for j, i in enumerate(few):
                    short[j, width - count[i]:] = h[bound[i]: bound[i + 1]]
                raw = np.concatenate([full, short]).astype("<u8")
                size = np.r_[np.full(len(at), width), count[few]].astype(np.int32)
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([cells, pa.array(size), of.take(pa.array(np.r_[owner[at], few].astype(np.int64)))], ["words", "size", "item"])

    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "words binary, size int, item string").distinct()


def _search(f: fm_index.FmIndex, windows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, text position) of all occurrences, CHUNK at a time."""
    lo, hi = f.count(windows, sizes)
    found = np.flatnonzero(hi > lo)
    many = hi[found] - lo[found]
    ends = np.cumsum(many)
    for a in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        at = np.arange(a, min(a + CHUNK, int(ends[-1])))
        w = np.searchsorted(ends, at, side="right")
        yield found[w], f.locate(lo[found[w]] + at - (ends[w] - many[w]))


def _merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of every row, those that meet or overlap as one."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    base = np.r_[0, np.cumsum(row[1:] != row[:-1])] if len(row) else row
    wide = int(b.max()) + 2 if len(b) else 1
    reach = np.maximum.accumulate(b + base * wide)
    new = np.ones(len(a), bool)
    new[1:] = (a + base * wide)[1:] > reach[:-1]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1] if len(a) else np.zeros(0, np.int64)
    return row[new], a[new], reach[last] - base[last] * wide


def search_index(index: DataFrame, windows: DataFrame, width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Spans (row, a, b) and items (row, item) of all occurrences of the windows in the shards.  Spans of different pieces or
    blocks may overlap."""
    spark = index.sparkSession
    windows = written(windows, "windows")
    blocks = -(-windows.count() // block)
    path = new_path(spark, "occurrences")
    shards = index.select("fm", "piece_row", "piece_at")
    schema = "row long, a long, b long, item string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size, bound, item_of, items = shipped.value
        need = np.diff(bound)

        def rows_of(row: np.ndarray, a: np.ndarray | None, b: np.ndarray | None, item: np.ndarray | None) -> pa.RecordBatch:
            n = len(row)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(row), none if a is None else pa.array(a), none if b is None else pa.array(b),
                                               pa.nulls(n, pa.string()) if item is None else items.take(pa.array(item))], ["row", "a", "b", "item"])

        for batch in batches:
            for k in range(batch.num_rows):
                f = fm_index.from_bytes(batch.column("fm")[k].as_py())
                piece_row, piece_at = (batch.column(c)[k].values.to_numpy() for c in ("piece_row", "piece_at"))
                for w, place in _search(f, words, size):
                    p = np.searchsorted(f.starts, place, side="right") - 1
                    row, a = piece_row[p], piece_at[p] + place - f.starts[p]
                    yield rows_of(*_merged(row, a, a + size[w]), None)
                    order = np.lexsort((w, row))
                    row, w = row[order], w[order]
                    once = np.ones(len(row), bool)
                    once[1:] = (row[1:] != row[:-1]) | (w[1:] != w[:-1])
                    row, w = row[once], w[once]
                    total = np.r_[0, np.cumsum(need[w])]
                    for at in range(0, int(total[-1]), CHUNK):
                        j = np.arange(at, min(at + CHUNK, int(total[-1])))
                        i = np.searchsorted(total, j, side="right") - 1
                        pair = np.unique(np.stack([row[i], item_of[bound[w[i]] + j - total[i]]], 1), axis=0)
                        yield rows_of(pair[:, 0], None, None, pair[:, 1])

    for b in range(blocks):
        some = windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b).toArrow()
        raw = np.frombuffer(b"".join(some.column("words").to_pylist()), "<u8").reshape(-1, width)
        once, of = np.unique(raw, axis=0, return_inverse=True)
        order = np.argsort(of, kind="stable")
        size = np.zeros(len(once), np.int32)
        size[of] = some.column("size").to_numpy()
        coded = some.column("item").combine_chunks().dictionary_encode()
        shipped = spark.sparkContext.broadcast((once, size, np.r_[0, np.cumsum(np.bincount(of, minlength=len(once)))],
                                                coded.indices.to_numpy()[order].astype(np.int64), coded.dictionary))
        shards.mapInArrow(search, schema).write.mode("append").parquet(path)
        shipped.destroy()
    found = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    return found.filter("a is not null").select("row", "a", "b"), found.filter("a is null").select("row", "item").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               width: int = WIDTH, shard_words: int = SHARD_WORDS, block: int = BLOCK) -> DataFrame:
    """`key`, n_words, n_hit, spans (array of first word and word behind the last, in order and apart) and items (sorted strings)
    of every row of docs.

    A window is `width` words of an item in a row, or all of a shorter item.  Null and empty texts have no words; an item
    without words has no windows.  Rows that share a key, repeated rows too, are judged each.  Items that share an id, or have
    none (listed as an empty string), count as one.  Other columns are ignored.  No items: nothing is hit.  No documents: no
    rows.  Two different words take the same hash with a chance of 2**-64."""
    index = build_index(docs, key, text, width, shard_words)
    spans, leaked = search_index(index, windows_of(items, item, item_text, width), width, block)
    reach = F.max("b").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    islands = opens.withColumn("island", F.sum("new").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("row").agg(
        F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    named = leaked.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = index.select(F.inline(F.arrays_zip(F.col("doc_row").alias("row"), F.col("doc_key").alias("key"), F.col("doc_words").alias("n_words"))))
    return rows.join(merged, "row", "left").join(named, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_spans(rows: DataFrame, text: str = "text", spans: str = "spans", out: str = "kept_text") -> DataFrame:
    """rows with `out`: the text without the words of its spans and what stands between them.  A null text stays null."""
    names = rows.columns

    def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, data, offsets in text_blocks(batch.column(text)):
                start, end, row = word_places(data, offsets)
                begin = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    at, parts = int(offsets[i]), []
                    for s in batch.column(spans)[a + i].as_py() or []:
                        parts.append(data[at: start[begin[i] + s["a"]]].tobytes())
                        at = int(end[begin[i] + s["b"] - 1])
                    parts.append(data[at: offsets[i + 1]].tobytes())
                    kept.append(b"".join(parts).decode() if batch.column(text)[a + i].is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(scrub, rows.select(*names, F.lit(None).cast("string").alias(out)).schema)
