"""Exact removal of repeated 100-byte passages by a logarithmic family of suffix arrays.

Documents come in batches in the order of their keys.  A batch's suffixes at anchors (see `suffixes`) are sorted by the
key of their first bytes: its suffix array, in hash order, as only equal suffixes must meet.  It is merge-joined with
itself and with every level of the index, which gives the anchors that occur before; then it becomes a level, and
levels of equal size merge.  What may match is a fraction of the texts: a second pass brings the runs at repeated
anchors together with their bytes, and there every window is compared.

A passage that HOT or more runs share does not meet in one task: its windows are dealt out by their own hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.llm.blocks import U64, mix, prefix_hash, span_hash, text_blocks
from boreline.llm.shared import split_by_keys, written
from boreline.llm.suffixes import PIECE, WINDOW, pieces, runs

#: Shares of the documents in each batch of a whole table: the second level of a batch merges with the first, so the third
#: and fourth batch meet merged levels.
BATCHES = (0.25, 0.25, 0.25, 0.25)
#: Bits of the map of repeated anchors that every task has: 8 MB at most, whatever the input.  A set bit lets a run pass to
#: the comparison, so a full map costs shuffles, not results.
MAP_BITS = 1 << 26
HOT = 50_000
#: Bytes of rows that are compared at once, besides one anchor's.
CHUNK = 1 << 20


class SuffixIndex:
    """Levels of sorted suffix keys.  `add` returns the keys that are repeated within a batch or in the levels."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, array: DataFrame, keep: bool = True) -> DataFrame:
        """array: key, c (times in the batch).  With keep, the array is written and becomes a level."""
        if keep:
            array = written(array.sortWithinPartitions("key"), "level")
        found = array.withColumn("old", F.lit(0))
        for _, level in self.levels:
            known = level.select("key", F.col("c").alias("more"))
            found = found.join(known, "key", "left").withColumn("old", F.col("old") + F.coalesce("more", F.lit(0))).drop("more")
        found = written(found.select("key", (F.col("c") + F.col("old")).alias("c")).filter(F.col("c") > 1), "repeated")
        if keep:
            self.levels.append((1, array))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (n, one), (_, two) = self.levels.pop(), self.levels.pop()
                both = one.union(two).groupBy("key").agg(F.sum("c").alias("c")).sortWithinPartitions("key")
                self.levels.append((2 * n, written(both, "level")))
        return found


def _block_runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """bytes, place of each run's first byte in them, anchor key, key of all bytes, document, start, windows."""
    for first, last, data, offsets in text_blocks(batch.column("text"), PIECE):
        docs = batch.column("key").slice(first, last - first).to_numpy(zero_copy_only=False)
        for row, at, part, bounds in pieces(data, offsets):
            key, whole, r, start, n = runs(part, bounds)
            if len(key):
                yield part, bounds[r] + start, key, whole, docs[row + r], start + at, n


def suffix_array(docs: DataFrame) -> DataFrame:
    """key, text -> key (of the suffix at an anchor), c; equal keys of a block of texts are counted before the shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, key, *_ in _block_runs(batch):
                k, c = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["key", "c"])

    return docs.mapInArrow(make, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _bit_map(keys: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits with a bit for every key."""
    place = F.pmod(F.col("key"), F.lit(MAP_BITS)) + 1
    rows = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")) \
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((max(MAP_BITS >> 15, 1), 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _in_map(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = np.mod(key.view(np.int64), MAP_BITS)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _first_of(order: tuple[np.ndarray, ...], *groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by groups and then order; returns the permutation and, in it, whether the row is later than its group's first."""
    o = np.lexsort(order[::-1] + groups[::-1])
    new = np.zeros(len(o), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[o][1:] != g[o][:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    later = np.zeros(len(o), bool)
    for x in order:
        later |= x[o] != x[o][begin]
    return o, later


def _marked(docs: DataFrame, repeated: DataFrame, hot: bool) -> DataFrame:
    """kind 1: key, doc, start, n, bytes of the runs at repeated anchors; kind 0: doc, start, n of runs whose bytes stand
    earlier in the same block, which are decided."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bit_map(repeated))
    burning = spark.sparkContext.broadcast(_bit_map(repeated.filter(F.col("c") >= HOT))) if hot else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, place, key, whole, doc, start, n in _block_runs(batch):
                ok = _in_map(bits.value, key)
                if burning is not None:
                    ok &= ~_in_map(burning.value, key)
                place, key, whole, doc, start, n = (x[ok] for x in (place, key, whole, doc, start, n))
                o, later = _first_of((doc, start), key, whole)
                done, open_ = o[later], o[~later]
                # what is decided needs no meeting: joined runs, dealt by their documents
                doc0, start0, n0 = _joined(doc[done], start[done], n[done])
                size = np.concatenate([n[open_] + WINDOW - 1, np.zeros(len(doc0), np.int64)])
                offsets = np.zeros(len(size) + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                at = np.repeat(place[open_] - offsets[: len(open_)], size[: len(open_)]) + np.arange(offsets[-1])
                texts = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
                both = [np.concatenate(x) for x in ((key[open_], mix(doc0.view(U64))), (doc[open_], doc0), (start[open_], start0), (n[open_], n0))]
                kind = np.repeat(np.array([1, 0], np.int8), [len(open_), len(doc0)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(both[0].view(np.int64)), *map(pa.array, both[1:]), texts],
                                                 ["kind", "key", "doc", "start", "n", "bytes"])

    return docs.mapInArrow(make, "kind byte, key long, doc long, start long, n long, bytes binary")


def _later_windows(key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, texts: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """(doc, start, n) of the windows that stand earlier in another row; rows with equal keys are all here."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    prefix = prefix_hash(data)
    whole = span_hash(prefix, offsets[:-1], offsets[1:])
    o, later = _first_of((doc, start), key, whole)
    out = [(doc[o[later]], start[o[later]], n[o[later]])]
    # of each content the first run; those alone with their anchor have no repeated window
    one = o[~later]
    same = np.zeros(len(one), bool)
    same[1:] = key[one][1:] == key[one][:-1]
    many = same.copy()
    many[:-1] |= same[1:]
    one = one[many]
    if len(one):
        count = n[one]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(offsets[one], count) + step
        w = span_hash(prefix, at, at + WINDOW)
        d, s, k = np.repeat(doc[one], count), np.repeat(start[one], count) + step, np.repeat(key[one], count)
        o, later = _first_of((d, s), k, w)
        hit = o[later]
        out.append((d[hit], s[hit], np.ones(len(hit), np.int64)))
    return out


def _joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that touch become one."""
    o = np.lexsort((start, doc))
    doc, start, n = doc[o], start[o], n[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    size = np.add.reduceat(n, begin) if len(begin) else n
    return doc[begin], start[begin], size


def _resolved(marked: DataFrame) -> DataFrame:
    """doc, start, n: runs of windows that stand earlier."""
    dealt = marked.repartition("key").sortWithinPartitions("key")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(table: pa.Table) -> pa.RecordBatch:
            kind, key, doc, start, n = (table.column(c).to_numpy() for c in ("kind", "key", "doc", "start", "n"))
            out = [(doc[kind == 0], start[kind == 0], n[kind == 0])]
            one = table.filter(pa.array(kind == 1))
            if one.num_rows:
                texts = one.column("bytes").combine_chunks()
                texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
                ok = kind == 1
                out += _later_windows(key[ok], doc[ok], start[ok], n[ok], texts)
            out = _joined(*(np.concatenate(x) for x in zip(*out)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "start", "n"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield finish(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield finish(pa.Table.from_batches(held))

    return dealt.mapInArrow(resolve, "doc long, start long, n long")


def _hot_windows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc, start, n of later windows at anchors of HOT or more runs, by the windows' own hashes (128 bits)."""
    burning = docs.sparkSession.sparkContext.broadcast(_bit_map(repeated.filter(F.col("c") >= HOT)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, place, key, _, doc, start, n in _block_runs(batch):
                ok = _in_map(burning.value, key)
                place, doc, start, n = place[ok], doc[ok], start[ok], n[ok]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(place, n) + step
                one = span_hash(prefix_hash(data), at, at + WINDOW)
                two = span_hash(prefix_hash(data ^ np.uint8(0x55)), at, at + WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.repeat(doc, n)),
                                                  pa.array(np.repeat(start, n) + step)], ["one", "two", "doc", "start"])

    windows = docs.mapInArrow(make, "one long, two long, doc long, start long")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    return windows.join(first, ["one", "two"]).filter(F.struct("doc", "start") > F.col("first")).select("doc", "start", F.lit(1).cast("long").alias("n"))


def _batches(rows: DataFrame) -> list[DataFrame]:
    cuts = np.cumsum(BATCHES)[:-1].tolist()
    found = rows.approxQuantile("key", cuts, 0.01) if cuts else []
    edges = [None, *sorted(set(found)), None]
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        part = rows
        if low is not None:
            part = part.filter(F.col("key") > low)
        if high is not None:
            part = part.filter(F.col("key") <= high)
        out.append(part)
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc, start, n: starts (in bytes) of the 100-byte windows that also start earlier, as runs of n; docs: key, text."""
    index, batches = SuffixIndex(), _batches(docs)
    found = [index.add(suffix_array(b), keep=i + 1 < len(batches)) for i, b in enumerate(batches)]
    repeated = found[0]
    for f in found[1:]:
        repeated = repeated.union(f)
    repeated = repeated.groupBy("key").agg(F.max("c").alias("c"))
    hot = repeated.filter(F.col("c") >= HOT).head(1) != []
    out = _resolved(_marked(docs, repeated, hot))
    return out.union(_hot_windows(docs, repeated)) if hot else out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`key`, n_bytes, n_removed, n_spans, kept_sha256 for every row.  With `carry`, a list of further columns to keep, also
    these and kept_text, the remaining bytes as a string; characters of which only a part remains are left out.

    A byte goes when a 100-byte string over it also starts earlier: in a document with a smaller key, or before in the
    same document.  Matches never cross documents and are judged on the input.  Null and empty texts, and those of less
    than 100 bytes, keep all.  Rows with a null key are left alone.  Repeated rows do not count against each other; rows
    that share a key but not a text share what is found for any of them.  An empty table gives an empty result.  Other
    columns are ignored."""
    more = [] if carry is None else carry
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"more_{c}") for c in more])
    spans = written(repeated_runs(rows.filter(F.col("key").isNotNull()).select("key", "text")), "spans")
    some, rest = split_by_keys(rows, "key", spans, "doc")
    lists = spans.groupBy(F.col("doc").alias("key")).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    touched = some.join(lists, "key", "left")
    nothing = F.lit(0).cast("long")
    carried = [f"more_{c}" for c in more]
    whole = rest.select(
        "key", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").alias("kept_text")] * (carry is not None), *carried)
    schema, with_text = whole.schema, carry is not None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ns = batch.column("starts"), batch.column("ns")
            size, removed, spans_, digest, kept = [], [], [], [], []
            for first, last, data, offsets in text_blocks(batch.column("text")):
                for i in range(first, last):
                    own = data[offsets[i - first]: offsets[i - first + 1]]
                    size.append(len(own))
                    a, n = starts[i].values, ns[i].values
                    if a is None or not len(a):
                        removed.append(0)
                        spans_.append(0)
                    else:
                        a, n = a.to_numpy(), n.to_numpy()
                        size_ = len(own) + 1
                        change = np.bincount(np.minimum(a, len(own)), minlength=size_) - np.bincount(np.minimum(a + n + WINDOW - 1, len(own)), minlength=size_)
                        gone = np.cumsum(change)[: len(own)] > 0
                        removed.append(int(gone.sum()))
                        spans_.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                        own = own[~gone]
                    own = own.tobytes()
                    digest.append(hashlib.sha256(own).hexdigest())
                    if with_text:
                        kept.append(own.decode("utf-8", "ignore"))
            cols = [batch.column("key"), *(pa.array(x, pa.int64()) for x in (size, removed, spans_)), pa.array(digest, pa.string())]
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text + [batch.column(c) for c in carried],
                                             names + ["kept_text"] * with_text + carried)

    out = touched.select("key", "text", "starts", "ns", *carried).mapInArrow(cut, schema).union(whole)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnsRenamed({"key": key, **dict(zip(carried, more))})
