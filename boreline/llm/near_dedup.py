"""Near-duplicate documents by HyperMinHash sketches.

1. One pass over the texts gives each document the digest of its shingle set and its sketch; documents with equal sets
   form a class, named by its smallest key, and only classes go on.
2. Sketches are banded.  Classes that share a band are candidates: all pairs of a bucket of up to SMALL classes, and in a
   larger one every class with the smallest.  Pairs whose sizes or estimated similarity rule a link out are dropped.
3. Candidates are confirmed on their full shingle sets, first each class with its most similar candidate, then what is
   not connected yet.
4. In larger buckets, pairs of classes that are still not connected are estimated and confirmed in tiles of TILE x TILE
   classes, each pair in the first of the bands it shares; only links leave a task.  So nothing is lost to the size of a
   bucket, and no pair without a link is a row.
5. Connected components of the confirmed links.

Besides a miss of all bands (chance 1e-6 at similarity 0.75 exactly, less above) every link between different texts
takes effect."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.llm.blocks import shingle_sets, text_blocks
from boreline.llm.graph import components
from boreline.llm.hyperminhash import BAND_ROWS, BANDS, BUCKETS, band_keys, estimate, sketches
from boreline.llm.shared import split_by_keys, written

WORDS = 5
SIMILARITY = 75
#: Pairs are confirmed from this estimate on; at similarity 0.75 the estimate is below it by chance less than once in 1e12.
ESTIMATE = 0.55
SMALL = 32
TILE = 1024
ROWS = 4096


def _sketch(docs: DataFrame) -> DataFrame:
    """key, text -> key, n (size of the shingle set), shingles (its digest), sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("text")):
                h, bound = shingle_sets(data, offsets, WORDS)
                regs = sketches(h, bound)
                n = np.diff(bound)
                ids = [hashlib.blake2b(h[a:b].data, digest_size=16).digest() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), pa.array(n.astype(np.int64)), pa.array(ids, pa.binary()),
                                                  pa.array([r.tobytes() for r in regs], pa.binary())], ["key", "n", "shingles", "sketch"])

    return docs.mapInArrow(make, "key long, n long, shingles binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """node, sketch -> band (key), node."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = band_keys(_stacked(part.column("sketch")))
                nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], ["band", "node"])

    return classes.select("node", "sketch").mapInArrow(make, "band long, node long")


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _size_ok(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b), and band, node of the classes in buckets of more than SMALL."""
    # classes of one or two shingles have links to equal sets only
    bands = _bands(classes.filter(F.col("n") > 2))
    shared = written(bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("m"))
                     .filter(F.col("low") < F.col("high")), "bands")
    members = written(bands.join(shared.filter(F.col("m") > 2).select("band", "low", "m"), "band"), "members")
    two = shared.filter(F.col("m") == 2).select(F.col("low").alias("a"), F.col("high").alias("b"))
    lists = members.filter(F.col("m") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    pairs = lists.select("nodes", F.posexplode("nodes").alias("i", "a")) \
        .select("a", F.explode(F.slice("nodes", F.col("i") + 2, SMALL)).alias("b"))
    large = members.filter(F.col("m") > SMALL)
    stars = large.filter(F.col("node") != F.col("low")).select(F.col("low").alias("a"), F.col("node").alias("b"))
    return two.union(pairs).union(stars).distinct(), large.select("band", "node")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, likeness of the pairs that sizes and estimates leave."""
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b").filter(_size_ok(F.col("n_a"), F.col("n_b"))).select("a", "b", "s_a", "s_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                e = estimate(_stacked(part.column("s_a")), _stacked(part.column("s_b")))
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(e)], ["a", "b", "likeness"])
                yield out.filter(pa.array(e >= ESTIMATE))

    return both.mapInArrow(judge, "a long, b long, likeness double")


def _shingles(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (their hashes, binary) of the documents that name the wanted classes."""
    some, _ = split_by_keys(docs, "key", nodes, "node")
    held = some.join(nodes.select(F.col("node").alias("key")), "key")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("text")):
                h, bound = shingle_sets(data, offsets, WORDS)
                sets = [h[a:b].tobytes() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), pa.array(sets, pa.binary())], ["node", "shingles"])

    return held.mapInArrow(make, "node long, shingles binary")


def _linked(x: bytes, y: bytes) -> bool:
    """Whether 100 * intersection >= SIMILARITY * union of two full sets."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= SIMILARITY * (len(both) - same)


def _confirmed(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    one = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    two = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(x.as_py(), y.as_py()) for x, y in zip(batch.column("s_a"), batch.column("s_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(check, "a long, b long")


def _unconnected(rows: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """rows with group_<column> for node columns; a node without links is its own group."""
    for c in columns:
        rows = rows.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"group_{c}")), c, "left") \
            .withColumn(f"group_{c}", F.coalesce(f"group_{c}", c))
    return rows


def _mixed(large: DataFrame, groups: DataFrame) -> DataFrame:
    """band, node, group_node, tiles of the large buckets whose classes are not all connected."""
    rows = _unconnected(large, groups, "node")
    mixed = rows.groupBy("band").agg(F.min("group_node").alias("x"), F.max("group_node").alias("y"), F.count(F.lit(1)).alias("m")) \
        .filter(F.col("x") != F.col("y")).select("band", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    return rows.join(mixed, "band")


def _tile_links(band: int, left: np.ndarray, right: np.ndarray, node: np.ndarray, group: np.ndarray, n: np.ndarray, regs: np.ndarray,
                sets: list[bytes]) -> list[tuple[int, int]]:
    """Links between left and right rows of different groups whose first shared band is this one.  Rows that become
    connected here are not compared again."""
    place = int(np.flatnonzero(band_keys(regs[:1])[0].view(np.int64) == band)[0])
    root = {g: g for g in set(group.tolist())}

    def find(g: int) -> int:
        while root[g] != g:
            g = root[g]
        return g

    out = []
    for k in left:
        y = right[(group[right] != group[k]) & (100 * np.minimum(n[right], n[k]) >= SIMILARITY * np.maximum(n[right], n[k]))]
        e = estimate(regs[k][None, :], regs[y])
        y, e = y[e >= ESTIMATE], e[e >= ESTIMATE]
        same = (regs[y][:, : BANDS * BAND_ROWS] == regs[k][: BANDS * BAND_ROWS]).reshape(len(y), BANDS, BAND_ROWS).all(axis=2)
        ok = same.argmax(axis=1) == place if len(y) else np.zeros(0, bool)
        y, e = y[ok], e[ok]
        for i in y[np.argsort(-e, kind="stable")].tolist():
            a, b = find(int(group[k])), find(int(group[i]))
            if a != b and _linked(sets[k], sets[i]):
                root[max(a, b)] = min(a, b)
                out.append((int(min(node[k], node[i])), int(max(node[k], node[i]))))
    return out


def _in_large(mixed: DataFrame, classes: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links (a, b) between groups inside large buckets."""
    rows = mixed.join(classes.select("node", "n", "sketch"), "node").join(shingles, "node") \
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = rows.select("*", other).select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node",
                                          "group_node", "n", "sketch", "shingles")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "tile", "node")

    def compare(held: list) -> pa.RecordBatch:
        tile, node, group, n = (np.array([r[k] for r in held], np.int64) for k in (3, 4, 5, 6))
        regs = np.frombuffer(b"".join(r[7] for r in held), np.uint8).reshape(-1, BUCKETS)
        left, right = np.flatnonzero(tile == held[0][1]), np.flatnonzero(tile == held[0][2])
        links = _tile_links(held[0][0], left, right, node, group, n, regs, [r[8] for r in held])
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "tile", "node", "group_node", "n", "sketch", "shingles"))):
                if held and held[0][:3] != r[:3]:
                    yield compare(held)
                    held = []
                held.append(r)
        if held:
            yield compare(held)

    return dealt.mapInArrow(search, "a long, b long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles, component_id, kept for every row.

    A document's set holds the distinct WORDS-word shingles of its lower-cased (A-Z) words; with fewer words its whole
    sequence; none without words.  Documents with 100 * intersection >= SIMILARITY * union are linked; component_id is
    the smallest key in reach, kept says whether it is the document's own.  Null or empty texts are linked to nothing.
    Rows that share a key count as one document in links and all get its component.  Null keys: component_id null, kept.
    An empty table gives an empty result.  Other columns are ignored."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    own = written(_sketch(rows), "sketches")
    sound = own.filter(F.col("key").isNotNull() & (F.col("n") > 0))
    # equal sets meet in the map tasks first
    classes = written(sound.groupBy("shingles").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    pairs, large = _buckets(classes)
    pairs = written(_estimated(pairs, classes), "candidates")
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    shingles = written(_shingles(rows, nodes), "shingles")
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "likeness").union(pairs.select("b", "a", "likeness"))
    best = ends.groupBy("x").agg(F.max(F.struct("likeness", F.negative("y").alias("y"))).alias("p")).select("x", F.negative(F.col("p.y")).alias("y"))
    first = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = written(_confirmed(first, shingles), "links")
    groups = written(components(links), "groups")
    rest = _unconnected(pairs.join(first, ["a", "b"], "left_anti"), groups, "a", "b").filter(F.col("group_a") != F.col("group_b"))
    links = links.union(written(_confirmed(rest, shingles), "links"))
    groups = written(components(links), "groups")
    mixed = written(_mixed(large, groups), "mixed")
    new = written(mixed.select("node").distinct().join(nodes, "node", "left_anti"), "nodes")
    links = links.union(written(_in_large(mixed, classes, shingles.union(written(_shingles(rows, new), "shingles"))), "links"))
    # documents of a class hang on its node; rows of one key hang together
    same = sound.select("shingles", "key").join(classes.select("shingles", "node"), "shingles").select(F.col("key").alias("a"), F.col("node").alias("b"))
    groups = components(links.union(same.filter(F.col("a") != F.col("b"))))
    found = own.join(groups.withColumnRenamed("node", "key"), "key", "left")
    component = F.coalesce("component", "key")
    return found.select(F.col("key").cast(kind).alias(key), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"),
                        (F.col("key").isNull() | (component == F.col("key"))).alias("kept"))
