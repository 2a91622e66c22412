"""Documents whose SpotSigs fingerprints are alike, without comparing all pairs.

1. A pass counts signatures in CELLS cells by a hash; signatures are put in one order, those of rare cells first.
2. Of a set of n signatures the first n - ceil(at_least * n) + 1 in that order are its join keys: two sets of the stated
   similarity surely share one.  The other part of a key is a partition of set lengths; every set goes to its own and the
   next one, so sets whose lengths rule the similarity out never meet from two partitions on.
3. A pair is a candidate if its lengths and the places of the shared signature leave the similarity possible.  In a key of
   up to SMALL sets all pairs are looked at, in a larger one first every set with the smallest.
4. Candidates are confirmed by `spotsigs.jaccard` with its pruning.
5. Larger keys whose sets are not all connected are compared whole, in tiles of TILE x TILE sets dealt over the tasks; only
   links leave a task.  So no link is lost to a very common signature, and no pair without a link is a row.
6. Connected components of the links.

Sets go by 64 bits of their digest; two different ones of ten million share it with a chance of 3e-6."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.llm.graph import components
from boreline.llm.shared import split_by_keys, written
from boreline.llm.spotsigs import compare_with_edits, jaccard, node_of, signature_sets

AT_LEAST = 0.75
CELLS = 16
#: Sets that a task remembers in order to drop their copies.
SEEN = 1 << 18
SMALL = 32
TILE = 1024
ROWS = 256


def _cell(s: np.ndarray) -> np.ndarray:
    return (s * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELLS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, signature_sets(part.column("text").to_pylist())


def _prints(rows: DataFrame) -> DataFrame:
    """key, text -> key, node."""
    kind = rows.schema["key"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([node_of(s) for s in sets], pa.int64())], ["key", "node"])

    return rows.mapInArrow(make, f"key {kind}, node long")


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How many signatures of all documents fall into every cell."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int64)
        for _, sets in _sets(batches):
            total += np.bincount(_cell(np.concatenate(sets)), minlength=1 << CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "c"])

    out = np.zeros(1 << CELLS, np.uint32)
    for r in rows.select("text").mapInArrow(make, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toLocalIterator():
        out[r["cell"]] = min(r["c"], (1 << 32) - 1)
    return out


def begins_of_lengths(least: Fraction, top: int = 1 << 31) -> np.ndarray:
    """First length of every partition: lengths of the stated similarity are in the same partition or in neighbours."""
    out = [1]
    while out[-1] < top:
        out.append(math.floor(out[-1] / least) + 1)
    return np.array(out, np.int64)


def _keys(rows: DataFrame, least: Fraction, often: np.ndarray) -> DataFrame:
    """text -> signature, slot (partition of lengths), node, n, rest (signatures of the set after this one)."""
    begin = begins_of_lengths(least)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in sets:
                n, node = len(s), node_of(s)
                if not n or node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                order = np.sort((often[_cell(s)].astype(np.uint64) << np.uint64(32)) | s)
                p = n - math.ceil(least * n) + 1
                for col, x in zip(cols, ((order[:p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.full(p, np.searchsorted(begin, n, side="right")),
                                         np.full(p, node), np.full(p, n), n - 1 - np.arange(p))):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int64, np.int32, np.int32))],
                                                 ["signature", "slot", "node", "n", "rest"])

    return rows.select("text").mapInArrow(make, "signature int, slot int, node long, n int, rest int")


def _members(keys: DataFrame) -> DataFrame:
    """bucket (signature and slot), node, n, rest, low, m of keys with at least two different sets: low is the smallest of m
    sets.  Sets are put into their second slot after the one shuffle by signatures."""
    dealt = keys.select(F.col("signature"), F.col("node"), F.struct("slot", "n", "rest").alias("x")).repartition("signature")
    once = dealt.groupBy("signature", "node").agg(F.min("x").alias("x"))
    one = once.select("signature", F.explode(F.array(F.col("x.slot"), F.col("x.slot") + 1)).alias("slot"), "node", F.col("x.n").cast("long").alias("n"),
                      F.col("x.rest").cast("long").alias("rest"))
    many = one.groupBy("signature", "slot").agg(F.min(F.struct("node", "n", "rest")).alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    bucket = F.shiftleft(F.col("signature").cast("long"), 8) + F.col("slot")
    return one.join(many, ["signature", "slot"]).select(bucket.alias("bucket"), "node", "n", "rest", "low", "m")


def _possible(least: Fraction, n_a: Column, rest_a: Column, n_b: Column, rest_b: Column) -> Column:
    """Whether lengths and places leave the similarity possible, if this is the first signature that both sets have."""
    num, den = least.numerator, least.denominator
    return (den * F.least(n_a, n_b) >= num * F.greatest(n_a, n_b)) & ((num + den) * (1 + F.least(rest_a, rest_b)) >= num * (n_a + n_b))


def _candidates(members: DataFrame, least: Fraction) -> DataFrame:
    lists = members.filter(F.col("m") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n", "rest"))).alias("s"))
    pairs = lists.select("s", F.posexplode("s").alias("i", "x")).select("x", F.explode(F.slice("s", F.col("i") + 2, SMALL)).alias("y"))
    stars = members.filter((F.col("m") > SMALL) & (F.col("node") != F.col("low.node"))).select(F.col("low").alias("x"), F.struct("node", "n", "rest").alias("y"))
    ok = _possible(least, F.col("x.n"), F.col("x.rest"), F.col("y.n"), F.col("y.rest"))
    return pairs.union(stars).filter(ok).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _signatures(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, signatures (binary) of the wanted sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["node", "signatures"])

    some, _ = split_by_keys(rows.select("text").mapInArrow(make, "node long, signatures binary"), "node", nodes, "node")
    return some.join(nodes, "node").dropDuplicates(["node"])


def _alike(x: bytes, y: bytes, least: Fraction) -> bool:
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    return jaccard(a, b, float(least) * (1 - 1e-12)) >= float(least)  # a product may round up to above a length


def _confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("signatures").alias("s_a"))
    two = sets.select(F.col("node").alias("b"), F.col("signatures").alias("s_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(x.as_py(), y.as_py(), least) for x, y in zip(batch.column("s_a"), batch.column("s_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def _in_large(members: DataFrame, groups: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Links between groups inside keys of more than SMALL sets that are not all connected."""
    num, den = least.numerator, least.denominator
    rows = members.filter(F.col("m") > SMALL).select("bucket", "node", "n", "rest", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    rows = rows.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    mixed = rows.groupBy("bucket").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("bucket")
    rows = rows.join(mixed, "bucket").join(sets, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    names = ["bucket", "i", "j", "tile", "node", "n", "rest", "group", "signatures"]
    dealt = rows.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).select(*names) \
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "tile", "node")

    def compare(held: list) -> pa.RecordBatch:
        tile, node, n, rest, group = (np.array([r[k] for r in held], np.int64) for k in (3, 4, 5, 6, 7))
        root = {g: g for g in group.tolist()}

        def find(g: int) -> int:
            while root[g] != g:
                g = root[g]
            return g

        right, links = np.flatnonzero(tile == held[0][2]), []
        for k in np.flatnonzero(tile == held[0][1]).tolist():
            own = find(int(group[k]))
            y = right[(den * np.minimum(n[right], n[k]) >= num * np.maximum(n[right], n[k]))
                      & ((num + den) * (1 + np.minimum(rest[right], rest[k])) >= num * (n[right] + n[k]))]
            for i in y.tolist():
                other = find(int(group[i]))
                if other != own and _alike(held[k][8], held[i][8], least):
                    root[max(own, other)] = own = min(own, other)
                    links.append((int(node[k]), int(node[i])))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and held[0][:3] != r[:3]:
                    yield compare(held)
                    held = []
                held.append(r)
        if held:
            yield compare(held)

    return dealt.mapInArrow(search, "a long, b long")


def match_groups(rows: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """key, node, group_key, n_group of every row of key, text (not null) that is alike to another row.

    Rows are alike from a Jaccard similarity of their sets of signatures of `at_least` (above 0) on; two empty sets are alike.
    A group holds all rows in reach of each other; group_key is its smallest key that is not null, n_group its rows."""
    least = Fraction(str(at_least))
    own = written(_prints(rows), "prints")
    members = written(_members(_keys(rows, least, _frequencies(rows))), "members")
    pairs = written(_candidates(members, least), "candidates")
    large = members.filter(F.col("m") > SMALL).select("node")
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large).distinct(), "nodes")
    sets = written(_signatures(rows, nodes), "signatures")
    links = written(_confirmed(pairs, sets, least), "links")
    links = links.union(written(_in_large(members, written(components(links), "groups"), sets, least), "links"))
    found = own.join(components(links), "node", "left").withColumn("group", F.coalesce("component", "node"))
    groups = found.groupBy("group").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("n_group")).filter("n_group > 1")
    return written(found.join(groups, "group").select("key", "node", "group_key", "n_group").distinct(), "matches")


def compare_and_match(docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = AT_LEAST) -> DataFrame:
    """The columns of `spotsigs.compare_with_edits`, with group_key and n_group of `match_groups`; a row that is alike to no
    other has its own key and 1."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return compare_with_edits(docs, key, text, match_groups(rows, at_least))
