"""SpotSigs fingerprints: chains of content words that follow common words.

At every anchor, a common word, a signature is the anchor with the next CHAIN content words after it.  The fingerprint
of a text is the set of its signatures as 32-bit hashes; two fingerprints are as alike as the Jaccard similarity of
their sets, which is not computed where their lengths alone rule out the similarity asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.llm.blocks import LOWER, U64, mix, prefix_hash, span_hash, text_blocks, word_spans
from boreline.llm.ranges import as_number, begins, search

#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with you "
    "als am auch auf das dem den der des die ein eine einer er es für im in ist mit nicht sich sie und von war zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con de del el en es esta la las lo los más no para pero por que se su un una y"
).split()
CHAIN = 2
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?()[]\"'")] = True
ROWS = 256


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[data]), start, end)


def _anchor_hashes() -> np.ndarray:
    words = [w.encode() for w in dict.fromkeys(ANCHORS)]
    end = np.cumsum([len(w) for w in words])
    return np.sort(_hash_words(np.frombuffer(b"".join(words), np.uint8), np.r_[0, end[:-1]], end))


_ANCHOR = _anchor_hashes()


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of every text.  A text with words but no signature has one, of all its words; a
    text without words but not empty has one, of its bytes; an empty text has none."""
    out: list[np.ndarray] = []
    for first, last, data, offsets in text_blocks(pa.array(texts, pa.string())):
        start, end, row = word_spans(data, offsets)
        for _ in range(3):  # marks at the end of a word are no part of it, unless nothing else is
            end = end - ((end - start > 1) & _TRIM[data[end - 1]]) if len(end) else end
        h = _hash_words(data, start, end)
        bound = np.searchsorted(row, np.arange(last - first + 1))
        anchor = _ANCHOR[np.searchsorted(_ANCHOR, h).clip(0, len(_ANCHOR) - 1)] == h
        at, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        nxt = np.searchsorted(content, at)
        ok = nxt + CHAIN <= len(content)
        at, nxt = at[ok], nxt[ok]
        ok = row[content[nxt + CHAIN - 1]] == row[at] if len(at) else np.zeros(0, bool)
        at, nxt = at[ok], nxt[ok]
        sig = h[at]
        for j in range(CHAIN):
            sig = mix(sig ^ h[content[nxt + j]])
        sig = (sig >> U64(32)).astype(np.uint32)
        edge = np.searchsorted(row[at], np.arange(last - first + 1))
        for i in range(last - first):
            own = sig[edge[i]: edge[i + 1]]
            if not len(own) and offsets[i + 1] > offsets[i]:
                words = h[bound[i]: bound[i + 1]]
                whole = words.tobytes() if len(words) else data[offsets[i]: offsets[i + 1]].tobytes()
                own = np.frombuffer(hashlib.blake2b(whole, digest_size=4).digest(), "<u4").astype(np.uint32)
            out.append(np.unique(own))
    return out


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Similarity of two sorted sets; 0 without a comparison where their lengths rule out `at_least`.  Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(a) + len(b) - same)


def node_of(s: np.ndarray) -> int:
    """64 bits of the digest of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def as_text(s: np.ndarray) -> str:
    """A fingerprint: its signatures in order, eight hexadecimal digits each."""
    return s.astype(">u4").tobytes().hex()


def _with_successors(docs: DataFrame) -> tuple[DataFrame, list[float]]:
    """key, text -> part, border, key, text, to be dealt by part: ranges of keys of about equal numbers of rows, each closed by
    a border row, the first row of the next range (of the first range after the last); and the first keys of the ranges."""
    begin = begins(docs, "key")
    if not begin:
        return docs.select(F.lit(0).alias("part"), F.lit(False).alias("border"), "key", "text"), begin
    k, last = as_number(F.col("key")), len(begin) - 1
    part = search(k, begin[1:])
    before = F.when(part == 0, F.lit(last)).otherwise(part - 1)
    own = F.struct(part.alias("part"), F.lit(False).alias("border"))
    is_first = k == F.element_at(F.array(*[F.lit(b) for b in begin]), part + 1)
    places = F.when(is_first, F.array(own, F.struct(before.alias("part"), F.lit(True).alias("border")))).otherwise(F.array(own))
    return docs.select(F.explode(places).alias("p"), "key", "text").select("p.part", "p.border", "key", "text"), begin


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """`key`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: every text against itself
    with its last half replaced by the start of the next text, and against the next text, in the order of `key` (numeric).

    Null text: empty; an empty text's fingerprint is empty and alike to empty ones only.  Null keys come first.  Repeated keys
    are in the order of their texts.  A single row is followed by itself; an empty table gives an empty result.  Other
    columns are ignored.

    With `groups` (key, node, group_key, n_group, see `spot_match.match_groups`) there are also group_key and n_group.  Its
    rows are dealt like the texts, each before those of its key, so texts are not shuffled for it."""
    kind = docs.schema[key].dataType.simpleString()
    rows, begin = _with_successors(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    order, names = ["part", "border", "key", "text"], ["part", "border", "key", "text"]
    if groups is not None:
        known = groups.select(search(as_number(F.col("key")), begin[1:]).alias("part"), F.lit(False).alias("border"), "key", F.lit(None).cast("string").alias("text"),
                              F.struct("node", "group_key", "n_group").alias("known"))
        rows = rows.withColumn("known", F.lit(None).cast(known.schema["known"].dataType)).union(known)
        order, names = ["part", "border", "key", F.col("known").isNull(), "text"], names + ["known"]
    grouped = groups is not None
    dealt = rows.repartitionById(max(len(begin), 1), F.col("part")).sortWithinPartitions(*order)

    def finish(keys: list, texts: list[str], nexts: list[str], known: list[dict]) -> pa.RecordBatch:
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, nexts, halves)]
        m = len(texts)
        follows = [i + 1 < m and nexts[i] is texts[i + 1] for i in range(m)]
        sets = signature_sets(texts + edited + [n for n, f in zip(nexts, follows) if not f])
        own, other, more = sets[:m], sets[m: 2 * m], iter(sets[2 * m:])
        after = [own[i + 1] if f else next(more) for i, f in enumerate(follows)]
        found = [g.get(node_of(s), (k, 1)) if g else (k, 1) for g, s, k in zip(known, own, keys)]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
             pa.array([as_text(s) for s in own]), pa.array([as_text(s) for s in other]),
             pa.array([jaccard(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([jaccard(a, b) for a, b in zip(own, after)], pa.float64()),
             *([pa.array([k for k, _ in found]), pa.array([m for _, m in found], pa.int64())] if grouped else [])],
            ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["group_key", "n_group"] if grouped else [])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        at_key, own = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys, texts, nexts, known = [], [], [], []
                for p, border, k, t, *g in zip(*(part.column(c).to_pylist() for c in names)):
                    if at_key != (p, border, k):
                        at_key, own = (p, border, k), {}
                    if g and g[0] is not None:
                        own[g[0]["node"]] = (g[0]["group_key"], g[0]["n_group"])
                        continue
                    if held is not None and held[0] == p:
                        keys.append(held[1])
                        texts.append(held[2])
                        nexts.append(t)
                        known.append(held[3])
                    held = None if border else (p, k, t, own)
                if keys:
                    out = finish(keys, texts, nexts, known)
                    for c in ("key", "group_key")[: 1 + grouped]:
                        out = out.set_column(out.schema.get_field_index(c), c, out.column(c).cast(part.schema.field("key").type))
                    yield out

    more = "" if groups is None else f", group_key {kind}, n_group long"
    return dealt.mapInArrow(compare, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                     f"near_edited double, near_next double{more}").withColumnRenamed("key", key)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n (signatures), signatures array<long> of every text; null text: empty."""
    kind = docs.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = signature_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "n", "signatures"])

    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .mapInArrow(make, f"key {kind}, n long, signatures array<long>").withColumnRenamed("key", key)
