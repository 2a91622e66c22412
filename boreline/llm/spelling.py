"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced character.

Letters are hashed to SYMBOLS symbols.  The one-edit neighbourhood of every reduced word (itself, all deletions, and every
symbol put in or in place of another) is generated as 64-bit hashes, which a prefix sum gives in one step each, so a long
word makes rows and no long strings.  It is joined to the reduced vocabulary; the words behind two neighbours are
verified on their own characters.  Two words of one edit always have neighbouring reductions, so none is lost.

Reduced words with more than CROWD words do not meet their neighbours all with all: these words and the ones around them
are paired by what is left of each without one of its characters, where every pair that meets is a true one but for hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.llm.blocks import U64, mix, powers
from boreline.llm.shared import written

SYMBOLS = 8
CROWD = 64
#: A form is found at least so many times as often as the word.
RATIO = 5
#: Hashes that a task makes at once.
CHUNK = 1 << 20


def _codes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: their numbers in the list and their code points, one row a word."""
    length = np.array([len(w) for w in words], np.int64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        step = max(1, CHUNK // max(int(n), 1))
        for a in range(0, len(at), step):
            some = at[a: a + step]
            text = "".join(words[i] for i in some.tolist())
            yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), int(n))


def _reduced(points: np.ndarray, symbols: int) -> np.ndarray:
    """One of `symbols` hashes for every character."""
    return mix(mix(points.astype(U64)) % U64(symbols)) | U64(1)


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros((values.shape[0], values.shape[1] + 1), U64)
    np.cumsum(values * powers(values.shape[1] + 1)[: values.shape[1]], axis=1, out=out[:, 1:])
    return out


def _sealed(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h + U64(length * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)


def _without_one(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of what is left without the character at each place."""
    back = powers(2, -1)[1]
    return prefix[:, at] + (prefix[:, -1:] - prefix[:, at + 1]) * back


def neighbourhood(points: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the reduced words of `points` and of all reduced words one edit away, in parts of about CHUNK."""
    v = _reduced(points, symbols)
    m, n = v.shape
    p, pw, rows = _prefix(v), powers(n + 2), np.arange(m)
    every = mix(np.arange(symbols, dtype=U64)) | U64(1)
    yield rows, _sealed(p[:, -1], n)
    step = max(1, CHUNK // (m * symbols))
    for a in range(0, n + 1, step):
        put = np.arange(a, min(a + step, n + 1))
        old = put[put < n]
        if len(old):
            yield np.repeat(rows, len(old)), _sealed(_without_one(p, old), n - 1).ravel()
            swap = p[:, -1, None, None] + (every - v[:, old, None]) * pw[old][:, None]
            yield np.repeat(rows, len(old) * symbols), _sealed(swap, n).ravel()
        new = p[:, put, None] + every * pw[put][:, None] + ((p[:, -1:] - p[:, put]) * pw[1])[:, :, None]
        yield np.repeat(rows, len(put) * symbols), _sealed(new, n + 1).ravel()


def _reduce(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, r: the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.zeros(batch.num_rows, np.int64)
            for at, points in _codes(batch.column("word").to_pylist()):
                r[at] = _sealed(_prefix(_reduced(points, symbols))[:, -1], points.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], ["word", "n", "r"])

    return words.mapInArrow(run, "word string, n long, r long")


def _neighbours(buckets: DataFrame, symbols: int) -> DataFrame:
    """r, size, r2: all neighbours of every reduced word; one of its words stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, size = batch.column("r").to_numpy(), batch.column("size").to_numpy()
            for at, points in _codes(batch.column("holder").to_pylist()):
                for a in range(0, len(at), max(1, CHUNK // (2 * symbols * (points.shape[1] + 1)))):
                    some = slice(a, a + max(1, CHUNK // (2 * symbols * (points.shape[1] + 1))))
                    for row, h in neighbourhood(points[some], symbols):
                        of = at[some][row]
                        yield pa.RecordBatch.from_arrays([pa.array(r[of]), pa.array(size[of]), pa.array(h)], ["r", "size", "r2"])

    return buckets.select("r", "size", "holder").mapInArrow(run, "r long, size long, r2 long").distinct()


def _left_overs(words: DataFrame) -> DataFrame:
    """word, n, crowded, place, h: every word (place -1) and what is left of it without the character at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, points in _codes(batch.column("word").to_pylist()):
                p, n = _prefix(mix(points.astype(U64)) | U64(1)), points.shape[1]
                step = max(1, CHUNK // len(at))
                for a in range(-1, n, step):
                    place = np.arange(max(a, 0), min(a + step, n))
                    h = _sealed(_without_one(p, place), n - 1)
                    if a < 0:
                        place, h = np.r_[-1, place], np.concatenate([_sealed(p[:, -1], n)[:, None], h], axis=1)
                    of = pa.array(np.repeat(at, len(place)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("word", "n", "crowded")),
                                                      pa.array(np.tile(place, len(at)).astype(np.int64)), pa.array(h.ravel())],
                                                     ["word", "n", "crowded", "place", "h"])

    return words.select("word", "n", "crowded").mapInArrow(run, "word string, n long, crowded boolean, place long, h long")


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """word, near, near_n: every ordered pair of different words one edit apart.  words: distinct words with n."""
    reduced = written(_reduce(words, symbols), "reduced")
    buckets = written(reduced.groupBy("r").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("holder")), "buckets")
    links = _neighbours(buckets, symbols).join(buckets.select(F.col("r").alias("r2"), F.col("size").alias("size2")), "r2").filter("r <= r2")
    links = written(links, "links")
    few = links.filter((F.col("size") <= crowd) & (F.col("size2") <= crowd))
    a, b = reduced.select("r", F.col("word").alias("a"), F.col("n").alias("an")), reduced.select(F.col("r").alias("r2"), F.col("word").alias("b"), F.col("n").alias("bn"))
    met = few.select("r", "r2").join(a, "r").join(b, "r2").filter(((F.col("r") < F.col("r2")) | (F.col("a") < F.col("b"))) & _one_edit(F.col("a"), F.col("b")))
    met = met.select("a", "an", "b", "bn")
    many = links.filter((F.col("size") > crowd) | (F.col("size2") > crowd))
    around = many.select(F.explode(F.array("r", "r2")).alias("r")).distinct()
    close = reduced.join(around, "r").join(buckets.select("r", (F.col("size") > crowd).alias("crowded")), "r")
    left = written(_left_overs(close), "left-overs")
    x = left.select("h", "place", F.col("word").alias("a"), F.col("n").alias("an"), F.col("crowded").alias("ac"))
    y = left.select("h", F.col("place").alias("place2"), F.col("word").alias("b"), F.col("n").alias("bn"), F.col("crowded").alias("bc"))
    swapped = x.filter("place >= 0").join(y.filter("place2 >= 0"), "h").filter((F.col("place") == F.col("place2")) & (F.col("a") < F.col("b")))
    dropped = x.filter("place >= 0").join(y.filter("place2 < 0"), "h")
    rest = swapped.unionByName(dropped).filter((F.col("ac") | F.col("bc")) & _one_edit(F.col("a"), F.col("b"))).select("a", "an", "b", "bn").distinct()
    both = met.unionByName(rest)
    return both.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
                                        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")))))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to their end.  A form is RATIO times as frequent as its word, so a chain is short; every round
    doubles the way that has been gone, until none goes on."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(vocabulary: DataFrame, word: str = "word", n: str = "n", symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary with counts.

    near: words at one inserted, deleted or replaced character.  form: the near word with the largest n (ties: the smallest),
    if that is at least RATIO times n, else null.  root: forms followed to the last; the word itself if it has none.
    Null words go; rows of one word are added up, a null count as 0; an empty word is near to those of one character; words of any
    length take part whole.  An empty table gives no rows.  Other columns are ignored."""
    words = vocabulary.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.sum(F.coalesce(F.col(n), F.lit(0))).cast("long").alias("n"))
    words = written(words, "vocabulary")
    best = near_pairs(words, symbols, crowd).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("top", -F.col("best.less"))
    is_form = F.col("top") >= RATIO * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form & (F.col("top") > F.col("n")), F.col("best.near")).alias("form"),
                                 F.when(is_form & (F.col("top") > F.col("n")), F.col("top")).alias("form_n")), "forms")
    root = _roots(found.filter("form is not null"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
