"""Statistics of texts as column expressions: words, symbols, repeated lines and repeated three-word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of other characters than these.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    """Characters of the text that do not match the class."""
    return F.length(F.regexp_replace(text, f"[{chars}]+", ""))


#: Up to so many different repeated windows are looked up one by one; texts with more sort all their windows.
FEW = 48


def _covered(places: Column) -> Column:
    """Words inside the three-word windows that begin at the given places, in order."""
    return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                       lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]


def _places_sorted(h: Column) -> Column:
    """Places of windows found twice or more: those that stand next to an equal one when (hash, place) are sorted."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    hashes = F.transform(pairs, lambda p: p["h"])
    none = F.array(F.lit(None).cast("long"))
    before = F.concat(none, hashes)
    after = F.concat(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), none)
    found = F.transform(F.arrays_zip(pairs.alias("p"), before.alias("b"), after.alias("a")),
                        lambda z: F.when((z["p"]["h"] == z["b"]) | (z["p"]["h"] == z["a"]), z["p"]["i"]))
    return F.sort_array(F.filter(found, lambda x: x.isNotNull()))


def _places_listed(h: Column, repeated: Column) -> Column:
    """The same by looking every window up in the array of repeated ones."""
    marked = F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i))
    return F.array_compact(marked)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATS (long).  Null text counts as empty.  Columns of docs with such names are replaced."""
    docs = docs.drop(*STATS)
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("__words", F.array_remove(F.split(t, "[ \\t-\\r]+"), ""))
    w = F.col("__words")
    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    docs = docs.withColumn("__windows", F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(0))))
    h, ordered, repeated = F.col("__windows"), F.col("__ordered"), F.col("__repeated")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    docs = docs.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": _without(t, "\\x20\\t-\\r").cast("long"),
        "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
        "__lines": lines,
        "__ordered": F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)),
    })
    again = F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i + 1)))
    docs = docs.withColumn("__repeated", F.when(ordered.isNotNull(), again))
    n = F.when(repeated.isNull(), 0).when(F.size(repeated) <= FEW, _covered(_places_listed(h, repeated))).otherwise(_covered(_places_sorted(h)))
    return docs.withColumns({"n_repeat_words": n.cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}) \
        .drop("__words", "__windows", "__lines", "__ordered", "__repeated")
