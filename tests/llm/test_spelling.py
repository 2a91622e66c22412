import random
import re
import zlib
from collections import Counter

import pytest
from plain import DOCS, awkward, lower, with_clashes
from pyspark.sql import functions as F

from boreline.llm.q_spelling import misspelt_words
from boreline.llm.spelling import variants



def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * counts[w] and counts[best] > counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def vocabulary():
    r = random.Random(4)
    out = {}
    for stem in ["because", "therefore", "élégant", "日本語日本語", "aaaaaaa", "x" * 900]:
        ring = {stem}
        for _ in range(40):
            w = list(r.choice(sorted(ring)))
            k, at = r.randrange(3), r.randrange(len(w))
            w[at: at + (k > 0)] = [] if k == 1 else [r.choice("abeoué")]
            ring.add("".join(w))
        out |= {w: 5 ** r.randrange(1, 7) + r.randrange(3) for w in ring}
    return out | {"": 7, "a": 50, "b": 50, "ab": 2, "zebra": 0, "zebre": 0}


@pytest.mark.parametrize(("symbols", "crowd"), [(8, 64), (8, 1), (1, 4), (3, 0)])
def test_variants(spark, symbols, crowd):
    counts = vocabulary()
    rows = [(w, n) for w, n in counts.items()] + [(None, 9), ("zebra", None), ("because", 1)]
    counts["because"] += 1
    df = spark.createDataFrame(rows, "word string, n long").withColumn("near", F.lit("other")).withColumn("r", F.lit("other")).repartition(3)
    assert got(variants(df, symbols=symbols, crowd=crowd)) == plain(counts)


def test_no_words(spark):
    assert got(variants(spark.createDataFrame([], "word string, n long"))) == []
    assert got(variants(spark.createDataFrame([(None, 3)], "word string, n long"))) == []


def test_planted_errors(spark):
    rows = awkward() * 6
    rows = [(i if r[0] is not None else None, *r[1:]) for i, r in enumerate(rows)]
    rows += [(5000 + i, " ".join(["Particular", "ÄRZTE×÷ÿ", "naïveté"] * 6), None, None, None) for i in range(600)]
    want = Counter()
    for k, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            at = h % len(run)
            w = run if h % 199 else run[:at] + run[at + 1:]
            if len(w) >= 6:
                want[w] += 1
    want = {w: n for w, n in want.items() if n >= 5}
    assert any(w not in ("particular", "naïveté") and one_edit(w, "particular") for w in want)
    words = misspelt_words(with_clashes(spark.createDataFrame(rows, DOCS)))
    assert {r.word: r.n for r in words.collect()} == want
    assert got(variants(words)) == plain(want)
