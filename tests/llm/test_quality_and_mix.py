import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from plain import DOCS, awkward, poisson, prose, stats, uniform, with_clashes
from pyspark.sql import functions as F

from boreline.llm import robust_outliers as ro
from boreline.llm.poisson_mix import MAX_RATE, mix
from boreline.llm.robust_outliers import judge
from boreline.llm.spotsigs import ANCHORS, as_text, compare_with_edits, jaccard, signature_sets
from boreline.llm.text_stats import with_stats


def test_statistics(spark):
    rows = awkward() + [(900 + i, t, None, None, None) for i, t in enumerate(
        ["#*$%&|<> a", "a a a a a", "a b a b a b a", "x\n \nx\n\nx", " lead and trail ", "a\x0bb\x0cc\rd\te", "  　", "a b c d a b c e a b c", "q " * 3000 + "r s t q q"])]
    got = with_stats(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got.collect():
        assert tuple(r)[2:] == stats(r.text), (r.doc_id, (r.text or "")[:60])


def plain_verdicts(rows):
    """distance2 of every row by numpy; None where no group is large enough or the base rules fail."""
    n_features, floor = len(ro.NAMES), np.diag([v * v for v in ro.FEATURES.values()])
    x, ok = [], []
    for _, t, *_ in rows:
        w, chars, symbols, lines, repeats = stats(t)
        n = max(w, 1)
        x.append([math.log(max(chars, 1) / n), math.sqrt(symbols / n), math.sqrt(lines / n), math.sqrt(repeats / n), math.log(n)])
        ok.append(not (w < 50 or 100 * repeats > 50 * w))
    x, ok = np.array(x).reshape(-1, n_features), np.array(ok, bool)
    names = [[(0,), (1, r[2]), (2, r[2], r[3])] for r in rows]
    size = Counter(m for ms, good in zip(names, ok) if good for m in ms)

    def at_share(bins, share):
        return np.sort(bins)[math.ceil(share * len(bins)) - 1]

    fitted = {}

    def fit(m):
        if m not in fitted:
            own = x[[i for i in range(len(rows)) if ok[i] and m in names[i]]]
            bins = np.floor(own * ro.BINS)
            mid = np.array([(at_share(b, 0.5) + 0.5) / ro.BINS for b in bins.T])
            cov = np.diag([((at_share(b, 0.84) - at_share(b, 0.16)) / (2 * ro.BINS)) ** 2 for b in bins.T])
            for _ in range(ro.STEPS):
                d = own - mid
                b = np.floor(16 * np.log2(1 + 64 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + floor), d)))
                near = own[b <= at_share(b, ro.KEEP)]
                mid, cov = near.mean(0), ro.CONSISTENCY * np.cov(near.T, bias=True)
            fitted[m] = mid, np.linalg.inv(cov + floor)
        return fitted[m]

    out = []
    for i in range(len(rows)):
        m = next((m for m in names[i][::-1] if size[m] >= ro.MIN_ROWS), None) if ok[i] else None
        if m is None:
            out.append(None)
        else:
            mid, inverse = fit(m)
            out.append(float((x[i] - mid) @ inverse @ (x[i] - mid)))
    return ok, out


def corpus(n=330):
    r = random.Random(5)
    rows = []
    for i in range(n):
        text = prose(f"q{i}", r.randrange(60, 200), 3000)
        if i % 29 == 0:
            text = " ".join(w + r.choice(["###", "***", "&&&"]) for w in text.split())
        rows.append((i, text, ["en", "en", "en", "de", None][i % 5], "src0" if i % 3 else f"src{i % 7}", len(text)))
    return rows


@pytest.mark.parametrize("rows", [corpus(), awkward(), []], ids=["corpus", "awkward", "empty"])
def test_verdicts(spark, rows):
    got = judge(with_clashes(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], DOCS)))
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows) == got.count()
    ok, distance = plain_verdicts(rows)
    for i in range(len(rows)):
        assert found[i].base_failed == (not ok[i])
        assert found[i].distance2 == (None if distance[i] is None else pytest.approx(distance[i], rel=1e-6, abs=1e-9))
        assert found[i].kept == (ok[i] and not (distance[i] is not None and distance[i] > ro.CUTOFF))
    if len(rows) > 300:
        assert sum(not r.kept for r in found.values()) == len(range(0, len(rows), 29))


def test_verdicts_with_null_keys(spark):
    got = judge(spark.createDataFrame(awkward(), DOCS)).select("doc_id", "n_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], stats(r[1])[0]) for r in awkward()), key=str)


def test_mix_repeats_by_rate(spark):
    rows = awkward()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(t or "")
    for weights, repeats in ((None, 1.0), ({"a": 3.0, "b": 1.0}, 1.5), ({"a": 1.0}, 12.0)):
        share = {s: (n ** 0.7 if weights is None else weights.get(s, 0.0)) for s, n in size.items()}
        rate = {s: share[s] / sum(share.values()) * sum(size.values()) * repeats / size[s] for s in size}
        want = Counter()
        for k, _, _, s, _ in rows:
            draws = max(math.ceil(rate[s] / MAX_RATE), 1)
            n = sum(poisson(rate[s] / draws, uniform(0, "count", i, "null" if k is None else k)) for i in range(1, draws + 1))
            want.update((k, c) for c in range(n))
        got = mix(with_clashes(spark.createDataFrame(rows, DOCS)), weights, repeats)
        found = [(r.doc_id, r.copy, r.place, r.text) for r in got.collect()]
        assert Counter((k, c) for k, c, *_ in found) == want
        assert [f[2] for f in found] == sorted(f[2] for f in found)
        assert {(k, t) for k, _, _, t in found} <= {(r[0], r[1]) for r in rows}
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_poisson_counts_have_their_mean(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    for repeats in (0.3, 2.0, 20.0):
        counts = Counter(r.doc_id for r in mix(docs, repeats=repeats).select("doc_id").collect())
        n = np.array([counts[i] for i in range(20000)])
        assert abs(n.mean() - repeats) < 5 * math.sqrt(repeats / 20000) and abs(n.var() / repeats - 1) < 0.06


def plain_signatures(text):
    """Signatures as words, by the rule: an anchor and the next two content words, marks at the ends of words taken off."""
    w = []
    for x in text.translate({i: i + 32 for i in range(65, 91)}).split():
        for _ in range(3):
            if len(x.encode()) > 1 and x[-1] in ".,;:!?()[]\"'":
                x = x[:-1]
        w.append(x)
    content = [i for i, x in enumerate(w) if x not in ANCHORS]
    out = set()
    for i, x in enumerate(w):
        nxt = [j for j in content if j > i][:2]
        if x in ANCHORS and len(nxt) == 2:
            out.add((x, w[nxt[0]], w[nxt[1]]))
    return out


def test_signatures():
    texts = [prose(f"g{i}", 60) for i in range(20)] + ["The cat, of the Houses!!! ran... to a big (dog).", "no anchors here", "a b", "", "  ", "the of and", "THE Cat sat", "the cat sat"]
    sets = signature_sets(texts)
    for t, s in zip(texts, sets):
        assert len(s) == max(len(plain_signatures(t)), int(bool(t)))
    for i in range(20):
        for j in range(20):
            a, b = plain_signatures(texts[i]), plain_signatures(texts[j])
            assert jaccard(sets[i], sets[j]) == pytest.approx(len(a & b) / len(a | b))
    assert as_text(sets[-1]) == as_text(sets[-2]) and len(as_text(sets[0])) == 8 * len(sets[0])
    assert jaccard(sets[0], sets[0][:1], 0.75) == 0.0 and jaccard(sets[0][:0], sets[0][:0]) == 1.0


@pytest.mark.parametrize("count", [None, 1, 2])
def test_edits(spark, count):
    rows = awkward() if count is None else [(i, prose(i, 30), None, None, None) for i in range(count)]
    got = {}
    for r in compare_with_edits(with_clashes(spark.createDataFrame(rows, DOCS))).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    print_of = {t: as_text(s) for (_, t), s in zip(order, signature_sets([t for _, t in order]))}
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        digest = hashlib.sha256(edit.encode()).hexdigest()
        r = next(r for r in got[k] if r.edited_sha256 == digest and r.fingerprint == print_of[t])
        other, = signature_sets([edit])
        assert r.n_chars == len(t) and r.edited_fingerprint == as_text(other)
        own, after = signature_sets([t, nxt])
        assert r.near_edited == pytest.approx(jaccard(own, other)) and r.near_next == pytest.approx(jaccard(own, after))
    assert sum(map(len, got.values())) == len(rows)


def test_no_edits(spark):
    assert compare_with_edits(spark.createDataFrame([], DOCS)).count() == 0
