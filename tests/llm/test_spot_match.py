"""SpotSigs matching against all pairs."""

import random

import pytest
from plain import prose

from boreline.llm import spot_match
from boreline.llm.spotsigs import jaccard, signature_sets

DOCS = "doc_id long, text string"


def near(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def by_all_pairs(rows, at_least):
    sets = signature_sets([t or "" for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= at_least:
                root[find(i)] = find(j)
    reach = {}
    for i in range(len(rows)):
        reach.setdefault(find(i), []).append(rows[i][0])
    out = [(k, min((x for x in reach[find(i)] if x is not None), default=None), len(reach[find(i)])) for i, (k, _) in enumerate(rows)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small, tile", [(32, 1024), (2, 3)])
@pytest.mark.parametrize("at_least", [0.75, 0.44])
def test_groups(spark, monkeypatch, small, tile, at_least):
    monkeypatch.setattr(spot_match, "SMALL", small)
    monkeypatch.setattr(spot_match, "TILE", tile)
    rng = random.Random(3)
    texts = [prose(f"m{i}", 20 + 9 * i) for i in range(20)]
    texts += [near(rng, texts[i % 20], k) for k in (1, 3, 6, 12) for i in range(20)] + texts[:5]
    texts += [near(rng, texts[7], rng.randrange(1, 14)) for _ in range(40)] + ["", None, "no anchors here", "no anchors here"]
    rng.shuffle(texts)
    rows = [(i // 2 if i % 9 == 0 else 1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone of all")]
    got = spot_match.compare_and_match(spark.createDataFrame(rows, DOCS), at_least=at_least).collect()
    assert sorted(((r.doc_id, r.group_key, r.n_group) for r in got), key=str) == by_all_pairs(rows, at_least)
    assert any(r.n_group > 5 for r in got) and any(r.n_group == 1 for r in got)


def test_no_groups(spark):
    assert spot_match.compare_and_match(spark.createDataFrame([], DOCS)).count() == 0
