"""Re-Pair goes on until no frequent pair is left."""

import numpy as np
import pytest

from boreline.llm import repair


@pytest.mark.parametrize("docs", [[list(range(500))] * 2000, [[7] * 100_000], [[1, 2, 3] * 5000, [4] * 77, []]])
def test_end(docs):
    ids, size = np.array(sum(docs, []), "<u4"), np.array([len(d) for d in docs])
    g = repair.build(ids, np.arange(len(docs)), size)
    assert np.array_equal(repair.expand(repair.from_bytes(repair.to_bytes(g)), g.sequence), ids)
    count = {}
    for a, b in zip(g.spans[:-1].tolist(), g.spans[1:].tolist()):
        i, s = 0, g.sequence[a:b].tolist()
        while i + 1 < len(s):
            count[s[i], s[i + 1]] = count.get((s[i], s[i + 1]), 0) + 1
            i += 1 + (i + 2 < len(s) and s[i] == s[i + 1] == s[i + 2])
    assert max(count.values(), default=0) < repair.LEAST and len(g.sequence) <= 4 * len(docs) + 4 * repair.LEAST
