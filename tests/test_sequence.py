"""State-space estimation: blocks and levels give what one pass over the whole series gives."""

import numpy as np
import pandas as pd
import pytest

from boreline.operators.sequence import CheapestPath, CheapestPaths, Diffusion, Drift, _blur, _inside, smooth

RNG = np.random.default_rng(9)
GRID = np.linspace(-4, 4, 9)


def knots(spark, obs, aux, init):
    rows = [(w, j, 10 * j, [float(x) for x in o], float(aux[j]), [float(x) for x in init])
            for w in (1, 2) for j, o in enumerate(obs if w == 1 else obs[:3])]
    return spark.createDataFrame(rows, "w long, j long, seq long, obs array<double>, aux double, init array<double>")


def posterior(model, obs, aux, init):
    a, f = [], init.copy()
    for j, o in enumerate(obs):
        f = model.forward(f[:, None], o, aux[j], j == 0)[:, 0]
        f /= f.sum()
        a.append(f)
    b = [np.ones(model.size)] * len(obs)
    for j in range(len(obs) - 2, -1, -1):
        x = model.backward(b[j + 1][:, None], obs[j + 1], aux[j + 1])[:, 0]
        b[j] = x / x.sum()
    return [model.estimate(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("model", [Diffusion(GRID), Drift(GRID, 1, 0.35)], ids=["diffusion", "drift"])
def test_smoothing_by_blocks(spark, model):
    obs = RNG.uniform(0.05, 1, (40, len(GRID)))
    aux = RNG.uniform(0.3, 1.5, 40)
    init = np.exp(-0.5 * GRID ** 2)
    init = np.tile(init, model.size // len(GRID))
    want = posterior(model, obs, aux, init)
    for block, fan in [(100, 64), (4, 64), (3, 3)]:
        got = smooth(knots(spark, obs, aux, init), "w", model, block, fan).toPandas()
        assert np.allclose(got[got.w == 1].sort_values("seq")["est"], want)
        assert (got.w == 2).sum() == 3


def test_cheapest_path_by_blocks(spark):
    vals = np.arange(12.0)
    model = CheapestPath(vals, 0.7)
    obs = RNG.uniform(0, 9, (35, 12)).round(2)
    init = np.where(vals == 5, 0.0, np.inf)
    cost, back = init.copy(), []
    for o in obs:
        new, who = np.full(12, np.inf), np.zeros(12, int)
        for s in range(12):
            for d in range(-2, 3):
                if 0 <= s - d < 12 and cost[s - d] + 0.7 * abs(d) + o[s] < new[s]:
                    new[s], who[s] = cost[s - d] + 0.7 * abs(d) + o[s], s - d
        cost = new
        back.append(who)
    path = [int(np.argmin(cost))]
    for who in reversed(back[1:]):
        path.append(int(who[path[-1]]))
    for block, fan in [(100, 8), (4, 8), (3, 3)]:
        got = smooth(knots(spark, obs, np.zeros(35), init), "w", model, block, fan).toPandas()
        assert got[got.w == 1].sort_values("seq")["est"].tolist() == [float(x) for x in reversed(path)]


def test_settings_in_one_pass_are_those_of_single_passes(spark):
    n, length, move, scale = 12, 35, [0.7, 3.0, 0.0], [2.0, 9.0, 0.5]
    curve, value = RNG.uniform(0, 20, n).round(2), RNG.uniform(0, 20, (length, 3)).round(2)
    init = np.where(np.arange(n) == 5, 0.0, np.inf)
    for block, fan in [(100, 8), (4, 8), (3, 3)]:
        rows = [(1, j, 10 * j, [float(x) for x in value[j]], 0.0, [float(x) for x in curve] if j % block == 0 else None, [float(x) for x in np.tile(init, 3)] if j == 0 else None)
                for j in range(length)]
        df = spark.createDataFrame(rows, "w long, j long, seq long, values array<double>, aux double, curve array<double>, init array<double>")
        got = smooth(df, "w", CheapestPaths(n, move, scale, [2, 2, 1]), block, fan).toPandas().sort_values("seq")
        for s in range(3):
            one = CheapestPath(np.arange(n), move[s], [2, 2, 1][s])
            obs = (value[:, s, None] - curve) ** 2 / scale[s]
            want = smooth(knots(spark, obs, np.zeros(length), init), "w", one, 100).toPandas()
            assert [e[s] for e in got["est"]] == want[want.w == 1].sort_values("seq")["est"].tolist()


def test_blur_keeps_constants_and_mass_inside():
    assert np.allclose(_blur(np.full(9, 2.0)[:, None], 1.3), 2.0)
    x = np.zeros(41)
    x[20] = 1
    assert _blur(x[:, None], 1.5).sum() == pytest.approx(1.0)


def test_blur_with_a_width_per_column():
    x, sigma = RNG.uniform(0, 1, (9, 40)), np.concatenate([[1e-3, 0.12, 0.2, 30.0], RNG.uniform(0.1, 6, 36)])
    want = np.stack([_blur(x[:, [i]], s)[:, 0] for i, s in enumerate(sigma)], axis=1)
    assert np.allclose(_blur(x, sigma), want, rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("model", [Diffusion(GRID), Drift(GRID, 1, 0.35), CheapestPath(np.arange(9.0), 0.7)], ids=["diffusion", "drift", "path"])
def test_a_pack_of_blocks_is_worked_on_at_once(model):
    """One call takes many blocks, whole series and later blocks among them, and gives what each gives alone."""
    rows = []
    for w, (start, length) in enumerate([(0, 5), (0, 1), (8, 3), (0, 9), (16, 5)]):
        state = RNG.uniform(0.1, 1, model.size)
        for j in range(start, start + length):
            rows.append({"w": w, "blk": start // 8, "j": j, "seq": 3 * j, "obs": RNG.uniform(0.05, 1, 9), "aux": RNG.uniform(0.2, 1.5),
                         "init": state if j == 0 else None, "fin": state if start else None, "bin": state[::-1] if w == 2 else None})
    pdf = pd.DataFrame(rows)
    got = _inside(model, "w", pdf.sample(frac=1, random_state=1)).sort_values(["w", "seq"])
    want = pd.concat([_inside(model, "w", g) for _, g in pdf.groupby("w")]).sort_values(["w", "seq"])
    assert got[["w", "seq"]].values.tolist() == want[["w", "seq"]].values.tolist()
    assert np.allclose(got["est"].astype(float), want["est"].astype(float))


def test_keys_stay_exact_beside_rows_without_one(spark):
    obs, model = RNG.uniform(0.05, 1, (6, 9)), Diffusion(GRID)
    keys = [None, 2 ** 53 + 1, 2 ** 53]
    rows = [(w, j, j, [float(x) for x in o], 0.5, [1.0] * 9) for w in keys for j, o in enumerate(obs)]
    df = spark.createDataFrame(rows, "w long, j long, seq long, obs array<double>, aux double, init array<double>")
    got = smooth(df, "w", model, 100).collect()
    want = posterior(model, obs, np.full(6, 0.5), np.ones(9))
    for w in keys:
        assert np.allclose([r["est"] for r in sorted((r for r in got if r["w"] == w), key=lambda r: r["seq"])], want)
