"""Cosine links against all pairs."""

import numpy as np
import pytest

from riskweave.llm import vectorjoin


def brute(rows, least=0.93):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        x = x / np.abs(x).max()
        return x / np.sqrt(x @ x)
    units = [unit(v) for _, v, _ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (_, _, la) in enumerate(rows):
        for j in range(i):
            a, b = units[i], units[j]
            if la is None or la != rows[j][2] or a is None or b is None or len(a) != len(b):
                continue
            if a @ b >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], names.get(find(i)), r[0] is None or r[0] == names.get(find(i))) for i, r in enumerate(rows)), key=str)


def cases(seed, n=500):
    rng = np.random.default_rng(seed)
    rows, centre = [], [rng.normal(size=12) for _ in range(6)]
    for i in range(n):
        kind = rng.integers(0, 4)
        v = rng.normal(size=12) if kind == 0 else centre[rng.integers(0, 6)] + rng.normal(size=12) * rng.choice([0.02, 0.2, 0.35])
        rows.append((i, (v * rng.choice([1.0, 3.0, 1e-3])).tolist(), int(rng.choice([1, 1, 1, 2, 3]))))
    step = rng.normal(size=12)                              # a chain along an arc
    other = rng.normal(size=12)
    other -= step * (other @ step) / (step @ step)
    other *= np.linalg.norm(step) / np.linalg.norm(other)
    rows += [(n + k, (step * np.cos(k / 4) + other * np.sin(k / 4)).tolist(), 1) for k in range(20)]
    rows += [(2000 + k, [1.0] * 12, 2) for k in range(40)] + [(2040, [2.0] * 12, 2), (2041, [2.0] * 5, 2)]
    rows += [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [float("nan")] + [1.0] * 11, 1), (3003, [None] + [1.0] * 11, 2),
             (3004, [1.0] * 12, None), (3005, [], 1), (3006, [1e300] * 12, 2), (2001, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 40), (3, 7)])
def test_against_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(vectorjoin, "BLOCK", block)
    rows = cases(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as w").repartition(5)
    got = sorted((tuple(r) for r in vectorjoin.cosine_links(df).collect()), key=str)
    assert got == brute(rows)


def test_tree_bounds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) + np.repeat(rng.normal(size=(10, 8)) * 3, 30, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = vectorjoin.Tree(x, np.ones(300))
    for k, centres in enumerate(t.levels):
        d = np.linalg.norm(x - x[centres[t.above[k]]], axis=1)
        assert (d <= t.radius[k][t.above[k]] + 1e-7).all() and t.weight[k].sum() == 300
        assert k == 0 or set(t.levels[k - 1]) <= set(centres)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorjoin.cosine_links(df).collect() == []
