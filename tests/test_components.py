"""Connected components: deep graphs, hubs, empty input, no round limit."""

import math
import random

import numpy as np
import pytest

from riskweave.operators import neighbors
from riskweave.operators import neighbors as N


def _components(edges, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    least = {}
    for v in range(n):
        least[find(v)] = min(least.get(find(v), v), v)
    return {v: least[find(v)] for v in range(n)}


def _run(spark, edges, n):
    v = spark.range(n).select("id")
    e = spark.createDataFrame(edges, "src long, dst long")
    return {r["id"]: r["component"] for r in neighbors.connected_components(v, e).collect()}


def test_shuffled_chain_takes_logarithmic_rounds(spark, monkeypatch):
    n = 5000
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    edges = list(zip(ids, ids[1:]))
    rounds = []
    real = neighbors.both_directions
    monkeypatch.setattr(neighbors, "both_directions", lambda *a, **k: rounds.append(1) or real(*a, **k))
    assert set(_run(spark, edges, n).values()) == {0}
    assert len(rounds) <= 2 * math.log2(n)


@pytest.mark.parametrize("kind", ["star", "grid", "mixed", "none"])
def test_shapes(spark, kind):
    rng = random.Random(5)
    n = 400
    edges = {
        "star": [(7, v) for v in range(300) if v != 7],
        "grid": [(20 * r + c, 20 * r + c + 1) for r in range(20) for c in range(19)]
                + [(20 * r + c, 20 * r + 20 + c) for r in range(9) for c in range(20)],
        "mixed": [(rng.randrange(n), rng.randrange(n)) for _ in range(250)] + [(3, 3), (5, 6), (6, 5), (5, 6)],
        "none": [],
    }[kind]
    assert _run(spark, edges, n) == _components(edges, n)


def test_null_ends_are_ignored(spark):
    e = spark.createDataFrame([(1, None), (None, 2), (1, 3)], "src long, dst long")
    v = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    got = {r["id"]: r["component"] for r in neighbors.connected_components(v, e).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_small_graphs_give_the_same_labels(spark):
    rng = np.random.default_rng(9)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(400, 480)]
    v, edges = spark.range(500), spark.createDataFrame(e, "src long, dst long")
    want = sorted(tuple(r) for r in N.connected_components(v, edges, "id").collect())
    assert sorted(tuple(r) for r in N.components(v, edges, "id").collect()) == want
    assert sorted(tuple(r) for r in N.components(v, edges, "id", small=10).collect()) == want
    names = edges.selectExpr("cast(src as string) src", "cast(dst as string) dst")
    text = v.selectExpr("cast(id as string) id")
    assert sorted(map(tuple, N.components(text, names).collect())) == sorted(map(tuple, N.connected_components(text, names).collect()))
    assert N.components(v, edges.filter("src < 0")).filter("id = component").count() == 500


def test_no_round_table_is_broadcast(spark, monkeypatch):
    """A round's table may hold every vertex, and its file is far smaller than its rows in memory."""
    n = 3000
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    plans, real = [], N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(N, "_local_stars", lambda e: e.select("a", "b"))      # more than one round
    got = N.connected_components(spark.range(n).select("id"), edges).collect()
    assert {r["component"] for r in got} == {0} and len(got) == n
    assert sum("Join" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)
    plans.clear()
    assert N.components(spark.range(n).select("id"), edges, small=n).count() == n
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
