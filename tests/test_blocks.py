"""Metric blocks: near pairs, DBSCAN in groups, spanning forest, Euler curve, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import blocks as B
from riskweave.operators import cluster as K
from riskweave.operators import forest as FO
from riskweave.operators import neighbors as N

from bruteforce import dbscan, kruskal_deaths, pairs_within


def _frame(spark, X, groups=None):
    rows = [(i, [float(v) for v in x], int(groups[i]) if groups is not None else 0) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, features array<double>, g int").repartition(4)


def _mixed(seed, n, d):
    rng = np.random.default_rng(seed)
    hot = rng.normal(0, 0.02, (n // 3, d))                   # a third of all points in one spot
    wide = rng.normal(0, 2, (n - n // 3 - 20, d))
    return np.round(np.vstack([hot, wide, wide[:20]]), 4)


def test_every_strategy_gives_the_same_pairs(spark):
    X = _mixed(1, 240, 20)
    want, _ = pairs_within(X, 3.1)
    for how in ("grid", "blocks", "auto"):
        got = N.eps_join(_frame(spark, X), "id", 3.1, strategy=how).collect()
        assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want
    groups = np.arange(240) % 3
    for how in ("grid", "blocks"):
        got = {(r.src, r.dst, r.src_g, r.dst_g) for r in N.eps_join(_frame(spark, X, groups), "id", 3.1, by="g", strategy=how).collect()}
        assert got == {(a, b, a % 3, b % 3) for a, b in want if a % 3 == b % 3}


def test_blocks_are_balls_of_bounded_size(spark):
    X = _mixed(2, 300, 3)
    rows = B.pack(_frame(spark, X, np.arange(300) % 2), "id", "features", by="g", rows=16).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(300)) and max(len(r.ids) for r in rows) <= 16
    for r in rows:
        P = np.frombuffer(r.vecs).reshape(len(r.ids), -1)
        assert np.array_equal(P, X[list(r.ids)]) and len({i % 2 for i in r.ids}) == 1
        assert np.sqrt(((P - np.array(r.centre)) ** 2).sum(1)).max() <= r.radius * (1 + 1e-9) + 1e-12


@pytest.mark.parametrize("rows", [8, 1024])
def test_dbscan_over_blocks_and_groups(spark, rows):
    X = _mixed(3, 200, 4)
    g = np.arange(200) % 2
    out = {(r.g, r.id): (r.cluster, r.is_core) for r in K.dbscan(_frame(spark, X, g), "id", 0.9, 4, by="g", rows=rows).collect()}
    for v in (0, 1):
        at = np.flatnonzero(g == v)
        lab, core = dbscan(X[at], 0.9, 4)
        want = {(v, int(i)): (int(at[c]) if c >= 0 else -1, bool(k)) for i, c, k in zip(at, lab, core)}
        assert {k: x for k, x in out.items() if k[0] == v} == want


def test_forest_labels():
    rng = np.random.default_rng(4)
    links = rng.random((30, 25)) < 0.04
    label = B.forest(links)
    for i, j in itertools.product(range(30), range(25)):
        if links[i, j]:
            assert label[i] == label[30 + j]
    assert all(label[label] == label)


@pytest.mark.parametrize("rows,thresh", [(8, 1.2), (1024, 1.2), (16, 50.0)])
def test_spanning_forest_equals_kruskal(spark, rows, thresh):
    X = _mixed(5, 150, 2)
    edges, comp = FO.spanning_forest(_frame(spark, X), "id", thresh, rows=rows)
    deaths, n_comp = kruskal_deaths(X, thresh)
    assert np.allclose(sorted(r.dist for r in edges.collect()), deaths)
    assert len({r.component for r in comp.collect()}) == n_comp


def test_forest_of_a_grid_with_equal_lengths(spark):
    X = np.array(list(itertools.product(range(9), range(7))), dtype=float)
    bars = FO.persistence_h0(_frame(spark, X), "id", 1.0).collect()
    assert sorted(r.death for r in bars) == [1.0] * 62 + [float("inf")]
    assert sorted(r.death for r in FO.persistence_h0(_frame(spark, X), "id", 0.5).collect()) == [float("inf")] * 63


def test_euler_curve(spark):
    X = _mixed(6, 60, 2)
    pairs, D = pairs_within(X, 2.0)
    cuts = [0.05, 0.7, 2.0]
    got = [tuple(r) for r in FO.euler_curve(_frame(spark, X), N.eps_join(_frame(spark, X), "id", 2.0), cuts).orderBy("threshold").collect()]
    for (t, v, e, tri, chi) in got:
        near = D <= t
        we = sum(near[i, j] for i, j in itertools.combinations(range(60), 2))
        wt = sum(near[i, j] and near[i, k] and near[j, k] for i, j, k in itertools.combinations(range(60), 3))
        assert (v, e, tri, chi) == (60, we, wt, 60 - we + wt)
    hub = spark.createDataFrame([(0, i, 1.0) for i in range(1, 400)] + [(1, 2, 1.0)], "src long, dst long, dist double")
    row = FO.euler_curve(spark.range(400), hub, [1.0]).first()
    assert (row.n_edges, row.n_triangles) == (400, 1)
    assert FO.euler_curve(spark.range(5), hub.filter("dist > 9"), [1.0]).first().euler == 5


def test_screened_distances_decide_as_the_sum_by_dimensions():
    rng = np.random.default_rng(3)
    for d, scale, shift in ((7, 1.0, 0.0), (64, 0.1, 0.0), (20, 1e6, 3e7)):
        X = np.round(rng.normal(size=(40, d)), 1) * scale + shift
        Y = np.vstack([X[:20], np.round(rng.normal(size=(30, d)), 1) * scale + shift])
        exact = B.sq_matrix(X, Y)
        for e2 in rng.choice(exact.ravel(), 20):
            assert np.array_equal(B.near_matrix(X, Y, e2), exact <= e2)
            allowed = rng.random(exact.shape) < 0.7
            d2 = np.where(allowed & (exact <= e2), exact, np.inf)
            want = np.argwhere((d2 == d2.min(1)[:, None]) & np.isfinite(d2))
            i, j, v = B.nearest_pairs(X, Y, allowed, e2)
            assert np.array_equal(np.stack([i, j], axis=1), want) and np.array_equal(v, exact[i, j])


def test_tiles_visit_every_pair_once(spark, monkeypatch):
    import pandas as pd
    monkeypatch.setattr(B, "TILE_FROM", 4)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=7)]) for i in range(400)], "id long, features array<double>")
    blocks = B.pack(df, "id", rows=16)
    pairs = B.near_blocks(blocks, 1.5)
    seen = lambda x, y: pd.DataFrame({"i": [x.blk], "j": [y.blk]})
    got = [tuple(r) for r in B.visit(blocks, pairs, seen, "i long, j long").collect()]
    assert blocks.count() >= 2 * B.TILE_FROM and sorted(got) == sorted((r.i, r.j) for r in pairs.collect())
    want = {(a, b) for a, b in zip(*np.nonzero(B.sq_matrix(*[np.array([r.features for r in df.orderBy("id").collect()])] * 2) <= 2.25)) if a < b}
    assert {(r.src, r.dst) for r in B.eps_pairs(blocks, 1.5).collect()} == want


def test_links_of_a_tile_leave_as_one_forest(spark, monkeypatch):
    """40 blocks in tiles of 8 by 8: what a tile writes grows with its points, not with its pairs of blocks."""
    monkeypatch.setattr(B, "TILE_FROM", 2)
    X = np.random.default_rng(4).uniform(size=(320, 2))
    X[::40] = X[::40] + [1.12, 0.0]                            # some points off the crowd
    written, real = [], K.cut_lineage

    def keep(df):
        out = real(df)
        if out.columns == ["a", "b", "border"]:
            written.append(out.filter("NOT border").count())
        return out

    monkeypatch.setattr(K, "cut_lineage", keep)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in K.dbscan(_frame(spark, X), "id", 1.0, 200, rows=8).collect()}
    lab, core = dbscan(X, 1.0, 200)
    assert got == {i: (int(lab[i]), bool(core[i])) for i in range(len(X))}
    assert written and written[0] < 3200                       # about 800 pairs of blocks gave up to 15 rows each


def test_joined_links_keep_components_and_border_roots():
    import pandas as pd
    rows = [(5, 2, False), (7, 5, False), (9, 5, False), (7, 2, False), (20, 21, False), (30, 7, True), (30, 9, True), (30, 40, True), (31, 20, True)]
    got = K._joined_links(pd.DataFrame(rows, columns=["a", "b", "border"]))
    star, border = got[~got["border"].astype(bool)], got[got["border"].astype(bool)]
    assert set(zip(star["a"], star["b"])) == {(5, 2), (7, 2), (9, 2), (21, 20)}
    assert set(zip(border["a"], border["b"])) == {(30, 2), (30, 40), (31, 20)}
    lone = K._joined_links(pd.DataFrame([(30, 40, True)], columns=["a", "b", "border"]))
    assert [tuple(r) for r in lone[["a", "b"]].to_numpy()] == [(30, 40)]
    assert not len(K._joined_links(pd.DataFrame({"a": np.zeros(0, int), "b": np.zeros(0, int), "border": np.zeros(0, bool)})))


def test_screen_with_values_that_are_not_numbers():
    X = np.random.default_rng(6).normal(size=(40, 9))
    for odd in (np.nan, np.inf, 1e200):
        Y = X.copy()
        Y[3, 2] = odd
        with np.errstate(all="ignore"):
            assert (B.near_matrix(X, Y, 12.0) == (B.sq_matrix(X, Y) <= 12.0)).all()


def _block_rows(X, number, e2, enough):
    import pandas as pd
    row = pd.DataFrame([{"blk": number, "grp": 0, "n": len(X), "ids": np.arange(len(X)) + 10_000 * number, "vecs": B.packed(X),
                         "centre": X.mean(0), "radius": 9.0, "w": np.ones(len(X), dtype=np.int64)}])
    celled = next(K._celled(e2)(iter([row])))
    return next(celled.itertuples()), next(next(K._rooted(e2, enough)(iter([celled.assign(more=None)]))).itertuples())


def test_blocks_look_only_into_near_cells(monkeypatch):
    """Two crowded blocks side by side and one far off point each: settled points are not counted again, and one
    link joins the crowds."""
    rng = np.random.default_rng(9)
    sides = [np.vstack([rng.uniform(0, 4, (600, 2)) + [shift, 0.0], [[shift, 30.0]]]) for shift in (0.0, 4.0)]
    (cx, x), (cy, y) = (_block_rows(P, k, 0.25, 5) for k, P in enumerate(sides))
    seen, real = [], B.near_matrix
    monkeypatch.setattr(B, "near_matrix", lambda X, Y, e2: seen.append(len(X) * len(Y)) or real(X, Y, e2))
    assert not len(K._weights_beyond(0.25, 5)(cx, cy)) and not seen
    got = K._links(0.25)(x, y)
    assert sum(seen) < 30_000                                  # 361,201 pairs in each visit before
    assert [tuple(r) for r in got.to_numpy()] == [(x.root[0], y.root[0], False)]


@pytest.mark.parametrize("seed,enough", [(1, 2), (2, 4), (3, 7), (4, 40)])
def test_dbscan_of_crowds_rings_and_odd_points(spark, monkeypatch, seed, enough):
    monkeypatch.setattr(B, "TILE_FROM", 3)
    rng = np.random.default_rng(seed)
    turn = rng.uniform(0, 2 * np.pi, 90)
    X = np.vstack([rng.normal(0, 0.2, (70, 2)), rng.normal(3, 0.6, (60, 2)), 4 * np.stack([np.cos(turn), np.sin(turn)], 1),
                   rng.uniform(-6, 6, (40, 2)), np.zeros((9, 2)), np.array(list(itertools.product(range(-7, -3), range(5))), dtype=float)])
    X = np.round(np.hstack([X, rng.integers(0, 2, (len(X), 1)) * 0.4]), 3)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in K.dbscan(_frame(spark, X), "id", 1.0, enough, rows=16).collect()}
    lab, core = dbscan(X, 1.0, enough)
    assert got == {i: (int(lab[i]), bool(core[i])) for i in range(len(X))}


def test_cells_and_gaps_hold_for_odd_numbers():
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(size=(50, 9)), np.zeros((30, 9)), [[1e200] * 9]])
    for P in (X, np.vstack([X, [[np.nan] * 9, [np.inf] * 9]])):
        with np.errstate(all="ignore"):
            order, first = B.cells(P, 4.0)
            Q = P[order]
            gap = B.gap2(*B.boxes(Q, first), *B.boxes(Q, first))
            near = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(P))))
            i, j = np.nonzero(B.sq_matrix(Q, Q) <= 4.0)
            assert sorted(order) == list(range(len(P))) and not (gap[near[i], near[j]] > 4.0).any()
            assert np.array_equal(np.frombuffer(B.packed(P)).reshape(P.shape), P, equal_nan=True)
    assert len(B.cells(X, 4.0)[1]) > 3
    assert len(B.packed(np.round(X[:9] * 8))) == 4 * 81


def test_a_block_travels_once_a_tile(spark, monkeypatch):
    monkeypatch.setattr(B, "TILE_FROM", 2)
    X = np.random.default_rng(7).normal(size=(512, 12))
    blocks = B.pack(_frame(spark, X), "id", rows=8)
    sent, real = [], N.wide_join
    monkeypatch.setattr(N, "wide_join", lambda *a, **k: sent.append(real(*a, **k).count()) or real(*a, **k))
    got = {(r.src, r.dst) for r in B.eps_pairs(blocks, 2.5).collect()}
    want, _ = pairs_within(X, 2.5)
    n = blocks.count()
    assert got == want and n >= 64 and sum(sent) < 8 * n       # 4,160 blocks travelled before
