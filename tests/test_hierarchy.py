"""Ward by reciprocal nearest neighbours against the plain greedy tree; cuts; ranks."""

import numpy as np
import pytest

from riskweave.operators import hierarchy as H
from riskweave.operators.ranks import with_rank

from bruteforce import components, ward_greedy


def _frame(spark, X, ids=None):
    ids = range(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, X)],
                                 "id long, features array<double>").repartition(5)


def _merges(tree):
    return sorted((r.a, r.b, round(r.height, 6), r.size) for r in tree.merges.collect())


@pytest.mark.parametrize("rows", [1024, 16])
def test_tree_equals_greedy_with_ties_and_copies(spark, rows):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.integers(0, 6, (220, 3)), rng.integers(20, 23, (60, 3)), [[50, 50, 50]] * 20]).astype(float)
    assert len(X) == 300 and len(np.unique(X, axis=0)) < 250           # many equal rows, many equal costs
    tree = H.ward_tree(_frame(spark, X), "id", rows=rows)
    want = ward_greedy(X)
    assert _merges(tree) == sorted((a, b, round(h, 6), n) for a, b, h, n in want)
    steps = [(r.step, r.height) for r in tree.merges.orderBy("step").collect()]
    assert [s for s, _ in steps] == list(range(1, 300)) and all(p[1] <= q[1] for p, q in zip(steps, steps[1:]))


def test_continuous_points_and_every_cut(spark):
    X = np.round(np.random.default_rng(5).normal(size=(40, 4)), 6)
    X[7] = X[3]
    tree = H.ward_tree(_frame(spark, X), "id", rows=8)
    merges = [(r.a, r.b) for r in tree.merges.orderBy("step").collect()]
    for k in (1, 2, 5, 17, 39, 40):
        got = {r.id: r.cluster for r in tree.labels(k).collect()}
        root = components(40, merges[:40 - k])
        number = {r: i for i, r in enumerate(sorted(set(root)))}
        assert [got[i] for i in range(40)] == [number[r] for r in root] and len(number) == k
    heights = sorted((r.height for r in tree.merges.collect()), reverse=True)
    cut = tree.cut_height(5).first()
    assert (cut.above, cut.below) == (heights[3], heights[4]) and abs(cut.colour_threshold - 0.7 * heights[0]) < 1e-12
    by_height = sorted((r.id, r.cluster) for r in tree.labels_below(cut.cut).collect())
    assert by_height == sorted((r.id, r.cluster) for r in tree.labels(5).collect())


def test_small_tables(spark):
    one = H.ward_tree(_frame(spark, np.array([[1.0, 2.0]]), [7]), "id")
    assert one.merges.count() == 0 and [tuple(r) for r in one.labels(1).collect()] == [(7, 0)]
    none = H.ward_tree(_frame(spark, np.array([[1.0]])).filter("id < 0"), "id")
    assert none.merges.count() == 0 and none.labels(1).count() == 0
    same = H.ward_tree(_frame(spark, np.ones((5, 2)), [9, 4, 6, 5, 8]), "id")
    assert _merges(same) == [(4, 5, 0, 2), (4, 6, 0, 3), (4, 8, 0, 4), (4, 9, 0, 5)]
    assert len({r.cluster for r in same.labels(3).collect()}) == 3


def test_rank_over_partitions(spark):
    rng = np.random.default_rng(1)
    vals = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 500))]
    got = with_rank(spark.createDataFrame(vals, "v long, i long").repartition(7), ["v", "i"]).collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r["rank"])] == sorted(vals)
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
