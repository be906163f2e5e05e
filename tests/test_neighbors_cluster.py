"""eps-join, components, DBSCAN, quality measures and Ward against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import cluster as K
from riskweave.operators import neighbors as N
from riskweave.operators import quality as Q

from bruteforce import components, dbscan, pairs_within, silhouette


def _points(spark, X, labels=None):
    rows = [(i, [float(v) for v in x], int(labels[i]) if labels is not None else 0) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def _blobs(seed=0, n=120, d=4):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 0.3, (n // 2, d))
    b = rng.normal(3, 0.5, (n // 2, d))
    X = np.round(np.vstack([a, b, a[:10]]), 6)  # identical copies of 10 points
    return X


@pytest.mark.parametrize("eps", [0.3, 0.8])
def test_eps_join_equals_brute_force(spark, eps):
    X = _blobs(1)
    got = {(r.src, r.dst) for r in N.eps_join(_points(spark, X), "id", eps).collect()}
    want, _ = pairs_within(X, eps)
    assert got == want


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2)) if a != b}
    v = spark.range(200)
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r.id: r.component for r in N.connected_components(v, e, "id").collect()}
    want = components(200, edges)
    assert [got[i] for i in range(200)] == want


@pytest.mark.parametrize("eps,ms", [(0.5, 5), (1.0, 3), (0.2, 10)])
def test_dbscan_equals_brute_force(spark, eps, ms):
    X = _blobs(2)
    lab, core = dbscan(X, eps, ms)
    out = {r.id: (r.cluster, r.is_core) for r in K.dbscan(_points(spark, X), "id", eps, ms).collect()}
    assert [out[i][0] for i in range(len(X))] == list(lab)
    assert [out[i][1] for i in range(len(X))] == list(core)


def test_dbscan_all_noise_and_one_cluster(spark):
    X = np.array([[0.0, 0.0], [10.0, 0.0], [20.0, 0.0]])
    assert {r.cluster for r in K.dbscan(_points(spark, X), "id", 1.0, 2).collect()} == {-1}
    Y = np.array([[0.0, 0.0]] * 5)
    assert {r.cluster for r in K.dbscan(_points(spark, Y), "id", 0.1, 5).collect()} == {0}


def test_quality_measures(spark):
    X = _blobs(4, n=80, d=3)
    lab = np.array([0] * 40 + [1] * 40 + [0] * 10)
    df = _points(spark, X, lab)
    s = Q.silhouette(df, "label").first().silhouette
    assert abs(s - silhouette(X, lab)) < 1e-9
    c = [X[lab == k].mean(0) for k in (0, 1)]
    S = [np.linalg.norm(X[lab == k] - c[k], axis=1).mean() for k in (0, 1)]
    db = (S[0] + S[1]) / np.linalg.norm(c[0] - c[1])
    assert abs(Q.davies_bouldin(df, "label").first()[0] - db) < 1e-9
    g = X.mean(0)
    ssb = sum((lab == k).sum() * ((c[k] - g) ** 2).sum() for k in (0, 1))
    ssw = sum(((X[lab == k] - c[k]) ** 2).sum() for k in (0, 1))
    ch = ssb / ssw * (len(X) - 2) / 1
    assert abs(Q.calinski_harabasz(df, "label").first()[0] - ch) / ch < 1e-9
    assert abs(K.wcss(df, "label").first()[0] - ssw) < 1e-6


def test_lloyd_step(spark):
    X = _blobs(5, n=60, d=2)
    C = X[:3]
    out = {r.cluster: r.centroid for r in K.lloyd_step(_points(spark, X), C).collect()}
    d = ((X[:, None, :] - C[None, :, :]) ** 2).sum(-1)
    a = d.argmin(1)
    for k in out:
        assert np.allclose(out[k], X[a == k].mean(0))


def test_kmeans_deterministic_and_partition_free(spark):
    X = _blobs(6, n=100, d=3)
    df = _points(spark, X)
    a, ca, wa = K.kmeans(df, "id", 2, n_init=2)
    b, cb, wb = K.kmeans(df.repartition(7), "id", 2, n_init=2)
    assert np.allclose(ca, cb) and abs(wa - wb) < 1e-6
    assert sorted(r.cluster for r in a.collect()) == sorted(r.cluster for r in b.collect())


def test_nearest_labelled_ties_lowest_id(spark):
    pts = _points(spark, np.array([[0.0, 0.0], [2.0, 0.0]]))
    sample = spark.createDataFrame([(5, [1.0, 0.0], 50), (3, [-1.0, 0.0], 30)],
                                   "sid long, features array<double>, label int")
    out = {r.id: r.label for r in N.nearest_labelled(pts, sample, "id", "label", sample_id="sid").collect()}
    assert out == {0: 30, 1: 50}


def test_eps_join_salted_hot_cells(spark):
    # every point in a handful of cells; a tiny cell bound forces the salting path
    X = _blobs(8, n=100, d=5)
    got = {(r.src, r.dst) for r in N.eps_join(_points(spark, X), "id", 1.5, max_cell=7).collect()}
    want, _ = pairs_within(X, 1.5)
    assert got == want


def test_eps_join_by_group_salted(spark):
    X = _blobs(9, n=60, d=3)
    df = _points(spark, X).withColumn("g", (F.col("id") % 3).cast("int"))
    got = {(r.src, r.dst) for r in N.eps_join(df, "id", 1.0, by="g", max_cell=4).collect()}
    want = {(i, j) for i, j in pairs_within(X, 1.0)[0] if i % 3 == j % 3}
    assert got == want


def test_eps_join_blocked_high_dim(spark):
    rng = np.random.default_rng(11)
    X = np.round(np.vstack([rng.normal(0, 0.3, (70, 20)), rng.normal(0.5, 0.3, (50, 20))]), 6)
    df = _points(spark, X).withColumn("w", F.col("id") % 3)
    out = N.eps_join(df, "id", 1.3, carry=["w"], max_cell=16).collect()
    want, D = pairs_within(X, 1.3)
    assert {(r.src, r.dst) for r in out} == want
    assert all(r.src_w == r.src % 3 and r.dst_w == r.dst % 3 and abs(r.dist - D[r.src, r.dst]) < 1e-9 for r in out)


def test_nearest_labelled_in_blocks_equals_broadcast(spark):
    rng = np.random.default_rng(8)
    X = np.round(rng.normal(size=(400, 3)), 3)
    S = np.round(rng.normal(size=(90, 3)), 3)
    S[50:60] = S[:10]  # ties: the lower id wins
    pts = _points(spark, X).drop("label")
    sample = _points(spark, S, rng.integers(0, 5, 90)).withColumnRenamed("id", "sid")
    few = {r.id: (r.label, r.nearest_id) for r in N.nearest_labelled(pts, sample, "id", "label", sample_id="sid").collect()}
    many = {r.id: (r.label, r.nearest_id) for r in N.nearest_labelled(
        pts, sample, "id", "label", sample_id="sid", max_broadcast_rows=10).collect()}
    assert len(few) == 400 and few == many


def test_silhouette_ties_noise_and_one_cluster(spark):
    X = _blobs(6)
    lab = np.array([0] * 60 + [1] * 60 + [-1] * 10)
    want = silhouette(X[:120], lab[:120])
    row = Q.silhouette(_points(spark, X, lab), "label", noise=-1).first()
    assert abs(row.silhouette - want) < 1e-9 and row.n_evaluated == 120 and row.sampled is False
    assert Q.silhouette(_points(spark, X), "label").first().silhouette is None
    empty = Q.silhouette(_points(spark, X).filter("id < 0"), "label").first()
    assert empty.silhouette is None and empty.n_evaluated == 0


def test_silhouette_of_many_rows(spark):
    """60,000 rows on 3,000 distinct vectors: as the brute force over weighted points."""
    rng = np.random.default_rng(9)
    X = np.round(rng.normal(size=(3000, 2)), 3)
    lab = (X[:, 0] > 0).astype(int)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)) * 20
    same = lab[:, None] == lab[None, :]
    a = (D * same).sum(1) / (20 * same.sum(1) - 1)
    b = (D * ~same).sum(1) / (20 * (~same).sum(1))
    want = float(np.mean((b - a) / np.maximum(a, b)))
    df = _points(spark, X, lab).crossJoin(spark.range(20).select(F.col("id").alias("copy")))
    row = Q.silhouette(df, "label").first()
    assert row.n_evaluated == 60_000 and abs(row.silhouette - want) < 1e-7


def test_elbow_equals_kmeans_and_queries_try_the_whole_curve(spark, monkeypatch):
    from riskweave.plans import queries_cluster as QC
    from riskweave.plans import queries_report as QR
    df = _points(spark, _blobs(8, n=60, d=3))
    for r in K.elbow(df, "id", range(2, 4), n_init=2).collect():
        assert abs(r["wcss"] - K.kmeans(df, "id", r["k"], n_init=2)[2]) < 1e-6

    class Asked(Exception):
        pass

    def kmeans(*a, n_init, **kw):
        raise Asked(n_init)

    asked = []
    monkeypatch.setattr(QC, "lowd", lambda *a: df)
    monkeypatch.setattr(QR, "lowd", lambda *a: df)
    monkeypatch.setattr(K, "elbow", lambda d, i, ks, n_init, **kw: asked.append((list(ks), n_init)))
    monkeypatch.setattr(K, "elbow_choice", lambda w: w)
    monkeypatch.setattr(K, "kmeans", kmeans)
    QC.q_elbow(spark, "")
    QC.q_elbow_choice(spark, "")
    assert asked == [(list(range(2, 31)), 10)] * 2
    with pytest.raises(Asked, match="^10$"):
        QR._four_methods(spark, "")


def test_elbow_does_not_depend_on_parallel_starts(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2)]) for i in range(200)], "id long, features array<double>")
    one = K.elbow(df, "id", range(2, 4), n_init=2, parallelism=1).collect()
    assert K.elbow(df, "id", range(2, 4), n_init=2, parallelism=None).collect() == one


def test_grid_of_blocks_meets_every_pair_once_in_few_cells(spark):
    import pandas as pd
    df = spark.range(1600).select("id", F.lit(0).alias("y"), F.array(F.col("id").cast("double")).alias("features"))
    blocks = N.pack_blocks(df.coalesce(1), "id", "y", rows=10)
    assert blocks.count() == 160
    # the last two columns of a copy are its cell
    met = lambda x, y: pd.DataFrame({"i": [x.blk], "j": [y.blk], "row": [x[-2]], "col": [x[-1]]})
    got = N.pair_blocks(blocks, blocks, met, "i long, j long, row int, col int").toPandas()
    assert len(got) == 160 * 160 == len(got.drop_duplicates(["i", "j"]))
    assert len(got.drop_duplicates(["row", "col"])) <= 160 * 160 // 200
