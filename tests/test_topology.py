"""Cover, Mapper, persistence against brute force / known shapes."""

import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import topology as TP


def _pts(spark, X):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, features array<double>")


def test_cover_matches_definition(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 5, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, l0 double")
    got = {(r.id, r.cube) for r in TP.cover(df, "id", ["l0"], 7, 0.4).collect()}
    R = x.max() - x.min()
    start, stop = x.min() + R / 14, x.max() - R / 14
    step = (stop - start) / 6
    r = R / (14 * (1 - 0.4))
    want = {(i, c) for i in range(300) for c in range(7) if abs(x[i] - (start + c * step)) <= r}
    assert got == want


def test_mapper_two_blobs(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(5, 0.2, (60, 2))])
    df = _pts(spark, X).select("id", "features", F.col("features")[0].alias("l0"))
    mem = TP.mapper(df, "id", ["l0"], 4, 0.3, 0.6, 4)
    lab = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "id long, y int")
    nodes = TP.node_rates(mem, lab, "id", "y")
    edges = TP.nerve(mem, "id")
    g = TP.graph_metrics(nodes, edges).first()
    assert g.n_componentes >= 2 and {round(r.tasa) for r in nodes.collect()} == {0, 1}
    assert all(r.tasa in (0.0, 1.0) for r in nodes.collect())


def test_mapper_broadcasts_no_table_of_every_row(spark, monkeypatch):
    """Written tables of repeated values look small on disk; their joins must not pass through the driver."""
    x = F.col("id") % 7
    df = spark.range(5000).select("id", F.array(x.cast("double"), x.cast("double")).alias("features"), x.cast("double").alias("l0"))
    seen = []
    real = TP.dbscan
    monkeypatch.setattr(TP, "dbscan", lambda pts, *a, **k: seen.append(pts) or real(pts, *a, **k))
    mem = TP.mapper(df, "id", ["l0"], 4, 0.3, 0.6, 4)
    nodes = TP.node_rates(mem, df.select("id", (x == 1).alias("y")), "id", "y")
    seen += [mem, TP.nerve(mem, "id"), nodes]
    for table in seen:
        table.collect()
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert mem.select("id").distinct().count() == 5000
