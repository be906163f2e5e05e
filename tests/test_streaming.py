"""Streaming alerts equal batch alerts (file source, foreachBatch)."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from riskweave.streaming import alerts as AL


def test_stream_equals_batch(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(0, 0.3, (80, 3)), rng.normal(3, 0.3, (80, 3)), rng.uniform(-5, 8, (10, 3))])
    rows = [(i, int(i >= 80), *map(float, x)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double")
    model = AL.fit_alert_model(df, "id", "y", ["a", "b", "c"], 1.0, 5)
    batch = {r.id: (r.cluster, r.nivel) for r in AL.risk_alerts(df, model, "id").collect()}
    base = tempfile.mkdtemp(prefix="rw-stream-")
    src, out, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 4)):
        df.filter(F.col("id").isin([int(x) for x in part])).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = AL.start_alert_stream(stream, model, "id", out, ck)
    q.awaitTermination(120)
    got = {r.id: (r.cluster, r.nivel) for r in spark.read.parquet(out).collect()}
    assert got == batch
    assert {v[1] for v in batch.values()} >= {"alto", "bajo", "revisar"}


def test_replayed_batch_is_stored_once(spark):
    rows = [(i, int(i >= 20), float(i % 5), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    model = AL.fit_alert_model(df, "id", "y", ["a", "b"], 1.0, 3)
    out = f"{tempfile.mkdtemp(prefix='rw-replay-')}/out"
    for _ in range(2):
        AL.write_alert_batch(df, 7, model, "id", out)
    assert spark.read.parquet(out).groupBy("batch_id").count().collect()[0]["count"] == 40


def test_vectors_of_cores_are_not_compared(spark, monkeypatch):
    rows = [(i, i % 3 == 0, [float(i % 40) / 100, -0.0 if i % 2 else 0.0]) for i in range(80)] + [(100, True, [0.885, 0.0]), (101, False, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, label boolean, features array<double>")
    model = AL.fit_alert_model(df, "id", "label", None, 0.5, 5)
    met, real = [], AL.spread_join
    monkeypatch.setattr(AL, "spread_join", lambda left, *a, **k: met.append(left.count()) or real(left, *a, **k))
    got = {r.id: r for r in AL.risk_alerts(df, model, "id").collect()}
    assert met[0] == 18                                        # cells of two vectors; of 42 before
    assert all(got[i].distance == 0.0 and got[i].cluster == 0 for i in range(80))
    assert abs(got[100].distance - 0.495) < 1e-12 and got[101].nivel == "revisar" and got[101].distance is None
