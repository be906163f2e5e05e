"""Exact and sketched quantiles, moments, method comparison, alerts under skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import quality as Q
from riskweave.operators import report as RP
from riskweave.operators.ranks import quantiles
from riskweave.streaming import alerts as AL


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.integers(0, 7, 301).astype(float), "b": rng.normal(size=40), None: np.array([5.0]), "hot": np.full(2000, 3.25)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles(df, ["g"], "x", probs).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g][0] == len(vs) and np.allclose(got[g][1], np.quantile(vs, probs), atol=1e-12)
    everything = np.concatenate(list(data.values()))
    assert np.allclose(quantiles(df, [], "x", probs).first()["q"], np.quantile(everything, probs))
    assert quantiles(df.filter("x > 99"), ["g"], "x", probs).count() == 0


def test_sketch_error_is_bounded(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    exact = np.sort([i * 7919 % 100_003 for i in range(100_000)]).astype(float)
    q = quantiles(df, ["g"], "x", [0.25, 0.5, 0.9], approx=200).first()["q"]
    for p, v in zip([0.25, 0.5, 0.9], q):
        assert abs(np.searchsorted(exact, v) - p * len(exact)) <= len(exact) / 200 + 1


def test_box_stats_with_null_group_and_empty_values(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 100]] + [(None, 7.0), ("none", None)]
    got = {r["g"]: r for r in Q.box_stats(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert set(got) == {"a", None, "none"}
    assert (got["a"]["q1"], got["a"]["med"], got["a"]["q3"], got["a"]["whishi"], got["a"]["n_fliers"]) == (2, 3, 4, 4, 1)
    assert got[None]["med"] == 7 and got["none"]["med"] is None and got["none"]["n_fliers"] == 0


def test_moments_and_scores_without_joining_rows_to_centroids(spark):
    rng = np.random.default_rng(2)
    X, lab = rng.normal(100, 1, (90, 3)), np.arange(90) % 3
    X[lab == 1] += 3
    df = spark.createDataFrame([(int(g), [float(v) for v in x]) for g, x in zip(lab, X)], "g int, features array<double>")
    ssw = sum(((X[lab == g] - X[lab == g].mean(0)) ** 2).sum() for g in range(3))
    ssb = sum((lab == g).sum() * ((X[lab == g].mean(0) - X.mean(0)) ** 2).sum() for g in range(3))
    ch = Q.calinski_harabasz(df, "g").first()[0]
    assert np.isclose(ch, ssb / ssw * (90 - 3) / 2, rtol=1e-8)
    c = [X[lab == g].mean(0) for g in range(3)]
    s = [np.sqrt(((X[lab == g] - c[g]) ** 2).sum(1)).mean() for g in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert np.isclose(Q.davies_bouldin(df, "g").first()[0], db)
    plan = Q.calinski_harabasz(df, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1                            # two one-row tables only


def test_method_comparison_has_every_metric_and_null_where_missing(spark):
    d = spark.createDataFrame([(i, i >= 6, [float(i), 0.0]) for i in range(10)], "id int, label boolean, features array<double>")
    part = spark.createDataFrame([(i, "hi" if i >= 6 else "-1" if i == 0 else "lo") for i in range(10)], "id int, grp string")
    nodes = spark.createDataFrame([(i, f"n{j}") for i in range(1, 10) for j in {i // 3, (i + 1) // 3}], "id int, node string")
    stacked = RP.stack_labelings({"part": part, "graph": nodes}, {"part": "-1"})
    m = RP.predictive_metrics(stacked, d, "label").unionByName(RP.quality_metrics(stacked, d, ["part"]))
    got = {r["metric"]: (r["part"], r["graph"]) for r in RP.method_comparison(m, ["part", "graph"]).collect()}
    assert set(got) == set(RP.METRICS)
    assert got["precision"][0] == got["recall"][0] == 1.0 and got["n_groups"] == (2.0, 4.0)
    assert got["pct_outliers"] == (10.0, 10.0) and got["exclusive_groups"] == (1.0, 0.0) and got["pct_overlap"][1] > 0
    assert got["silhouette"][1] is None and got["silhouette"][0] > 0
    best = RP.executive_summary(RP.label_balance(d, "label"), m).first()
    assert (best["best_method"], best["n_total"], best["n_morosos"]) == ("part", 10, 4)


@pytest.mark.parametrize("cell", [1, 4096])
def test_alerts_with_a_cell_holding_most_cores(spark, cell):
    rng = np.random.default_rng(3)
    X = np.round(np.vstack([rng.normal(0, 0.05, (60, 3)), rng.normal(4, 0.4, (30, 3))]), 5)
    df = spark.createDataFrame([(i, bool(i % 3 == 0), [float(v) for v in x]) for i, x in enumerate(X)],
                               "id long, label boolean, features array<double>")
    model = AL.fit_alert_model(df, "id", "label", None, 0.8, 4, max_cell=cell)
    got = {r["id"]: (r["cluster"], r["distance"]) for r in AL.risk_alerts(df, model, "id").collect()}
    cores = [(r["core_id"], np.array(r["features"]), r["cluster"]) for r in model.cores.collect()]
    for i, x in enumerate(X):
        near = sorted((float(((x - f) ** 2).sum()), c, cl) for c, f, cl in cores if ((x - f) ** 2).sum() <= 0.64 + 1e-12)
        assert got[i][0] == (near[0][2] if near else None)
    assert len(got) == 90
