"""Synthetic ids stay distinct under forced collisions; matrix check sees its faults."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import privacy as P


def test_mapping_is_injective_when_every_candidate_collides(spark, monkeypatch):
    monkeypatch.setattr(P, "synthetic_id", lambda x, salt: F.concat(F.lit("99AAAAAAA"), F.when(
        F.col(x).endswith("7"), "K").otherwise("Z")))
    df = spark.range(700).select(F.col("id").cast("string").alias("nif"))
    m = P.id_mapping(df, "nif", "s").collect()
    assert len(m) == 700 and len({r.synthetic for r in m}) == 700
    assert sum(len(r.synthetic) == 10 for r in m) == 2


def test_anonymise_refuses_a_mapping_that_is_not_injective(spark, monkeypatch):
    monkeypatch.setattr(P, "id_mapping", lambda df, c, s: df.select(F.col(c).alias("original"), F.lit("X").alias("synthetic")))
    df = spark.createDataFrame([("a",), ("b",)], "nif string")
    with pytest.raises(ValueError):
        P.anonymise(df, "nif", "salt", 1.1, 3)


def test_anonymise_drops_internal_ids(spark):
    df = spark.createDataFrame([("12345678Z", 5, 1.0)], "nif string, rating_id int, precio double")
    out, _ = P.anonymise(df, "nif", "salt", 1.1, 3)
    assert set(out.columns) == {"nif", "precio"}


def test_check_feature_matrix(spark):
    good = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 0.0],)], "features array<double>")
    row = P.check_feature_matrix(good, 2).first()
    assert row.ok and row.constant_features == 1
    assert not P.check_feature_matrix(good, 3).first().ok
    wide = spark.createDataFrame([([2.0],), ([-2.0],)], "features array<double>")  # std 2
    assert not P.check_feature_matrix(wide, 1).first().ok
    holes = spark.createDataFrame([([1.0, None],), ([-1.0, 0.0],)], "features array<double>")
    assert not P.check_feature_matrix(holes, 2).first().ok
    assert not P.check_feature_matrix(good.filter("1 = 0"), 2).first().ok
