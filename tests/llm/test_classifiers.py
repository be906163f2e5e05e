"""Held-out quality of the trained classifiers, and their defined edge cases."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import langid, quality, queries, toxicity
from riskweave.llm import textbits as tb

SF = "/root/testdata/sf0.01"


def edge_rows(spark):
    rows = [(10_001, None), (10_002, ""), (10_003, " \n\t"), (10_004, "12345 !!!"), (10_005, "the and of " * 40_000),
            (10_006, "漢字"), (10_006, "漢字"), (None, "the and of that")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as predicted")


def test_codebook_rows_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codebook(n)
        gaps = [(code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2)]
        assert set(np.unique(code)) == {-1, 1} and min(gaps) >= (1 if n == 2 else 2)
    assert langid.codebook(1).shape[0] == 1


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op2(spark, SF)
    assert out.count() == docs.count()
    right = out.join(docs, "doc_id").filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    model = langid.fit(docs, "doc_id", "text", "lang", 4, 2)
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(edge_rows(spark), model).collect()}
    for i in (10_001, 10_002, 10_003, 10_004):
        assert got[i, "und"]["score"] == 0.0
    assert got[10_005, "en"]["score"] > 0.5 and got[None, "en"]["ambiguous"] is not None
    assert (10_006, "und") not in got
    none = langid.fit(docs.limit(0), "doc_id", "text", "lang", 4, 2)
    assert none is None and {r["lang_pred"] for r in langid.identify(edge_rows(spark), none).collect()} == {"und"}


@pytest.mark.parametrize("name,label,cut", [("op4_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, cut):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = queries.QUERIES[name](spark, SF)
    assert out.count() == docs.count()
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    seen = out.join(labels, "doc_id").filter("held_out").select(label, "predicted", "score").toPandas()
    assert (seen[label] == seen["predicted"]).mean() >= cut
    hi, lo = (seen[seen[label] == v]["score"].mean() for v in (1, 0))
    assert hi > lo + 0.3


def test_classifier_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = edge_rows(spark)
    q = quality.fit(docs, labels, "doc_id", "text", "quality", 5, 0)
    assert quality.keep_good(rows, q).columns == rows.columns
    assert quality.score(rows.drop("score", "predicted"), q).count() == 8
    clash = quality.score(rows.withColumnRenamed("score", "Score"), q)
    assert clash.columns == ["doc_id", "text", "score", "predicted"] and clash.dtypes[2:] == [("score", "double"), ("predicted", "int")]
    assert len(clash.collect()) == 8
    assert len(quality.score(rows.drop("score").withColumnRenamed("text", "score"), q, text_col="score").collect()) == 8
    assert quality.score(rows.drop("score", "predicted").limit(0), q).collect() == []
    t = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 3, 1)
    got = toxicity.score(rows, t).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(rows.limit(0), t).collect() == []
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score(rows, toxicity.fit(docs, none, "doc_id", "text", "toxic", 3, 1)).collect()} <= {
        1 / (1 + np.exp(60.0))}
    assert all(r["predicted"] == 1 for r in quality.score(
        rows.drop("score", "predicted"), quality.fit(docs, none, "doc_id", "text", "quality", 5, 0)).collect())


def test_toxic_passage_in_a_long_text():
    rng = np.random.default_rng(0)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(900)]
    toxic = [" ".join([*rng.choice(words, 40), rng.choice(["vileness", "vilegurk", "vilemoos"]), "here"]) for _ in range(150)]

    def sets(texts):
        out = []
        for _, buf, offs in tb.chunks(pa.array(texts)):
            text, h = toxicity.features(buf, offs)
            out += [np.unique(h[text == i]) for i in range(len(offs) - 1)]
        return out
    model = toxicity.train(sets(toxic[:100]), sets(clean[:600] + toxic[100:130]), prior=0.05)
    long = " ".join(rng.choice(words, 20_000))
    test = pa.array([long, long + " VILEnew and more", clean[700], "", None])
    s = np.concatenate([model.score(b, o) for _, b, o in tb.chunks(test)])
    assert s[1] >= 0.7 and max(s[0], s[2], s[3], s[4]) < 0.7


def test_word_pairs_are_hashed_alike():
    """No pair of words has a feature made for it, and none reaches across texts."""
    _, buf, offs = next(tb.chunks(pa.array(["be be be to", "be", None])))
    words, pairs = list(quality.features(buf, offs))[:2]
    assert len(words[1]) == 5 and len(pairs[1]) == 3 and pairs[1][0] == pairs[1][1] != pairs[1][2]
    _, buf, offs = next(tb.chunks(pa.array(["a a", "to to"])))
    one, two = list(quality.features(buf, offs))[1][1]
    assert one != two
