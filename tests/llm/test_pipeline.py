"""The pipeline against the operators' own rules, stage by stage."""

import corpus_pipeline
from riskweave.llm import queries

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passages = [" ".join(r["text"].split()).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, before, seen = docs.columns, docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "encode":
            assert after.columns == columns
        seen[name] = {r["doc_id"]: r for r in after.collect()}
        before = after
    start = {r["doc_id"] for r in docs.collect()}
    gone = start - set(seen["quality"])
    known = [i for i in start if i in labels]
    assert sum((labels[i] == 0) == (i in gone) for i in known) >= 0.97 * len(known)
    assert set(seen["line_dedup"]) == set(seen["quality"])
    lines = {}
    for i, r in seen["line_dedup"].items():
        assert r["n_chars"] == len(r["text"])
        for line in r["text"].split("\n"):
            if len(line.strip()) >= 10:
                lines.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), set()).add(i)
    assert all(len(v) == 1 for v in lines.values())
    assert set(seen["near_copies"]) <= set(seen["line_dedup"])
    clean = seen["decontaminate"]
    for i, r in seen["near_copies"].items():
        text = " ".join(r["text"].split()).lower()
        if any(p in text for p in passages):
            assert i not in clean
    assert len(clean) >= 0.9 * len(seen["near_copies"])
    assert set(seen["encode"]) == set(clean)
    assert all(r["n_tokens"] > 0 or not clean[i]["text"] for i, r in seen["encode"].items())


def test_run_is_registered(spark):
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality"
