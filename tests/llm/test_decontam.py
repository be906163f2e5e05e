"""Decontamination against full edit-distance search."""

import random

import numpy as np
import pytest

from riskweave.llm import decontam


def sellers(item, text):
    """Least edits of the whole item against any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(prev[j - 1] + (a != b), prev[j] + 1, row[j - 1] + 1)
    return min(row)


def norm(s):
    raw = np.frombuffer((s or "").encode(), np.uint8)
    return decontam.normalise(raw, np.array([0, len(raw)]))[0].tobytes()


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "on", "er", "in", "é", "ñ", "ß", "ao"]) for _ in range(rng.randrange(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 8, 15, 25])))) for i in range(12)] + [(50, "tiny"), (51, "!!"), (52, None)]
    docs = []
    for i in range(70):
        words = [word() for _ in range(rng.randrange(0, 40))]
        if i % 2:
            t = list(rng.choice(items[:12])[1])
            for _ in range(rng.choice([0, 1, 3, 6, 12, 25])):
                p = rng.randrange(len(t))
                t[p:p + rng.choice([0, 1, 1])] = rng.choice(["", "x", "q", " "])
            t = "".join(t)
            t = rng.choice([t, t.upper(), t.replace(" ", ",  "), t[: len(t) // 2]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [t]
        docs.append((i, " ".join(words)))
    return items, docs + [(100, None), (101, ""), (102, "a Tiny one"), (103, "tinyest"), (104, docs[1][1]), (104, docs[1][1]), (None, items[0][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_full_search(spark, seed):
    items, docs = corpus(seed)
    want = set()
    for i, t in items:
        body = norm(t).strip()
        if not body:
            continue
        m = len(body)
        k = max(0, min(int(0.1 * m), m // decontam.Q - 1))
        for d, text in docs:
            if m < decontam.Q:
                if b" " + body + b" " in b" " + norm(text) + b" ":
                    want.add((d, i))
            elif sellers(body, norm(text)) <= k:
                want.add((d, i))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as start")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    clean = decontam.drop_contaminated(d, b)
    assert clean.columns == d.columns
    bad = {x for x, _ in want}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(x for x, _ in docs if x not in bad)


def test_span_and_blocks(spark, monkeypatch):
    text = "Before it. Ärger über   Straßen, ganz viele Wörter im Satz! After."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "ärger über straßen ganz viele wörter im satz"), (8, "nothing of this is anywhere in the text")],
                              "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    r, = decontam.contaminated(d, b).collect()
    assert (r["item_id"], r["edits"]) == (7, 0)
    assert text[r["start"]:r["end"]].startswith("Ärger") and text[r["start"]:r["end"]].endswith("Satz")
    assert decontam.contaminated(d.limit(0), b).collect() == []
    assert decontam.contaminated(d, b.limit(0)).collect() == []


def test_every_region_of_a_text(spark):
    passage = "The quick brown fox jumps over the lazy dog near the old river bank"
    near = passage.replace("lazy", "lazi").replace("river", "rivers")
    text = f"{passage}. some words between, é and more. {near}! tail {passage.upper()}{' x' * 50} hi there. Hi, hi"
    d = spark.createDataFrame([(1, text), (2, passage), (3, "aaaa " * 60)], "doc_id long, text string")
    b = spark.createDataFrame([(7, passage), (8, "hi"), (9, "aaaa " * 12)], "item_id long, text string")
    rows = decontam.contaminated(d, b).collect()
    of = lambda i, j: sorted((r["start"], r["end"], r["edits"]) for r in rows if (r["doc_id"], r["item_id"]) == (i, j))
    spans = of(1, 7)
    assert [e for _, _, e in spans] == [0, 2, 0] and [text[s:t].lower() for s, t, _ in spans] == [passage.lower(), near.lower(), passage.lower()]
    assert [text[s:t] for s, t, _ in of(1, 8)] == ["hi", "Hi", "hi"] and len(of(2, 7)) == 1
    runs = of(3, 9)
    assert len(runs) >= 4 and all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))
    assert [r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()] == []


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "a text with the passage of the benchmark in it")], "id long, Start string")
    b = spark.createDataFrame([("q", "the passage of the benchmark")], "id string, text string")
    got = decontam.contaminated(d, b, id_col="id", text_col="Start", item_col="id")
    assert got.columns == ["id", "benchmark_id", "edits", "start", "end"]
    assert got.first()[:3] == (1, "q", 0)
    got = decontam.contaminated(d.withColumnRenamed("id", "End"), b, id_col="End", text_col="Start", item_col="id")
    assert got.columns == ["End", "id", "edits", "start", "benchmark_end"] and got.count() == 1
