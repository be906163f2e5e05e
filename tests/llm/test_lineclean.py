"""Line-first cleaning against a plain Python version, and its defined cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from riskweave.llm import lineclean as lc

GOOD = "The river ran past the old mill, and nobody in the village could say who had built it."
TEXT = "\n".join(" ".join(f"word{line}{c}" for c in "abcdefghijkl") + "." for line in range(6))


def words(s):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]


def plain(text, r=lc.Rules()):
    """The report of one text, straight from the docstring."""
    text = text or ""
    ws = words(text)
    tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    seen, dup, bad, left = set(), 0, 0, 0
    for line in text.split("\n"):
        w = words(line)
        if not w:
            continue
        sym = sum(c in "#*$%&|<>" for c in line)
        caps, letters = (sum(bool(re.match(p, c)) for c in line) for p in ("[A-Z]", "[A-Za-z]"))
        again = line in seen
        seen.add(line)
        dup += again
        fails = (100 * sym > r.symbols_pct * len(w)
                 or len(w) >= r.shout_words and (100 * line.count("!") > r.shout_pct * len(w) or 100 * caps > r.caps_pct * letters)
                 or w[-1][-1] not in lc.END and (len(w) < r.short_words or not re.search("[.,;:!?]", line))
                 or len(w) >= r.mono_words and 100 * len(set(w)) < r.mono_pct * len(w)
                 or any(p in line.lower() for p in lc.PHRASES) or again)
        bad += fails
        left += 0 if fails else sum(map(len, w))
    chars = sum(map(len, ws))
    base = len(ws) < r.min_words or 100 * len(hit) > r.max_repeat_pct * len(ws)
    return (len(ws), chars, sum(c in "#*$%&|<>" for c in text), dup, len(hit), base,
            not base and 100 * left >= r.min_left_pct * chars, bad, left)


def judged(texts, rules=lc.Rules()):
    raw = [(t or "").encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
    f = lc.judge(np.frombuffer(b"".join(raw), dtype=np.uint8), offs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed", "left_chars")
    return [tuple(f[c][i].item() for c in names) for i in range(len(texts))]


PIECES = st.lists(st.sampled_from(["a", "A", "b.", "Bé!", "c", "\n", "\n", " ", "\t", "\r", "|", "All Rights Reserved", "#", "!", "ñ»", "x,"]),
                  max_size=40).map(lambda p: " ".join(p).replace(" \n ", "\n"))


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_equals_the_plain_version(texts):
    small = lc.Rules(min_words=4, mono_words=5, short_words=3)
    assert judged(texts, small) == [plain(t, small) for t in texts]


def test_lines_go_first_then_documents(spark):
    nav = "Home | News | Sport | Weather | About | Contact"
    shout = "BUY NOW AND SAVE BIG MONEY TODAY!!"
    docs = [(1, TEXT), (2, TEXT + "\n" + nav + "\n" + shout), (3, "\n".join([f"Home{i} | News{i} | Sport{i} | Weather{i}" for i in range(30)] + [GOOD])),
            (4, TEXT + "\n" + GOOD + "\n" + GOOD), (5, TEXT + "\nCopyright 2020. All rights reserved.")]
    rows = {r["doc_id"]: r for r in lc.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1]["cleaned"] == TEXT and rows[1]["kept"] and rows[1]["n_failed"] == 0
    assert rows[2]["cleaned"] == TEXT and rows[2]["kept"] and rows[2]["n_failed"] == 2
    assert not rows[3]["kept"] and not rows[3]["base_failed"]
    assert rows[4]["cleaned"] == TEXT + "\n" + GOOD and rows[4]["n_dup_lines"] == 1
    assert rows[5]["cleaned"] == TEXT and rows[5]["failed_by"][lc.RULES.index("boilerplate")] == 1


def test_defined_cases(spark):
    schema = "doc_id long, text string, kept string, n_words string, id string"
    docs = [(1, None, "x", "y", "z"), (2, "", None, None, None), (None, TEXT, "a", "b", "c"), (3, TEXT, "", "", ""),
            (3, TEXT, "", "", ""), (4, "\n\n \t\n", "", "", ""), (5, "w" * 300_000 + "\n" + TEXT, "", "", "")]
    out = lc.rule_report(spark.createDataFrame(docs, schema)).collect()
    assert len(out) == 7
    for r in out:
        if r["doc_id"] in (1, 2, 4):
            assert r["base_failed"] and not r["kept"] and r["n_words"] == 0
    assert sum(r["doc_id"] == 3 and r["kept"] for r in out) == 2
    assert [r["kept"] for r in out if r["doc_id"] == 5] == [False]      # one endless unfinished line
    empty = spark.createDataFrame([], schema)
    assert lc.rule_report(empty).count() == 0 and lc.keep_clean(empty).count() == 0


@pytest.mark.parametrize("fold", [0])
def test_good_documents_stay(spark, fold):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = lc.rule_report(docs).join(labels, "doc_id").filter("n_words >= 50").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1
