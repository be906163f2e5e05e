"""Phrase mining against a plain count, the graph's paths, and defined cases."""

import random
import re
from collections import Counter

from riskweave.llm import phrases as ph


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, k, least, cover):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for size in range(1, 5):
                for i in range(len(p) - size + 1):
                    f[lang, tuple(p[i:i + size])] += 1
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for lang in n:
        rows = []
        for (la, g), a in cand.items():
            if la != lang:
                continue
            if any(l2 == lang and len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   and 100 * b >= cover * a for (l2, h), b in cand.items()):
                continue
            cuts = [(2_000_000 * a // (f[lang, g[:c]] + f[lang, g[c:]]), c) for c in range(1, len(g))]
            score, c = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), f[lang, g[:c]], f[lang, g[c:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
                for r, (s, a, p, left, right) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def run(spark, docs, **how):
    d = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in ph.top_phrases(d, **how).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    fixed = ["New York City Hall opens today", "ÉTÉ indien à Paris", "one two three four five six seven eight nine"]
    words = ["a", "B", "c", "d e", "f\tg", "x.", "y,", "z\n", "Ñu", "new", "york", "q!"]
    out = []
    for _ in range(n):
        parts = [rng.choice(words) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(fixed))
        out.append((rng.choice(["en", "en", "fr", None]), " ".join(parts)))
    return out


def test_equals_a_plain_count(spark):
    docs = corpus(3, 60) + [("en", "the the the the the the the"), ("en", None), ("und", "a b c a b c"), (None, "a b c")]
    for how in ({"min_count": 2, "k": 2000, "cover_pct": 80}, {"min_count": 5, "k": 6, "cover_pct": 50}):
        assert run(spark, docs, **how) == brute(docs, how["k"], how["min_count"], how["cover_pct"])


def test_flows_equal_counts_in_the_texts(spark):
    docs = corpus(5, 40)
    graph = ph.build(spark.createDataFrame(docs, "lang string, text string"), min_count=3)
    word = {(r["lang"], r["h"]): r["word"] for r in graph.words.collect()}
    f = Counter()
    for lang, text in docs:
        for p in pieces(text):
            for size in range(1, 5):
                for i in range(len(p) - size + 1):
                    f[lang or "und", tuple(p[i:i + size])] += 1
    for size, table in enumerate(graph.counts, 1):
        got = {(r["lang"], tuple(word[r["lang"], r[c]] for c in ph.GRAM[:size])): r["f"] for r in table.collect()}
        assert got == {g: a for g, a in f.items() if len(g[1]) == size and a >= 3}
    graph.drop()


def test_paths_hold_whole_passages(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    docs = [("en", f"x{i} {passage} y{i}") for i in range(6)] + [("en", "p0 p1 p2 alone")] * 2 + [("fr", "m n o p q r")] * 5
    graph = ph.build(spark.createDataFrame(docs, "lang string, text string"), min_count=5)
    got = sorted((r["lang"], " ".join(r["words"]), r["weight"]) for r in graph.paths().collect())
    assert got == [("en", passage, 6), ("fr", "m n o p q r", 5)]
    graph.drop()


def test_defined_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None), (None, "")]) == []
    long = [("en", "deep blue sea " * 40_000 + "."), ("en", "w" * 200_000 + " w")]
    assert run(spark, long, min_count=30, cover_pct=101) == brute(long, 2000, 30, 101)
    clash = spark.createDataFrame([("en", "a b " * 40, 1, 2, 3)], "lang string, text string, n long, w1 long, f long")
    assert ph.top_phrases(clash).count() == 2
