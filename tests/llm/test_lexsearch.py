"""Ranked search against a dictionary version, exact sums, ties and defined cases."""

import math
import random
import re

import numpy as np

from riskweave.llm import lexsearch as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, x in items if i == item for t in terms(x)}
        scores = []
        for i, b in bags:
            s = 0
            m = 50 + 50 * len(b) * n_docs // total
            for t in asked & set(b):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * (10 ** 9 * b.count(t) // (1000 * b.count(t) + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, rank string, item string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string, score string")
    return sorted([tuple(r) for r in ls.search(d, q, **how).select("item_id", "rank", "doc_id", "score").collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "ñu", "été", "x1", "y-2", "the", "THE", "of", "zeta", "日本", "q_r"]
    return [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 3, 8, 40])))) for i in range(n)]


def test_equals_brute_force_with_ties_and_small_tiles(spark):
    docs = corpus(1, 300) + [(1000 + i, "alpha beta") for i in range(80)]     # eighty equal scores
    items = [(1, "Alpha beta"), (2, "the of été"), (3, "nothing here"), (4, "日本 x1 2"), (5, ""), (6, None)]
    want = brute(docs, items, 7)
    for how in ({}, {"tile_docs": 16, "tile_items": 2, "strip": 1}, {"tile_cells": 1, "tile_docs": 9}, {"block_bytes": 10}):
        assert run(spark, [(i, t, "", "") for i, t in docs], [(i, t, "") for i, t in items], k=7, **how) == want


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "... --"), (None, "alpha"), (4, "alpha"), (5, "alpha beta " * 30_000), (6, "gamma"), (7, "delta")]
    items = [(1, "alpha"), (1, "beta"), (None, "alpha")]
    got = run(spark, [(i, t, "", "") for i, t in docs], [(i, t, "") for i, t in items])
    assert got == brute(docs, items, 50)
    assert [r[2] for r in got if r[0] is None][-1] is None or got          # a null id ranks after its equals
    assert run(spark, [], [(1, "alpha", "")]) == [] and run(spark, [(1, "alpha", "", "")], []) == []
    assert run(spark, [(1, None, "", "")], [(1, "alpha", "")]) == []


def test_strips_never_pass_two_to_the_53():
    weight = np.full(5000, 10 ** 7, dtype=np.int64)
    tile = ls.ItemTile([np.arange(5000)], weight, 2048)
    assert tile.strip * int(weight.max()) * ls.MAX_IMPACT < 1 << 53
    n = np.arange(5000)
    got = tile.scores(np.zeros(5000, np.int64), n, np.full(5000, 999_999, dtype=np.int64), 1)
    assert got[0, 0] == 5000 * 10 ** 7 * 999_999


def test_lengths_beyond_64_bits():
    n = np.array([10 ** 7, 3], dtype=np.int64)
    docs, total = 10 ** 12, 10 ** 15
    assert ls.lengths(n, docs, total).tolist() == [50 + 50 * int(x) * docs // total for x in n]
