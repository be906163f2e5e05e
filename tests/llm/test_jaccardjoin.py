"""Jaccard components against all pairs on small corpora."""

import random
import re

import pytest

from riskweave.llm import jaccardjoin


def shingles(text, size=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            inter = len(a & b)
            if 100 * inter >= 75 * (len(a) + len(b) - inter):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    nxt = iter(range(10_000))
    passage = [rng.choice(vocab) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 90]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((next(nxt), (" ", "\n", " \t ")[rng.randrange(3)].join(w)))
    for _ in range(40):                               # a long common passage, more or less text of its own
        extra = [rng.choice(vocab) for _ in range(rng.choice([0, 2, 5, 10, 15, 20, 60]))]
        rows.append((next(nxt), " ".join(passage + extra)))
    drift = [rng.choice(vocab) for _ in range(80)]
    for _ in range(40):                               # a chain: each link close, the ends far apart
        drift[rng.randrange(80)] = rng.choice(vocab)
        rows.append((next(nxt), " ".join(drift)))
    rows += [(next(nxt), "Same Words here Now and then") for _ in range(30)]
    rows += [(next(nxt), "be " * 200), (next(nxt), "BE " * 150), (next(nxt), "one two"), (next(nxt), "One\x0bTWO")]
    rows += [(next(nxt), None), (next(nxt), ""), (next(nxt), " \n "), (next(nxt), " ")]
    rows += [(5, "a b c d e f g"), (None, "Same Words here Now and then"), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:                                      # a small sketch and split shingles change nothing
        monkeypatch.setattr(jaccardjoin, "HOT_ROWS", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccardjoin.jaccard_components(df, sketch_bits=20 if seed == 1 else 16).collect()), key=str)
    assert got == brute(rows)


def test_drop_near_copies_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A b c d e  f", 2), (9, "other", 3), (None, None, 4)],
                               "doc_id long, text string, component_id int")
    kept = jaccardjoin.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["component_id"] for r in kept.collect()) == [2, 3, 4]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccardjoin.jaccard_components(none).collect() == []
