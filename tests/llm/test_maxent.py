"""Language-model scores: exact counts and base, a proper distribution, and a gain over the base."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from riskweave.llm import maxent, queries
from riskweave.llm import textbits as tb

SF = "/root/testdata/sf0.01"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    c = collections.Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in rows:
        ts = tokens(x)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        out.append((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(base, 6)))
    return sorted(out, key=str)


def plain(rows):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=str)


def test_counts_and_gain_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5(spark, SF).collect()
    assert plain(got) == brute(rows)
    for part in (True, False):
        some = [r for r in got if r["held_out"] == part]
        assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some) + 0.4 * sum(r["n_tokens"] for r in some)
    assert all(r["score"] <= 0 for r in got)


def test_edges(spark):
    rows = [(i, f"the word w{i % 7} and then the word x{i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "THE Word"), (103, "other text of one id"), (103, "the word"), (None, "the null id"),
             (104, "never seen before by anyone " * 3000), (105, "é è É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as h", "3 as key").repartition(4)
    for hot in (200_000, 5):                               # all words broadcast, or almost all joined
        got = maxent.score_texts(df, rounds=1, hot_words=hot).collect()
        assert plain(got) == brute(rows)
    assert maxent.score_texts(df.limit(0)).collect() == []
    alone = [i for i in range(200) if held(i)][:2]
    only_held = spark.createDataFrame([(alone[0], "a b"), (alone[1], None)], "doc_id long, text string")
    got = maxent.score_texts(only_held).collect()
    assert len(got) == 2
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 and abs(r["score"]) < 1e-9 for r in got)


def _toy_frame(seed=1):
    rng = np.random.default_rng(seed)
    leaves = np.where(rng.random((maxent.CLASSES, 64)) < 0.7, rng.integers(1, 500, (maxent.CLASSES, 64)) + 0.2, 0).astype(np.float32)
    return maxent.Frame(leaves.sum() + 40, 300, 40, np.zeros(0, np.uint64), np.zeros(0), leaves)


def test_class_factor_sums_to_one_and_zero_weights_are_the_masses():
    frame = _toy_frame()
    s = maxent.Stream(*next(tb.chunks(pa.array(["one two three " * 20, None])))[1:])
    for seed in (None, 3):
        w = maxent.start_weights()
        if seed:
            w = np.random.default_rng(seed).normal(size=w.shape).astype(np.float32)
        p = np.stack([np.exp(maxent.class_scores(w, frame, s, np.full(len(s.hash), c))) for c in range(maxent.ALL)])
        assert np.allclose(p.sum(axis=0), 1, atol=1e-6)
        assert np.allclose(p[maxent.UNK], maxent.SMOOTH / frame.mass.sum())
        if seed is None:
            assert np.allclose(p[:maxent.END + 1], (frame.mass / frame.mass.sum())[:maxent.END + 1, None], rtol=1e-4)


def test_word_factor_sums_to_one_and_is_the_count_rule():
    frame = _toy_frame()
    rng = np.random.default_rng(2)
    live = np.flatnonzero(frame.leaves.ravel() > 0)
    hist = np.repeat(np.arange(5, dtype=np.uint64), len(live))
    every = (hist << np.uint64(32)) + np.tile(live, 5).astype(np.uint64)             # one held-out entry of every leaf
    seen = every[rng.integers(0, 3 * len(live), 400)]                                # two histories stay unseen
    n = rng.integers(1, 4, 400)
    order = rng.permutation(len(every) + 400)
    pair, count, held = np.r_[every, seen][order], np.r_[np.ones(len(every), int), n][order], np.r_[np.ones(len(every), int), np.zeros(400, int)][order]
    got = maxent.pair_scores(frame, pair, count, held)
    value = dict(zip(pair.tolist(), got))
    counts = collections.Counter()
    for k, x in zip(seen.tolist(), n.tolist()):
        counts[k] += x
    for h in range(5):
        for c in range(maxent.CLASSES):
            keys = [(h << 32) + int(x) for x in live if x >> frame.bits == c]
            assert abs(sum(math.exp(value[k]) for k in keys) - 1) < 1e-6
            total, types = sum(counts[k] for k in keys), sum(counts[k] > 0 for k in keys)
            for k in keys:
                share = float(frame.leaves.ravel()[k & 0xFFFFFFFF]) / frame.mass[c]
                want = (counts[k] + types * share) / (total + types) if total else share
                assert abs(math.exp(value[k]) - want) < 1e-9


def test_packed_pairs_come_back():
    rng = np.random.default_rng(5)
    prev = rng.integers(0, 6, 3000).astype(np.uint64)
    leaf, doc = rng.integers(0, 40, 3000), np.sort(rng.integers(0, 50, 3000))
    held = rng.random(50) < 0.3
    got, where = collections.Counter(), {}
    for bucket, data in maxent.pack_pairs(prev, leaf, doc, held, 2, 7):
        for p, d, n, flag in zip(*maxent.unpack_pairs(data)):
            got[int(p), int(d)] += int(n)
            assert flag == held[d] and where.setdefault(int(p) >> 2, bucket) == bucket   # a (word before, class) is in one bucket
    hist = (tb.mix(prev) >> np.uint64(32)).astype(np.int64)
    assert got == collections.Counter(((int(h) << 32) + int(x), int(d)) for h, x, d in zip(hist, leaf, doc))


def test_packed_sums_add_up():
    rng = np.random.default_rng(4)
    want, runs = collections.Counter(), []
    for _ in range(5):
        key = np.unique(rng.integers(0, 20_000, 3000)) + (3 << 40)
        value = -rng.random(len(key)) * 50
        want.update(dict(zip(key.tolist(), value)))
        runs += maxent.pack_sums(key, value)
    runs.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([d for _, d in part], pa.binary())], names=["key", "pairs"])
               for part in (runs[:7], runs[7:7], runs[7:])]
    rows = [r for b in maxent.add_sums(batches) for r in b.to_pylist()]
    got = {r["key"]: r["s2"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-5 for k, v in want.items())
    assert list(maxent.add_sums([])) == []


def test_every_training_text_is_in_one_round(spark, monkeypatch):
    rows = [(i, f"word w{i}") for i in range(200)] + [(None, f"no id {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, inner = [], maxent._round

    def round_(texts, *rest):
        seen.extend(r["text"] for r in texts.collect())
        return inner(texts, *rest)

    monkeypatch.setattr(maxent, "_round", round_)
    maxent.score_texts(df, rounds=2, tasks=2).collect()
    assert sorted(seen) == sorted(x for i, x in rows if not held(i))


def test_rare_words_follow_their_history(spark):
    n = 60                                              # one class by its last bytes
    rows = [(i, f"left{i % n} right{i % n}end") for i in range(6000) if not held(i)]
    ids = [i for i in range(6000, 9000) if held(i)][:2 * n]
    tries = [(a, f"left{j} right{j}end") for j, a in enumerate(ids[:n])]
    tries += [(b, f"left{j} right{(j + 1) % n}end") for j, b in enumerate(ids[n:])]
    df = spark.createDataFrame(rows + tries, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in maxent.score_texts(df, tasks=1).filter("held_out").collect()}
    gain = sorted(got[a] - got[b] for a, b in zip(ids[:n], ids[n:]))
    assert gain[n // 10] > 0.1


def test_held_out_texts_score_like_a_bigram_model(spark):
    """Within 0.05 log10 a token of an interpolated bigram, far from the unigram base."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    one, two = collections.Counter(), collections.Counter()
    for i, x in rows:
        if not held(i):
            ts = tokens(x)
            one.update(ts)
            two.update(zip([0] + ts[:-1], ts))
    total, after = collections.Counter(), collections.Counter()
    for (a, _), n in two.items():
        total[a] += n
        after[a] += 1
    z, score, n = sum(one.values()) + 0.1 * (len(one) + 1), 0.0, 0
    for i, x in rows:
        if held(i):
            ts = tokens(x)
            n += len(ts)
            for a, b in zip([0] + ts[:-1], ts):
                t, k = total[a], after[a]
                score += math.log10((two[a, b] + max(k, not t) * (one[b] + 0.1) / z) / (t + max(k, not t)))
    got = queries.op5(spark, "/root/testdata/sf0.1").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert got["n"] == n and got["s"] / n > max(score / n - 0.05, -3.60, got["b"] / n + 0.6)
