"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are used; a label of 0 is
treated as unlabelled. A text is the set of hashes of its words (runs of
letters, folded to lower case) and of their first 4, 5 and 6 bytes. Features
that are several times more frequent among the confirmed examples than in the
unlabelled text, significantly so, enter a linear model. It is trained by
gradient steps (Adam) on the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss; where the second part turns negative the step goes the
other way, which keeps the model from fitting hidden positives of the
unlabelled text as negatives. The margin is then calibrated so that a score of
0.7 marks the least margin with a high precision, itself estimated from the
confirmed and the unlabelled texts and the class prior. Scores depend on which words occur, not on how
long the text is, so a toxic passage in a very long text counts in full.

The fit takes at most about ``positives`` and ``unlabelled`` whole texts by a
hash of the id, from rows whose crc32(id) mod ``folds`` is not ``held``. The
class prior is the share of toxic labels among all labels of that fold.

Defined cases: a null or empty text has no features and gets the lowest score
of a text without any toxic feature. Rows with a null id or label teach no
label. Without any confirmed example every score is 0. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import sampling
from riskweave.llm import textbits as tb

PREFIXES = (4, 5, 6)
LETTER = np.zeros(256, dtype=bool)
LETTER[[i for i in range(128) if chr(i).isalpha()] + list(range(128, 256))] = True


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit feature) of words and word beginnings; repeats included."""
    low = tb.fold_latin(buf)
    start, end, text = tb.runs(LETTER[low], offs)
    hasher = tb.RangeHasher(low, 31)
    texts, hashes = [text], [hasher(start, end)]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        texts.append(text[longer])
        hashes.append(hasher(start[longer], start[longer] + k) + np.uint64(k))
    return np.concatenate(texts), np.concatenate(hashes)


class Model:
    def __init__(self, feats: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(feats)
        self.feats, self.weights, self.bias = feats[order], weights[order], bias
        self.low = np.zeros(1 << 16, dtype=bool)             # quick no for most features
        self.low[(feats >> np.uint64(48)).astype(np.int64)] = True

    def score(self, buf, offs) -> np.ndarray:
        k = len(offs) - 1
        z = np.full(k, self.bias)
        if len(self.feats):
            text, h = features(buf, offs)
            maybe = np.flatnonzero(self.low[(h >> np.uint64(48)).astype(np.int64)])
            text, h = text[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.feats, h), len(self.feats) - 1)
            hit = self.feats[at] == h
            pairs = np.unique(text[hit] * len(self.feats) + at[hit])
            z = z + np.bincount(pairs // len(self.feats), weights=self.weights[pairs % len(self.feats)], minlength=k)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def copy_weights(texts: list[np.ndarray], tables: int = 6, depth: int = 5) -> np.ndarray:
    """A weight per text, small for one of many near copies: one over the number of
    texts that agree with it in all ``depth`` minimum hashes of one of ``tables``."""
    most = np.ones(len(texts))
    empty = np.arange(len(texts), dtype=np.uint64)
    for k in range(tables):
        key = np.zeros(len(texts), dtype=np.uint64)
        for j in range(depth):
            seed = np.uint64(0x51ED27 * (k * depth + j + 1))
            low = np.array([tb.mix(t ^ seed).min() if len(t) else e for t, e in zip(texts, empty)], dtype=np.uint64)
            key = tb.mix(key * np.uint64(3) + low)
        _, place, n = np.unique(key, return_inverse=True, return_counts=True)
        most = np.maximum(most, n[place])
    return 1.0 / most


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, keep: int = 4096, least_ratio: float = 2.5,
          least_z: float = 5.5, rounds: int = 1200, batch: int = 512) -> Model:
    weight_p, weight_u = copy_weights(pos), copy_weights(unl)
    n_p, n_u = weight_p.sum(), weight_u.sum()
    feat_p, at_p = np.unique(np.concatenate(pos), return_inverse=True)
    df_p = np.bincount(at_p, weights=np.repeat(weight_p, [len(t) for t in pos]))
    feat_u, at_u = np.unique(np.concatenate(unl), return_inverse=True)
    df_u = np.bincount(at_u, weights=np.repeat(weight_u, [len(t) for t in unl]))
    at = np.minimum(np.searchsorted(feat_u, feat_p), len(feat_u) - 1)
    in_u = np.where(feat_u[at] == feat_p, df_u[at], 0)
    rate_p, rate_u = df_p / n_p, in_u / n_u
    mean = (df_p + in_u) / (n_p + n_u)
    z = (rate_p - rate_u) / np.sqrt(np.maximum(mean * (1 - mean) * (1 / n_p + 1 / n_u), 1e-12))
    good = np.flatnonzero((rate_p >= least_ratio * rate_u) & (z >= least_z))
    good = good[np.argsort(-z[good], kind="stable")[:keep]]
    feats = np.sort(feat_p[good])
    d = len(feats)
    if not d:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -10.0)

    def matrix(texts):
        x = np.zeros((len(texts), d + 1), dtype=np.uint8)
        x[:, d] = 1
        for i, t in enumerate(texts):
            k = np.minimum(np.searchsorted(feats, t), d - 1)
            x[i, k[feats[k] == t]] = 1
        return x

    all_p, all_u = matrix(pos), matrix(unl)
    rng = np.random.default_rng(13)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        xp = all_p[rng.choice(len(pos), min(batch, len(pos)), p=weight_p / n_p)].astype(np.float32)
        xu = all_u[rng.choice(len(unl), min(batch, len(unl)), p=weight_u / n_u)].astype(np.float32)
        zp, zu = xp @ w, xu @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        toward = -prior * xp.T @ (1 - sp) / len(sp)
        away = xu.T @ su / len(su) - prior * xp.T @ sp / len(sp)
        g = toward + away if negative >= 0 else -away
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (1 - step / (rounds + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w[:d] = np.maximum(w[:d], 0.0)                    # features were chosen as signs of toxicity
    scale, shift = calibrate(all_p @ w, all_u @ w, prior)
    return Model(feats, scale * w[:d].astype(np.float64), float(scale * w[d] + shift))


def calibrate(zp: np.ndarray, zu: np.ndarray, prior: float, precision: float = 0.95, at: float = 0.7) -> tuple[float, float]:
    """(scale, shift) that move the least margin with an estimated precision of
    ``precision`` to the score ``at``. The precision above a margin is estimated
    without negatives: prior * share of the positives above / share of the
    unlabelled above."""
    cut = np.unique(zp)
    above_p = 1 - np.searchsorted(np.sort(zp), cut) / len(zp)
    above_u = np.maximum(1 - np.searchsorted(np.sort(zu), cut) / len(zu), 1 / len(zu))
    fine = np.flatnonzero(prior * above_p >= precision * above_u)
    edge = cut[fine[0]] if len(fine) else cut[-1]
    below = zu[zu < edge]
    floor = below.max() if len(below) else edge - 1.0
    line, logit = (edge + floor) / 2, float(np.log(at / (1 - at)))
    scale = max(1.0, (logit + 3.0) / max(line - min(zu.min(), floor), 1e-3))
    return scale, logit - scale * line


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int,
        positives: int = 2000, unlabelled: int = 5000) -> Model:
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                   .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (sampling.fold("id", folds) != held)))
    chosen, sizes = sampling.sample_per_class(marks, "id", "y", positives)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    prior = min(max(n1 / (n0 + n1), 0.001), 0.9)
    toxic = F.broadcast(chosen.filter("y = 1").select("id").distinct().withColumn("toxic", F.lit(1)))   # bounded by positives
    fold = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        sampling.fold("id", folds) != held).withColumn("one", F.lit(1))
    drawn, total = sampling.sample_per_class(fold.select("id", "one"), "id", "one", unlabelled)
    share = min(1.0, unlabelled / max(1, total.get(1, 0)))
    draw = F.pmod(F.xxhash64(F.lit(17), F.col("id")), F.lit(sampling.SCALE)) < F.lit(int(sampling.SCALE * share) + 1)
    rows = (fold.join(toxic, "id", "left").withColumn("drawn", draw)
                .filter(F.col("toxic").isNotNull() | F.col("drawn"))
                .select("text", F.col("toxic").isNotNull().alias("toxic"), "drawn", F.col("id").cast("string").alias("id")))

    def pack(batches):
        for b in batches:
            out = []
            for _, buf, offs in tb.chunks(b.column(0), 1 << 18):
                text, h = features(buf, offs)
                order = np.argsort(text, kind="stable")
                text, h = text[order], h[order]
                cut = np.searchsorted(text, np.arange(len(offs)))
                out += [np.unique(h[cut[i]:cut[i + 1]]).tobytes() for i in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary()), b.column(3)],
                                             names=["toxic", "drawn", "f", "id"])

    got = (tb.bound_batches(rows).mapInArrow(pack, "toxic boolean, drawn boolean, f binary, id string")
             .orderBy("id", "f").collect())
    sets = [np.frombuffer(r["f"], np.uint64) for r in got]
    pos = [s for s, r in zip(sets, got) if r["toxic"]]
    unl = [s for s, r in zip(sets, got) if r["drawn"]]
    if not pos or not unl:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    return train(pos, unl, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    names = schema.fieldNames()

    def run(batches):
        m = shared.value
        for b in batches:
            parts = [m.score(buf, offs) for _, buf, offs in tb.chunks(b.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=names)

    return tb.bound_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
