"""Quality classifier with supervised subword embeddings.

A document is a bag of hashed features: its words, its word pairs and its byte
n-grams. Each feature has a learned vector; the document vector is the mean over the occurrences of each
kind of feature, averaged over the kinds, and a softmax layer over it gives the
class. Vectors and output weights are
trained together by numpy stochastic gradient descent (AdaGrad steps, one
document at a time). Since the output is linear in the mean, scoring folds the
output layer into one number per feature and averages these numbers.

The fit takes at most about ``per_class`` labelled documents of each class
(whole texts), by a hash of the id among the rows whose crc32(id) mod ``folds``
is not ``held``. Class sizes in the learning fold set the prior.

Defined cases: a null or empty text has no features and gets the prior. An id
with several labels teaches each of them; rows with a null label or id teach
nothing. If one class is missing every text gets the share of class 1 (1.0 with
no labels at all). Other columns pass through ``keep_good`` untouched; in ``score``
the new columns take the place of columns named ``score`` or ``predicted``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import sampling
from riskweave.llm import textbits as tb

BITS = 16
DIM = 1 << BITS
GRAMS = (2, 3, 4)
KINDS = 2 + len(GRAMS)


def features(buf: np.ndarray, offs: np.ndarray):
    """(text, feature) streams of a chunk."""
    start, end, text = tb.runs(~tb.SPACE[buf], offs)
    word = tb.range_hashes(buf, start, end, 21)
    yield text, (word >> np.uint64(64 - BITS)).astype(np.int64)
    pair = tb.mix(word[:-1] * np.uint64(3) + word[1:])
    inside = text[:-1] == text[1:]
    yield text[1:][inside], (pair >> np.uint64(64 - BITS)).astype(np.int64)[inside]
    for width in GRAMS:
        yield tb.byte_grams(buf, offs, width, BITS)


class Model:
    """``value``: what each feature occurrence adds to the mean log-odds of class 1."""

    def __init__(self, value: np.ndarray, shift: float):
        self.value, self.shift = value.astype(np.float32), shift

    def score(self, buf, offs) -> np.ndarray:
        k = len(offs) - 1
        z = np.full(k, self.shift)
        for text, feat in features(buf, offs):
            total = np.bincount(text, weights=self.value[feat], minlength=k)
            z += total / np.maximum(np.bincount(text, minlength=k), 1) / KINDS
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(feats: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, prior: float,
          dim: int = 8, epochs: int = 6, rate: float = 0.2) -> Model:
    rng = np.random.default_rng(3)
    table = rng.uniform(-0.5, 0.5, (DIM, dim)).astype(np.float32) / dim
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    g_table, g_out = np.full(DIM, 1e-10, dtype=np.float32), np.full((dim, 2), 1e-3, dtype=np.float32)
    share = np.bincount(labels, minlength=2) / len(labels)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(labels)):
            f, w = feats[i], counts[i]
            if not len(f):
                continue
            hidden = w @ table[f]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            d = p.copy()
            d[labels[i]] -= 1
            d *= 0.5 / max(share[labels[i]], 1e-6)            # both classes weigh alike in training
            g_hidden = out @ d
            g_o = np.outer(hidden, d)
            g_out += g_o * g_o
            out -= step * g_o / np.sqrt(g_out)
            bias -= 0.05 * step * d
            norm = float(g_hidden @ g_hidden)
            if norm > 0:
                g_table[f] += w * w * norm
                table[f] -= (step * w / np.sqrt(g_table[f]))[:, None] * g_hidden[None, :]
    value = table @ (out[:, 1] - out[:, 0])
    return Model(value, float(bias[1] - bias[0]) + float(np.log(prior / (1 - prior))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int,
        per_class: int = 1500) -> Model:
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                   .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (sampling.fold("id", folds) != held)))
    chosen, sizes = sampling.sample_per_class(known, "id", "y", per_class)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 1.0
        return Model(np.zeros(DIM), 60.0 if share >= 1 else -60.0)
    # the chosen labels are bounded by per_class per class, so they are broadcast
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .join(F.broadcast(chosen), "id").select("text", "y", F.col("id").cast("string").alias("id")))

    def pack(batches):
        for b in batches:
            fs, cs = [], []
            for _, buf, offs in tb.chunks(b.column(0), 1 << 18):
                k = len(offs) - 1
                streams = list(features(buf, offs))
                share = [1.0 / KINDS / np.maximum(np.bincount(t, minlength=k), 1)[t] for t, _ in streams]
                key, place = np.unique(np.concatenate([t * DIM + f for t, f in streams]), return_inverse=True)
                weight = np.bincount(place, weights=np.concatenate(share), minlength=len(key))
                for i in range(k):
                    lo, hi = np.searchsorted(key, [i * DIM, (i + 1) * DIM])
                    fs.append((key[lo:hi] - i * DIM).astype(np.uint16).tobytes())
                    cs.append(weight[lo:hi].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(fs, pa.binary()), pa.array(cs, pa.binary()), b.column(2)],
                                             names=["y", "f", "c", "id"])

    got = tb.bound_batches(texts).mapInArrow(pack, "y int, f binary, c binary, id string").orderBy("y", "id").collect()
    if len({r["y"] for r in got}) < 2:
        return Model(np.zeros(DIM), float(np.log(n1 / n0)))
    return train([np.frombuffer(r["f"], np.uint16).astype(np.int64) for r in got],
                 [np.frombuffer(r["c"], np.float16).astype(np.float32) for r in got],
                 np.array([r["y"] for r in got]), n1 / (n0 + n1))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3,
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``score`` and ``predicted``, which take the
    place of columns of these names. One row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in ("score", "predicted")]
    schema = T.StructType(kept + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = schema.fieldNames()
    cols = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)]

    def run(batches):
        m = shared.value
        for b in batches:
            parts = [m.score(buf, offs) for _, buf, offs in tb.chunks(b.column(len(kept)))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))]
                                             + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return tb.bound_batches(docs).select(*cols, F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts; columns as they were."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = score(plain, model, f"c{docs.columns.index(text_col)}", threshold).filter("predicted = 1")
    return scored.drop("score", "predicted").toDF(*docs.columns)
