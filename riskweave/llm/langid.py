"""Language identification by error-correcting output codes.

Each learned language gets a codeword of bits. One binary classifier per bit
(logistic regression over hashed byte n-grams of the folded text) predicts
whether the text's language has that bit set. Decoding sums, for every
language, the logistic loss of the predicted margins against its codeword,
weighted per bit by how reliable the bit was in training; the least loss wins.
``score`` is the softmax of the negative losses, and ``ambiguous`` marks texts
whose two nearest codewords are almost equally near.

Up to five languages use the exhaustive code (every split of the languages is
a bit); more use random balanced splits, the best of several draws by least
distance between codewords.

The fit uses at most about ``per_lang`` texts per language, whole texts, taken
by a hash of the id among the rows whose crc32(id) mod ``folds`` is not
``held``; this bounds what reaches the driver. Every text is then scored.

Defined cases: a text that is null or has no letter is ``und`` with score 0.
Rows with a null language teach nothing. If no language can be learned every
text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import sampling
from riskweave.llm import textbits as tb

WIDTHS = ((2, 11), (3, 14))                      # gram width in bytes, hash bits
DIM = sum(1 << b for _, b in WIDTHS)
TO_SPACE = np.arange(256, dtype=np.uint8)        # ASCII other than letters becomes a space
TO_SPACE[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def _grams(buf: np.ndarray, offs: np.ndarray):
    """(text, feature) streams, one per gram width, over folded letters."""
    low = TO_SPACE[tb.fold_latin(buf)]
    base = 0
    for width, bits in WIDTHS:
        text, h = tb.byte_grams(low, offs, width, bits)
        # grams of spaces only say nothing
        yield text, h + base
        base += 1 << bits


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """(languages, bits) matrix of -1 and 1."""
    if n <= 5:
        rows = [[1] + list(rest) for rest in itertools.product([1, -1], repeat=n - 1)]
        return np.array([r for r in rows if -1 in r] or [[1] * n], dtype=np.int8).T
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, best_gap = np.random.default_rng(seed), None, -1
    for _ in range(200):
        half = np.r_[np.ones((n + 1) // 2), -np.ones(n // 2)].astype(np.int8)
        m = np.stack([rng.permutation(half) for _ in range(bits)], axis=1)
        dist = (bits - m.astype(int) @ m.T.astype(int)) // 2
        gap = int(dist[~np.eye(n, dtype=bool)].min())
        if gap > best_gap:
            best, best_gap = m, gap
    return best


class Model:
    def __init__(self, langs, code, weights, bias, bit_weight, margin):
        self.langs, self.code, self.margin = langs, code, margin
        self.weights, self.bias, self.bit_weight = weights.astype(np.float32), bias, bit_weight

    def margins(self, buf, offs):
        k = len(offs) - 1
        total = np.zeros((k, self.weights.shape[1]))
        count = np.zeros(k)
        for text, feat in _grams(buf, offs):
            for lo in range(0, len(feat), 1 << 16):         # bounded gather
                t, f = text[lo:lo + (1 << 16)], feat[lo:lo + (1 << 16)]
                at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                total[t[at]] += np.add.reduceat(self.weights[f], at, axis=0)
            count += np.bincount(text, minlength=k)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins):
        """(best language index, score, ambiguous) per text."""
        loss = np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :]) @ self.bit_weight
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        best = order[:, 0]
        p = np.exp(loss[rows, best][:, None] - loss)
        score = 1.0 / p.sum(axis=1)
        if loss.shape[1] == 1:
            return best, score, np.zeros(len(loss), dtype=bool)
        gap = loss[rows, order[:, 1]] - loss[rows, best]
        return best, score, gap < self.margin


def train(counts: list[np.ndarray], feats: list[np.ndarray], labels: np.ndarray, langs: list, margin: float,
          epochs: int = 30, batch: int = 64) -> Model:
    """Logistic regressions for all bits at once by AdaGrad on mean gram counts."""
    code = codebook(len(langs))
    n, bits = len(labels), code.shape[1]
    w, b = np.zeros((DIM, bits), dtype=np.float32), np.zeros(bits)
    gw, gb = np.full((DIM, 1), 1e-8, dtype=np.float32), np.full(bits, 1e-8)
    share = np.bincount(labels, minlength=len(langs))
    weight = (n / (len(langs) * np.maximum(share, 1)))[labels]            # languages count alike
    target = code[labels].astype(np.float64)
    rng = np.random.default_rng(5)
    margins = np.zeros((n, bits))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            x = np.zeros((len(rows), DIM), dtype=np.float32)
            for i, r in enumerate(rows):
                x[i, feats[r]] = counts[r] / max(counts[r].sum(), 1)
            m = x @ w + b
            margins[rows] = m
            g = (-target[rows] / (1 + np.exp(np.clip(target[rows] * m, -30, 30)))) * weight[rows][:, None] / len(rows)
            dw = x.T @ g.astype(np.float32)
            gw += (dw * dw).mean(axis=1, keepdims=True)
            gb += g.sum(axis=0) ** 2
            w -= 1.0 * dw / np.sqrt(gw)
            b -= 0.05 * g.sum(axis=0) / np.sqrt(gb)
    right = (margins * target > 0).mean(axis=0)
    bit_weight = np.maximum(right - 0.5, 0.01)
    return Model(langs, code.astype(np.float64), w, b, bit_weight * bits / bit_weight.sum(), margin)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int,
        per_lang: int = 600, margin: float = 1.0) -> Model | None:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter((sampling.fold("id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample, sizes = sampling.sample_per_class(rows, "id", "lang", per_lang)
    if not sizes:
        return None

    def pack(batches):
        for b in batches:
            feats, counts = [], []
            for _, buf, offs in tb.chunks(b.column(0), 1 << 18):
                streams = list(_grams(buf, offs))
                text = np.concatenate([t for t, _ in streams])
                feat = np.concatenate([f for _, f in streams])
                key, n = np.unique(text * DIM + feat, return_counts=True)
                for i in range(len(offs) - 1):
                    lo, hi = np.searchsorted(key, [i * DIM, (i + 1) * DIM])
                    feats.append((key[lo:hi] - i * DIM).astype(np.uint16).tobytes())
                    counts.append(np.minimum(n[lo:hi], 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(feats, pa.binary()), pa.array(counts, pa.binary()),
                                              b.column(2)], names=["lang", "feats", "counts", "id"])

    got = (sample.select("text", "lang", F.col("id").cast("string").alias("id"))
                 .mapInArrow(pack, "lang string, feats binary, counts binary, id string")
                 .orderBy("lang", "id").collect())
    langs = sorted({r["lang"] for r in got})
    where = {v: i for i, v in enumerate(langs)}
    return train([np.frombuffer(r["counts"], np.uint16).astype(np.float32) for r in got],
                 [np.frombuffer(r["feats"], np.uint16).astype(np.int64) for r in got],
                 np.array([where[r["lang"]] for r in got]), langs, margin)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 0x20) >= 97) & ((buf | 0x20) <= 122)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out = np.bincount(text[ascii_letter], minlength=len(offs) - 1) > 0
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(c.isalpha() for c in buf[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            lang, score, unsure = [], [], []
            for _, buf, offs in tb.chunks(b.column(1), 1 << 20):
                k = len(offs) - 1
                letters = has_letter(buf, offs)
                if m is None or not letters.any():
                    lang += ["und"] * k
                    score += [0.0] * k
                    unsure += [True] * k
                    continue
                best, p, amb = m.decode(m.margins(buf, offs))
                lang += [m.langs[i] if ok else "und" for i, ok in zip(best, letters)]
                score += np.where(letters, p, 0.0).tolist()
                unsure += np.where(letters, amb, True).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(unsure, pa.bool_())], names=names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    names = schema.fieldNames()
    return tb.bound_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
