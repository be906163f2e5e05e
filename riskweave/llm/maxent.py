"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end
token per text. Every word belongs to one of 14 classes given by its last bytes;
the end token has a class of its own, and words of empty leaves (below) have together
the fixed probability of one unknown type. A token's
probability is P(class | history) * P(leaf | class, word before) * P(word | leaf).

* Class factor: log-linear over hashed features of the history: the word before, the
  word two before (skip), both together, and a constant. Its weights start from the
  whole corpus' counts of (previous-word row, class) and are trained by distributed
  gradient updates on every training text: a hash deals the texts into ``rounds``
  parts, in each round every task takes AdaGrad steps over its input split's share of
  that round's part and sends its changes in half precision; the weights become the
  tasks' token-weighted mean, so the last digits of scores depend on the splits.
* Word factor: a softmax over all leaves of the class. A class has up to 2^18 leaves, given by a
  hash of the word (four leaves a word, until that bound); a leaf's logit is the log of its smoothed
  mass, plus the weight of the hashed pair (word before, leaf) if training holds that pair.
  There is one such weight per pair, so this part of the model grows with the corpus.
  With n the pair's count, T the distinct leaves and N the tokens after this word in the class,
  m the leaf's and M the class's mass, the weight is log(1 + n*M / (T*m)), the optimum
  for the expectations (n + T*m/M) / (N + T); the normaliser is M*(1 + N/T), exactly.
* Words of one leaf split it by their smoothed counts; every leaf keeps 0.1 for a word
  that training never held. With all weights zero the model is a smoothed unigram model.

The pairs are never a broadcast: each batch of texts packs (word before, leaf) by a hash of
(word before, class) into runs of 17 bytes a distinct pair of a text, and the task that
gets a hash's runs counts the training pairs and scores all of them in one sort. A word
before that holds a third of all tokens is split over its followers' classes, a pair that
repeats in a text is one entry; ``PACK`` entries a task on average (``tasks`` tasks at least).
Its sums go back as runs too: six bytes a text (single precision) for each 4,096 neighbouring
texts, added up in double precision one run of texts at a time.

Scoring makes one pass in sparse numpy batches. Counts of the ``hot_words`` most
frequent words are broadcast (a fixed bound); the other words of a text meet
their counts in a join, so all counts are exact.

Defined cases: a null or empty text is the end token alone. Rows are scored one
by one, repeated ids and null ids included; a null id is not held out and
teaches. An empty table gives an empty result; with nothing to learn from, every token has
probability 1 (one unknown type). Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import sampling
from riskweave.llm import textbits as tb
from riskweave.session import cut_lineage, drop_scratch

U64 = np.uint64
CLASSES = 14                                     # of words; then the end token and words of empty leaves
END, UNK, ALL = CLASSES, CLASSES + 1, CLASSES + 2
BITS = 15                                        # feature rows of the class weights
LEAF_BITS = 18                                   # bits of a leaf inside its class at most: 14 MB of masses
PACK = 1 << 20                                   # packed pairs of one task, on average
SPAN = 12                                        # bits of a text's place in a run of packed sums
START = U64(0x5EED5EED5EED5EED)
FEATURES = 4                                     # word before, word two before, both, constant
SMOOTH = 0.1
STRENGTH = 5.0                                   # pseudo tokens of the class masses in the starting weights
LN10 = float(np.log(10.0))
BATCH = 1 << 14                                  # tokens of one numpy batch


class Stream:
    """Tokens of a chunk: word hash (0 for the end), class, history hashes, text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        words = tb.Words(buf, offs)
        low = tb.LOWER[buf]
        n_texts = len(offs) - 1
        tail = tb.range_hashes(low, np.maximum(words.start, words.end - 3), words.end, 51)
        total = len(words.hash) + n_texts
        last = words.first[1:] + np.arange(n_texts)          # place of each text's end token
        place = np.arange(len(words.hash)) + words.text
        self.hash = np.zeros(total, dtype=np.uint64)
        self.hash[place] = words.hash | U64(1)               # never 0
        self.cls = np.full(total, END, dtype=np.int64)
        self.cls[place] = (tail % U64(CLASSES)).astype(np.int64)
        self.text = np.zeros(total, dtype=np.int64)
        self.text[place], self.text[last] = words.text, np.arange(n_texts)
        self.n_texts = n_texts
        first = np.r_[0, last[:-1] + 1] if n_texts else np.zeros(0, np.int64)
        prev = np.r_[START, self.hash[:-1]]
        prev[first] = START
        prev2 = np.r_[START, prev[:-1]]
        prev2[first] = START
        self.prev, self.prev2 = prev, prev2


def rows_of(prev, prev2):
    """Feature rows (one array per feature) for these histories."""
    shift = U64(64 - BITS)
    return [(tb.mix(prev + U64(1)) >> shift).astype(np.int64),
            (tb.mix(prev2 * U64(5) + U64(2)) >> shift).astype(np.int64),
            (tb.mix(prev2 * U64(7) + prev * U64(3) + U64(3)) >> shift).astype(np.int64),
            np.zeros(len(prev), dtype=np.int64)]


def _softmax(logits):
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=1, keepdims=True)
    return p


def start_weights() -> np.ndarray:
    return np.zeros((FEATURES, 1 << BITS, ALL), np.float32)


class Frame:
    """What the model takes from the counts: class and leaf masses, frequent words' counts."""

    def __init__(self, n_tokens, n_types, n_ends, hot, hot_count, leaves):
        self.n_tokens, self.n_types, self.n_ends = n_tokens, n_types, n_ends
        if not len(hot):                                             # no word at all: an entry that matches none
            hot, hot_count = np.zeros(1, dtype=np.uint64), np.zeros(1)
        order = np.argsort(hot)
        self.hot, self.hot_count = hot[order], hot_count[order]
        self.top = np.searchsorted(self.hot >> U64(48), np.arange((1 << 16) + 1, dtype=np.uint64))
        self.z = n_tokens + SMOOTH * (n_types + 1)
        self._masses(leaves)

    def _masses(self, leaves):
        self.leaves = leaves                                         # (classes, leaves), each leaf with its unknown's 0.1
        self.bits = leaves.shape[1].bit_length() - 1
        mass = np.zeros(ALL)
        mass[:CLASSES] = leaves.sum(axis=1, dtype=np.float64)
        mass[END], mass[UNK] = (self.n_ends + SMOOTH if self.n_ends else 0.0), SMOOTH
        self.mass = mass
        with np.errstate(divide="ignore"):
            self.class_log = np.maximum(np.log(mass / mass.sum()), -1e30)
        self.unknown = SMOOTH / mass.sum()                           # fixed: no history makes unknown words likelier
        self.class_log[UNK] = -1e30

    def __getstate__(self):
        return self.__dict__ | {"leaves": (self.leaves.shape, zlib.compress(self.leaves.tobytes(), 1))}

    def __setstate__(self, state):
        shape, packed = state["leaves"]
        self.__dict__.update(state)
        self.leaves = np.frombuffer(zlib.decompress(packed), np.float32).reshape(shape)

    def leaf(self, cls: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf of these words, numbered through all classes."""
        return (cls << self.bits) + (tb.mix(h) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        b = (h >> U64(48)).astype(np.int64)
        lo, hi = self.top[b], self.top[b + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            at = lo[live]
            hit = self.hot[at] == h[live]
            out[live[hit]] = at[hit]
            lo[live] += 1
            live = live[~hit & (lo[live] < hi[live])]
        return out


def _logits(w: np.ndarray, frame: Frame, rows):
    logits = np.repeat(frame.class_log[None, :].astype(np.float32), len(rows[0]), axis=0)
    for f, r in enumerate(rows):
        logits += w[f][r]
    return logits


def train_chunk(w: np.ndarray, gain: np.ndarray, frame: Frame, s: Stream, rate: float):
    """AdaGrad steps of the class factor on the tokens of a chunk, one per batch."""
    for lo in range(0, len(s.hash), BATCH):
        part = slice(lo, lo + BATCH)
        cls = s.cls[part]
        rows = rows_of(s.prev[part], s.prev2[part])
        p = _softmax(_logits(w, frame, rows))
        p[np.arange(len(cls)), cls] -= 1.0
        for f, r in enumerate(rows):
            _step(w[f], gain[f], r, p, rate)


def _step(table, gain, rows, p, rate):
    if (rows == rows[0]).all():                              # the constant feature
        g = p.sum(axis=0)
        gain[rows[0]] += g * g
        table[rows[0]] -= rate * g / np.sqrt(gain[rows[0]])
        return
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    r = rows[order]
    at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    g = np.add.reduceat(p[order], at, axis=0)
    r = r[at]
    gain[r] += g * g
    table[r] -= rate * g / np.sqrt(gain[r])


def class_scores(w: np.ndarray, frame: Frame, s: Stream, cls: np.ndarray) -> np.ndarray:
    """log P(class | history) of every token."""
    out = np.zeros(len(cls))
    for lo in range(0, len(cls), BATCH):
        part = slice(lo, lo + BATCH)
        logits = _logits(w, frame, rows_of(s.prev[part], s.prev2[part]))
        top = logits.max(axis=1)
        own = logits[np.arange(len(logits)), cls[part]]
        out[part] = own - top - np.log(np.exp(logits - top[:, None]).sum(axis=1, dtype=np.float64))
    with np.errstate(divide="ignore"):
        return np.where(cls == UNK, np.log(frame.unknown), out + np.log1p(-frame.unknown))


def pack_pairs(prev, leaf, doc, held, bits: int, buckets: int):
    """(bucket, bytes) runs of the pairs of one batch; ``held`` is a flag per text."""
    hist = (tb.mix(prev) >> U64(32)).astype(np.uint32)
    cls = (leaf >> bits).astype(np.uint64)
    bucket = (tb.mix((hist.astype(np.uint64) << U64(8)) + cls) % U64(buckets)).astype(np.int64)
    pair = (hist.astype(np.uint64) << U64(32)) + leaf.astype(np.uint64)
    order = np.lexsort((pair, (bucket << 32) + doc))
    pair, doc, bucket = pair[order], doc[order], bucket[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])])
    n = np.diff(np.r_[new, len(pair)]).astype(np.uint32)
    pair, doc, bucket = pair[new], doc[new].astype(np.uint32), bucket[new]
    at = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
    sign = held[doc].astype(np.uint8)
    return [(int(bucket[a]), pair[a:b].tobytes() + doc[a:b].tobytes() + n[a:b].tobytes() + sign[a:b].tobytes())
            for a, b in zip(at[:-1], at[1:])]


def unpack_pairs(data: bytes):
    k = len(data) // 17
    return (np.frombuffer(data, np.uint64, k), np.frombuffer(data, np.uint32, k, 8 * k), np.frombuffer(data, np.uint32, k, 12 * k),
            np.frombuffer(data, np.uint8, k, 16 * k))


def pair_scores(frame: Frame, pair, n, held) -> np.ndarray:
    """log P(leaf | class, word before) of each entry; all entries of a (word before, class) must be here."""
    bits, order = frame.bits, np.argsort(pair, kind="stable")
    p = pair[order]
    seen = np.where(held[order] == 0, n[order], 0).astype(np.float64)
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    kind = p[at]
    count = np.add.reduceat(seen, at)
    group = kind >> U64(bits)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    total = np.repeat(np.add.reduceat(count, first), size)
    types = np.repeat(np.add.reduceat((count > 0).astype(np.float64), first), size)
    leaf = (kind & U64(0xFFFFFFFF)).astype(np.int64)
    mass, whole = frame.leaves.ravel()[leaf].astype(np.float64), frame.mass[leaf >> bits]
    weight = np.log1p(count * whole / (np.maximum(types, 1) * mass))
    normal = np.log(whole) + np.log1p(total / np.maximum(types, 1))
    value = np.log(mass) + weight - normal
    out = np.empty(len(p))
    out[order] = np.repeat(value, np.diff(np.r_[at, len(p)]))
    return out


def pack_sums(key, value):
    """(first key, bytes) runs of these sums by ascending distinct key."""
    head = key >> SPAN
    at = np.r_[np.flatnonzero(np.r_[True, head[1:] != head[:-1]]), len(key)]
    place, value = (key & ((1 << SPAN) - 1)).astype(np.uint16), value.astype(np.float32)
    return [(int(head[a]) << SPAN, place[a:b].tobytes() + value[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]


def add_sums(batches):
    """(key, sum) rows of packed sums that arrive ordered by their first key."""
    def rows(first, total, seen):
        k = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(first + k), pa.array(total[k])], names=["key", "s2"])

    first = None
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1)):
            if key != first:
                if first is not None:
                    yield rows(first, total, seen)
                first, total, seen = key, np.zeros(1 << SPAN), np.zeros(1 << SPAN, dtype=bool)
            raw = data.as_buffer()
            n = len(raw) // 6
            place = np.frombuffer(raw, np.uint16, n)
            total[place] += np.frombuffer(raw[2 * n:], np.float32)
            seen[place] = True
    if first is not None:
        yield rows(first, total, seen)


def _count(train: DataFrame) -> DataFrame:
    """Rows (h, cls, n) per batch, and (block, counts) of previous-word buckets by class per task."""
    def run(batches):
        near = np.zeros((1 << BITS) * ALL, dtype=np.uint32)
        for b in batches:
            got = []
            for _, buf, offs in tb.chunks(b.column(0)):
                s = Stream(buf, offs)
                key = rows_of(s.prev, s.prev2)[0] * ALL + s.cls
                k, n = np.unique(key, return_counts=True)
                near[k] += n.astype(np.uint32)
                h, at, n = np.unique(s.hash, return_index=True, return_counts=True)
                got.append((h, s.cls[at], n))
            if got:
                h, c, n = (np.concatenate(x) for x in zip(*got))
                u, at, place = np.unique(h, return_index=True, return_inverse=True)
                m = len(u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tb.as_signed(u)), pa.array(c[at].astype(np.int32)),
                     pa.array(np.bincount(place, weights=n).astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names=["h", "cls", "n", "block", "counts"])
        blocks = near.reshape(64, -1)
        used = np.flatnonzero(blocks.any(axis=1))
        m = len(used)
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(used.astype(np.int32)),
                 pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in used], pa.binary())],
                names=["h", "cls", "n", "block", "counts"])

    return train.mapInArrow(run, "h long, cls int, n long, block int, counts binary")


def _sum_blocks(rows: DataFrame, dtype) -> dict[int, np.ndarray]:
    """Sums equal-sized arrays per block as they stream by; the result has a fixed size."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(v), dtype=dtype).astype(np.float64)
                total[k] = total[k] + got if k in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                              pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "total"])
    got = rows.repartition("block").mapInArrow(run, "block int, total binary").collect()
    return {r["block"]: np.frombuffer(r["total"]) for r in got}


def _leaves(words: DataFrame, n_types: int) -> np.ndarray:
    """Smoothed mass of every leaf, with 0.1 for words that training never held; a fixed number of cells."""
    bits = next((b for b in range(1, LEAF_BITS) if CLASSES << b >= 4 * n_types), LEAF_BITS)
    out = np.zeros((CLASSES, 1 << bits), np.float32)

    def number(batches):
        for b in batches:
            h, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            leaf = (tb.mix(h.view(np.uint64)) >> U64(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(leaf), pa.array(n + SMOOTH)], names=["cls", "leaf", "mass"])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            cls, leaf, mass = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for c in np.unique(cls):
                at = cls == c
                total.setdefault(int(c), np.zeros(1 << bits, np.float32))[leaf[at]] = mass[at] + SMOOTH
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
                [zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["cls", "masses"])

    cells = words.select("h", "cls", "n").mapInArrow(number, "cls int, leaf int, mass double").groupBy("cls", "leaf").agg(F.sum("mass").alias("mass"))
    for r in cells.repartition("cls").mapInArrow(run, "cls int, masses binary").collect():
        out[r["cls"]] = np.frombuffer(zlib.decompress(r["masses"]), np.float32)
    return out


def _frame(counts: DataFrame, hot_words: int) -> Frame:
    words = counts.filter("h != 0")
    ends = counts.filter("h = 0").first()
    n_ends = int(ends["n"]) if ends else 0
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    n_words, types = int(sums["n"] or 0), int(sums["types"])
    hot = words.orderBy(F.col("n").desc(), "h").limit(hot_words).select("h", "n").toPandas()
    return Frame(n_words + n_ends, types + (n_ends > 0), n_ends, hot["h"].to_numpy(np.int64).view(np.uint64),
                 hot["n"].to_numpy(np.float64), _leaves(words, types))


def _count_weights(near: dict[int, np.ndarray], frame: Frame) -> np.ndarray:
    """The nearest-word feature starts at the smoothed log ratio of its class counts to the class masses."""
    w = start_weights()
    if near:
        size = (1 << BITS) * ALL // 64
        n = np.concatenate([near.get(k, np.zeros(size)) for k in range(64)]).reshape(1 << BITS, ALL)
        mass = np.exp(np.maximum(frame.class_log, -700))
        p = (n + STRENGTH * mass[None, :]) / (n.sum(axis=1, keepdims=True) + STRENGTH)
        w[0] = np.where(mass > 0, np.log(np.maximum(p, 1e-300)) - np.maximum(frame.class_log, -700), 0.0)
    return w


def _round(texts: DataFrame, w: np.ndarray, shared_frame, rate: float) -> np.ndarray:
    """One round of distributed updates: each task trains on its texts from the same weights;
    the new weights are the mean of theirs, weighted by tokens. Changes travel in half precision."""
    shared = texts.sparkSession.sparkContext.broadcast(w)
    blocks = 16

    def run(batches):
        start, fr = shared.value, shared_frame.value
        mine, gain, tokens = start.copy(), np.full_like(start, 0.5), 0
        for b in batches:
            for _, buf, offs in tb.chunks(b.column(0), 1 << 19):
                s = Stream(buf, offs)
                train_chunk(mine, gain, fr, s, rate)
                tokens += len(s.hash)
        if not tokens:
            return
        parts = np.array_split((mine - start).ravel().astype(np.float16), blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(blocks), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
             pa.array([tokens] * blocks, pa.int64())], names=["block", "part", "tokens"])

    def total(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for k, v, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                d = np.frombuffer(zlib.decompress(v), np.float16).astype(np.float64) * t
                old = sums.get(k, [0.0, 0])
                sums[k] = [old[0] + d, old[1] + t]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
                [(d / t).astype(np.float32).tobytes() for d, t in sums.values()], pa.binary())], names=["block", "step"])

    got = texts.mapInArrow(run, "block int, part binary, tokens long").repartition("block").mapInArrow(total, "block int, step binary").collect()
    shared.destroy()
    if not got:
        return w
    step = np.concatenate([np.frombuffer(r["step"], np.float32) for r in sorted(got, key=lambda r: r["block"])])
    return w + step.reshape(w.shape)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0,
                rounds: int = 2, tasks: int = 12, hot_words: int = 200_000, rate: float = 0.15) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``."""
    spark = docs.sparkSession
    src = tb.bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(sampling.fold("id", folds) == held, F.lit(False))
    train = src.filter(~held_out)
    raw = cut_lineage(_count(train.select("text")))
    counts = cut_lineage(raw.filter("h is not null").groupBy("h", "cls").agg(F.sum("n").alias("n")))
    frame = _frame(counts, hot_words)
    w = _count_weights(_sum_blocks(raw.filter("block is not null").select("block", "counts"), np.uint32), frame)
    drop_scratch(raw)

    # every training text is in one round, read where it lies; texts of null ids are dealt by their bytes
    shared_frame = spark.sparkContext.broadcast(frame)
    dealt = train.select("text", F.pmod(F.xxhash64(F.lit(17), "id", "text"), F.lit(rounds)).alias("draw"))
    for r in range(rounds):
        w = _round(dealt.filter(F.col("draw") == r).select("text"), w, shared_frame, rate / (1 + r))

    shared = spark.sparkContext.broadcast(w)
    parts = max(tasks, -(-frame.n_tokens // PACK))
    buckets = parts * 8
    fields = ["bucket", "key", "id", "held_out", "n_tokens", "n_known", "base", "score", "h", "n", "pairs"]

    def run(batches):
        weights, fr = shared.value, shared_frame.value
        place0, row = TaskContext.get().partitionId() << 40, 0
        end_known = fr.n_ends > 0
        end_base = np.log(fr.n_ends + SMOOTH) if end_known else np.log(SMOOTH)
        log_count, masses = np.log(fr.hot_count + SMOOTH), fr.leaves.ravel()
        for b in batches:
            base_row, packs = row, []
            out_held = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for first, buf, offs in tb.chunks(b.column(2), 1 << 20):
                s = Stream(buf, offs)
                k = s.n_texts
                word = np.flatnonzero(s.cls < CLASSES)
                leaf = fr.leaf(s.cls[word], s.hash[word])
                mass = masses[leaf].astype(np.float64)
                live = mass > 0
                cls = s.cls.copy()
                cls[word[~live]] = UNK
                if not end_known:
                    cls[cls == END] = UNK
                place = np.full(len(cls), -1, dtype=np.int64)
                place[word] = fr.find(s.hash[word])
                hot, end = place >= 0, s.cls == END
                own = np.where(hot, log_count[np.maximum(place, 0)], 0.0)
                empty = np.zeros(len(cls), dtype=bool)         # words of an empty leaf are certainly unknown
                empty[word[~live]] = True
                base = own + np.where(end, end_base, 0.0) + np.where(empty, np.log(SMOOTH), 0.0)
                value = class_scores(weights, fr, s, cls) + own
                value[word[live]] -= np.log(mass[live])
                in_leaf = word[live]
                packs.append((s.prev[in_leaf], leaf[live], s.text[in_leaf] + first))
                cold = np.flatnonzero(~end & ~hot & ~empty)
                keys = place0 + row + np.arange(k)
                sums = lambda x: np.bincount(s.text, weights=x, minlength=k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys % buckets).astype(np.int32)), pa.array(keys), b.column(0).slice(first, k), b.column(1).slice(first, k),
                     pa.array(np.bincount(s.text, minlength=k).astype(np.int64)), pa.array(sums(hot | (end & end_known)).astype(np.int64)),
                     pa.array(sums(base) / LN10), pa.array(sums(value) / LN10),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=fields)
                if len(cold):
                    order = cold[np.lexsort((s.hash[cold], s.text[cold]))]
                    t, h = s.text[order], s.hash[order]
                    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])])
                    m = len(new)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((keys[t[new]] % buckets).astype(np.int32)), pa.array(keys[t[new]]), pa.nulls(m, b.column(0).type),
                         pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
                         pa.array(tb.as_signed(h[new])), pa.array(np.diff(np.r_[new, len(order)])), pa.nulls(m, pa.binary())], names=fields)
                row += k
            prev, leaf, doc = (np.concatenate(x) for x in zip(*packs)) if packs else (np.zeros(0, U64),) * 3
            if len(prev):
                got = pack_pairs(prev, leaf, doc, out_held, fr.bits, buckets)
                m = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in got], pa.int32()), pa.array([place0 + base_row] * m, pa.int64()), pa.nulls(m, b.column(0).type),
                     pa.nulls(m, pa.bool_()), *(pa.nulls(m, pa.int64()),) * 2, *(pa.nulls(m, pa.float64()),) * 2, *(pa.nulls(m, pa.int64()),) * 2,
                     pa.array([x for _, x in got], pa.binary())], names=fields)

    kinds = [T.IntegerType(), T.LongType(), docs.schema[id_col].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.DoubleType(),
             T.DoubleType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(f, k) for f, k in zip(fields, kinds)])

    def solve(batches):
        """Texts and their rare words pass; pairs become packed sums a text."""
        fr, pairs, keys, ns, flags = shared_frame.value, [], [], [], []
        for b in batches:
            data = b.column(10)
            plain = b.filter(data.is_null()).select(fields[1:])
            if plain.num_rows:
                yield plain
            live = b.filter(data.is_valid())
            for key0, d in zip(live.column(1).to_pylist(), live.column(10)):
                p, doc, n, flag = unpack_pairs(d.as_buffer())
                pairs.append(p.copy()), keys.append(doc.astype(np.int64) + key0), ns.append(n.copy()), flags.append(flag.copy())
        if pairs:
            n = np.concatenate(ns)
            value = pair_scores(fr, np.concatenate(pairs), n, np.concatenate(flags)) * n / LN10
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            got = pack_sums(key, np.bincount(at, weights=value, minlength=len(key)))
            m = len(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in got], pa.int64()), pa.nulls(m, live.column(2).type), pa.nulls(m, pa.bool_()),
                 *(pa.nulls(m, pa.int64()),) * 2, *(pa.nulls(m, pa.float64()),) * 2, *(pa.nulls(m, pa.int64()),) * 2,
                 pa.array([x for _, x in got], pa.binary())], names=fields[1:])

    dealt = src.select("id", held_out.alias("held_out"), "text").mapInArrow(run, schema).repartition(parts, "bucket")
    passed = cut_lineage(dealt.mapInArrow(solve, T.StructType(schema.fields[1:])))
    cold = passed.filter("h is not null").select("key", "h", "n")
    seen = counts.select("h", F.col("n").alias("c"))
    log_c = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    late = cold.join(seen, "h", "left").select("key", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("k2"), log_c.alias("b2"))
    packed = passed.filter("pairs is not null").select("key", "pairs").repartition("key").sortWithinPartitions("key")
    sums = packed.mapInArrow(add_sums, "key long, s2 double").select("key", F.lit(0).cast("long").alias("k2"), F.lit(0.0).alias("b2"), "s2")
    late = late.withColumn("s2", F.col("b2")).unionByName(sums)
    late = late.groupBy("key").agg(F.sum("k2").alias("k2"), F.sum("b2").alias("b2"), F.sum("s2").alias("s2"))
    texts = passed.filter("n_tokens is not null").drop("h", "n", "pairs")
    z = float(np.log10(frame.z)) if frame.z > 0 else 0.0
    return texts.join(late, "key", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
        F.lit(int(frame.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0)) - F.col("n_tokens") * F.lit(z)).alias("base_score"),
        (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))
