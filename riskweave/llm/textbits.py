"""Byte-level text helpers shared by the operators of this subpackage.

Texts arrive in tasks as Arrow columns. Everything here works on the UTF-8
bytes of many texts at once in numpy, so no Python object is made per word.

``chunks``
    cuts a column into runs of whole texts of about ``target`` bytes, so
    memory stays bounded by the larger of ``target`` and the longest text.
``Words``
    word boundaries and 64-bit word hashes of a chunk. A word is a maximal
    run of bytes other than ``[\\x20\\x09-\\x0D]`` (all ASCII, so byte
    boundaries are character boundaries).
``range_hashes``
    64-bit hashes of arbitrary byte ranges, from one prefix sum: every byte
    value maps to a fixed random odd number, ranges are sums of these numbers
    times powers of an odd base (mod 2^64), divided by the power at the start,
    and finished with a bit mixer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


def _invert(a: int) -> int:
    return pow(a, -1, 1 << 64)


@functools.lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


@functools.lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, U64(_invert(BASE) if inverse else BASE), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    if size <= 1 << 22:
        return _powers(size, inverse)[:n]
    return np.cumprod(np.r_[U64(1), np.full(n - 1, U64(_invert(BASE) if inverse else BASE))], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2 ** 64 - 1)], dtype=np.uint64))[0])


class RangeHasher:
    """Hashes of byte ranges of one buffer; the prefix sum is made once."""

    def __init__(self, buf: np.ndarray, seed: int = 1):
        n = len(buf)
        self.acc = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(byte_values(seed)[buf] * powers(n), out=self.acc[1:])
        self.back = powers(n + 1, inverse=True)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.acc[end] - self.acc[start]) * self.back[start] + (end - start).astype(np.uint64))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of ``buf[start:end]`` for each pair; equal bytes give equal hashes."""
    return RangeHasher(buf, seed)(start, end)


def byte_grams(buf: np.ndarray, offsets: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed gram) of every window of ``width`` (at most 4) bytes inside one text."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = buf[:n].astype(np.uint32)
    for k in range(1, width):
        g |= buf[k:n + k].astype(np.uint32) << np.uint32(8 * k)
    h = ((g * np.uint32(0x9E3779B1) + np.uint32(width * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)).astype(np.int64)
    lens = np.diff(offsets)
    text = np.repeat(np.arange(len(lens)), lens)[:n]
    inside = np.ones(n, dtype=bool)
    for k in range(1, width):                       # windows that begin in a text's last width - 1 bytes
        last = offsets[1:] - k
        last = last[(last >= 0) & (last < n)]
        inside[last] = False
    return text[inside], h[inside]


def chunks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # the bytes under a null slot are undefined
        live = np.asarray(column.is_valid())
        lens = np.where(live, np.diff(offs), 0)
    else:
        live, lens = None, np.diff(offs)
    row = 0
    total = np.r_[0, np.cumsum(lens)]
    while row < n:
        stop = int(np.searchsorted(total, total[row] + target, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        if live is None or live[row:stop].all():
            buf = raw[offs[row]:offs[stop]]
        else:
            parts = [raw[offs[i]:offs[i] + lens[i]] for i in range(row, stop)]
            buf = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        yield row, buf, (total[row:stop + 1] - total[row]).astype(np.int64)
        row = stop


BATCH_BYTES = 8 << 20


def bound_batches(df):
    """Bounds the Arrow batches between Spark and the tasks' Python by bytes (rows of
    10,000 long texts or sets would not fit); returns ``df``. Results never depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def fold_latin(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte letters U+00C0..U+00DE."""
    out = LOWER[buf]
    if len(buf) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of maximal runs of ``keep`` that stay within one text."""
    n = len(keep)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[:n]
    starts = keep.copy()
    starts[1:] &= ~keep[:-1] | first[1:]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:] | first[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


class Words:
    """Words of one chunk: ``start``, ``end``, ``text`` (row in the chunk), ``hash``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, seed: int = 1):
        self.n_texts = len(offsets) - 1
        low = LOWER[buf]
        self.start, self.end, self.text = runs(~SPACE[buf], offsets)
        self.hash = range_hashes(low, self.start, self.end, seed)
        self.count = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.r_[0, np.cumsum(self.count)].astype(np.int64)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all word ``size``-shingles; a text of 1..size-1 words
    gives its whole sequence as one shingle, a text without words none."""
    h, n = words.hash, len(words.hash)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    after = words.first[words.text + 1] - at          # words from here to the text's end
    whole = words.count[words.text] < size
    take = np.where(whole, after, size)
    begin = np.flatnonzero(np.where(whole, at == words.first[words.text], after >= size))
    acc = np.zeros(len(begin), dtype=np.uint64)
    length = take[begin]
    for k in range(size):
        live = length > k
        src = np.minimum(begin + k, n - 1)
        acc = np.where(live, mix(acc * U64(0x2545F4914F6CDD1D) + h[src] + U64(k + 1)), acc)
    return words.text[begin], acc


def distinct_pairs(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, hash); ``text`` must be ascending."""
    if len(text) == 0:
        return text, h
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return t[new], v[new]


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
