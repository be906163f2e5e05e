"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are folded to lower case, everything but letters and
digits becomes a space, and runs of spaces become one. An item of ``m`` bytes
may occur with up to ``k = floor(rate * m)`` edits. An occurrence with at most
``k`` edits keeps at least ``m + 1 - q (k + 1)`` of the item's q-grams, and the
diagonals (text position minus item position) of these lie within ``k + 1``
neighbours. So q-gram hits are counted in bands of ``2 (k + 1)`` diagonals that
overlap by half: some band holds all of them. Bands with enough distinct
q-grams are aligned with the whole item inside the band (edit distance, free
ends in the text); the item is found if it takes at most ``k`` edits. ``k`` is
lowered for short items until the bound is at least one, so no occurrence
within the budget is missed. Items shorter than ``q`` must occur verbatim.

The benchmark is a stated query set: it is taken in blocks of bounded size, and
each block (broadcast) is run against all rows of all texts. Nothing is
shuffled.

Defined cases: a null or empty text matches nothing; an item without letters or
digits is ignored; repeated items and rows are all reported. ``start`` and
``end`` are code points of the original text. ``drop_contaminated`` keeps all
columns and rows but the contaminated ones, whatever the columns are called.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbits as tb

Q = 8
BLOOM_BITS = 22
BLOCK_BYTES = 4 << 20
PLAIN = np.arange(256, dtype=np.uint8)                 # letters and digits stay, other ASCII becomes a space
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


def normalise(buf: np.ndarray, offs: np.ndarray):
    """(bytes, offsets, source position of each byte) with runs of spaces made one."""
    low = PLAIN[tb.fold_latin(buf)]
    space = low == 0x20
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begin = offs[:-1][np.diff(offs) > 0]
    keep[begin] = True                                  # the first byte of a text is compared with nothing
    place = np.flatnonzero(keep)
    return low[place], np.searchsorted(place, offs), place


def grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    n = len(buf) - Q + 1
    return np.ndarray((n,), dtype="<u8", buffer=buf.tobytes(), strides=(1,)) if n > 0 else np.zeros(0, dtype="<u8")


def edits_in_band(item: np.ndarray, text: np.ndarray, lo: int, width: int, anchored: bool = False) -> tuple[int, int]:
    """(least edits, end in ``text``) of the whole item against a substring of ``text``,
    over the diagonals lo .. lo + width - 1. ``anchored``: the substring begins at 0."""
    inf = 1 << 20
    n, steps = len(text), np.arange(width)
    d = lo + steps
    row = np.where(d >= 0, d, inf) if anchored else np.where((d >= 0) & (d <= n), 0, inf)
    if not anchored and lo < 0:                        # text begins inside the item: leading item bytes are deleted
        row = np.where(d < 0, inf, row)
    for i in range(len(item)):
        at = d + i                                     # text position compared with item[i] on each diagonal
        inside = (at >= 0) & (at < n)
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside]] == item[i]
        best = np.where(inside, row + ~same, inf)
        gone = np.append(row[1:], inf) + 1             # item byte missing in the text
        gone[(at + 1 < 0) | (at + 1 > n)] = inf
        if i + 1 + lo < 0 or (d + i + 1 == 0).any():   # column before the text: only deletions
            gone = np.where(d + i + 1 == 0, np.minimum(gone, i + 1), gone)
        best = np.minimum(best, gone)
        row = np.minimum(np.minimum.accumulate(best - steps) + steps, inf)   # text bytes that the item lacks
    at = d + len(item)
    row = np.where((at >= 0) & (at <= n), row, inf)
    j = int(np.argmin(row))
    return int(row[j]), int(at[j])


def disjoint(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, end) regions of one item that do not overlap, best first, returned in text order."""
    kept: list[tuple[int, int, int]] = []                  # by start
    for e, s, t in sorted(found):
        at = bisect.bisect_left(kept, s, key=lambda r: r[1])
        if (at == 0 or kept[at - 1][2] <= s) and (at == len(kept) or t <= kept[at][1]):
            kept.insert(at, (e, s, t))
    return kept


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple], rate: float):
        self.ids, self.texts, self.k, self.need = [], [], [], []
        self.short: list[tuple] = []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            buf = normalise(raw, np.array([0, len(raw)]))[0]
            buf = np.frombuffer(buf.tobytes().strip(), dtype=np.uint8)
            m = len(buf)
            if not m:
                continue
            if m < Q:
                self.short.append((item_id, buf.tobytes()))
                continue
            k = max(0, min(int(rate * m), m // Q - 1))
            while k and m + 1 - Q * (k + 1) < 1:
                k -= 1
            self.ids.append(item_id)
            self.texts.append(buf)
            self.k.append(k)
            self.need.append(max(1, m + 1 - Q * (k + 1)))
        parts = [grams(t) for t in self.texts]
        g = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pos = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.r_[first, len(g)].astype(np.int64)
        self.item, self.pos = item[order], pos[order]
        self.bloom = np.zeros(1 << BLOOM_BITS, dtype=bool)
        self.bloom[self.slot(self.grams)] = True
        self.k, self.need = np.array(self.k, dtype=np.int64), np.array(self.need, dtype=np.int64)

    @staticmethod
    def slot(g):
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)

    def candidates(self, buf: np.ndarray, offs: np.ndarray):
        """(text, item, band) with enough distinct q-grams."""
        none = np.zeros((0, 3), dtype=np.int64)
        if not len(self.grams):
            return none
        g = grams(buf)
        at = np.flatnonzero(self.bloom[self.slot(g)])
        j = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[j] == g[at]
        at, j = at[hit], j[hit]
        text = np.searchsorted(offs, at, side="right") - 1
        whole = at + Q <= offs[text + 1]
        at, j, text = at[whole], j[whole], text[whole]
        if not len(at):
            return none
        n_post = self.first[j + 1] - self.first[j]
        rep = np.repeat(np.arange(len(at)), n_post)
        post = np.arange(len(rep)) - np.repeat(np.r_[0, np.cumsum(n_post)[:-1]], n_post) + self.first[j][rep]
        item, ipos = self.item[post], self.pos[post]
        text = text[rep]
        tpos = at[rep] - offs[text]
        n_items = len(self.ids)
        pair = text * n_items + item                       # cheap first: all diagonals together
        if n_items * (len(offs) - 1) <= 1 << 23:
            n = np.bincount(pair)[pair]
        else:
            _, place, n = np.unique(pair, return_inverse=True, return_counts=True)
            n = n[place]
        live = np.flatnonzero(n >= self.need[item])
        text, item, tpos, ipos = text[live], item[live], tpos[live], ipos[live]
        if not len(text):
            return none
        # hits per strip of k + 1 diagonals; band v is the strips v and v + 1
        strip = (tpos - ipos) // (self.k[item] + 1)
        low, wide = int(strip.min()) - 1, int(strip.max()) - int(strip.min()) + 3
        key = (text * n_items + item) * wide + (strip - low)
        strips, n = np.unique(key, return_counts=True)
        after = np.zeros(len(n), dtype=np.int64)
        after[:-1] = np.where(strips[1:] == strips[:-1] + 1, n[1:], 0)
        need = self.need[(strips // wide) % n_items]
        lone = np.ones(len(n), dtype=bool)                 # bands whose first strip has no hit
        lone[1:] = strips[1:] != strips[:-1] + 1
        bands = np.sort(np.r_[strips[n + after >= need], strips[lone & (n >= need)] - 1])
        if not len(bands):
            return none
        # distinct q-grams of the few bands left
        held = np.flatnonzero(np.isin(key, np.r_[bands, bands + 1]))
        some = np.unique(np.stack([key[held], ipos[held]], 1), axis=0)
        out = []
        for v in bands.tolist():
            lo, hi = np.searchsorted(some[:, 0], [v, v + 2])
            i = (v // wide) % n_items
            if len(np.unique(some[lo:hi, 1])) >= self.need[i]:
                out.append((v // wide // n_items, i, v % wide + low))
        return np.array(out, dtype=np.int64).reshape(-1, 3)

    def matches(self, buf: np.ndarray, offs: np.ndarray, once: bool = False):
        """(text, item id, edits, start, end) in source bytes: every disjoint occurrence per text and item.
        Of regions that overlap, the one of fewest edits stays (the first on ties). ``once``: a text
        that is known to hold an item is looked at no further."""
        norm, cuts, place = normalise(buf, offs)
        regions: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        exact: dict[tuple[int, int], int] = {}             # begin of the last exact occurrence
        hit = set()
        for text, item, band in self.candidates(norm, cuts).tolist():
            if once and text in hit:
                continue
            body, k = self.texts[item], int(self.k[item])
            begin, stop = int(cuts[text]), int(cuts[text + 1])
            lo = band * (k + 1)
            if lo <= exact.get((text, item), lo - 1) < lo + 2 * (k + 1):
                continue                                   # the overlapping band found this place without an edit
            left = max(0, lo)
            part = norm[begin + left:min(stop, begin + lo + 2 * (k + 1) + len(body))]
            edits, end = edits_in_band(body, part, lo - left, 2 * (k + 1))
            if edits > k:
                continue
            size = len(body)
            hit.add(text)
            if edits:                                      # where it begins: the same alignment read backwards
                back, size = edits_in_band(body[::-1], part[:end][::-1], -(k + 1), 2 * (k + 1) + 1, anchored=True)
                size = size if back <= edits else min(end, len(body))
            regions.setdefault((text, item), []).append((edits, left + end - size, left + end))
            if not edits:
                exact[text, item] = left + end - size
        out = [(text, self.ids[item], e, cuts[text] + s, cuts[text] + t)
               for (text, item), found in sorted(regions.items()) for e, s, t in disjoint(found)]
        for item_id, body in self.short:
            for text in range(len(cuts) - 1):
                padded, word = b" " + norm[cuts[text]:cuts[text + 1]].tobytes() + b" ", b" " + body + b" "
                s = padded.find(word)
                while s >= 0:
                    out.append((text, item_id, 0, cuts[text] + s, cuts[text] + s + len(body)))
                    s = padded.find(word, s + len(body) + 1)
        return [(t, i, e, int(place[s]) if s < len(place) else len(buf), int(place[x - 1]) + 1) for t, i, e, s, x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float):
    """The benchmark as broadcast blocks of about BLOCK_BYTES each."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    size = items.select(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        yield items.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows], rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", rate: float = 0.1) -> DataFrame:
    """(id, item, edits, start, end): every disjoint region of a text that holds a benchmark item.
    A column whose name an earlier one has is called ``benchmark_`` and that name."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("item", benchmark.schema[item_col].dataType),
                           T.StructField("edits", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType())])
    names, final = schema.fieldNames(), []
    for name in (id_col, item_col, "edits", "start", "end"):
        while name.lower() in (x.lower() for x in final):
            name = f"benchmark_{name}"
        final.append(name)
    src = tb.bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for shared in _blocks(benchmark, item_col, item_text, rate):
        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                for row, buf, offs in tb.chunks(b.column(1), 1 << 19):
                    found = index.matches(buf, offs)
                    if not found:
                        continue
                    chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
                    text = np.array([f[0] for f in found])
                    base = chars[offs[text]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(text + row)), pa.array([f[1] for f in found]).cast(item_type),
                         pa.array([f[2] for f in found], pa.int32()),
                         pa.array(chars[[f[3] for f in found]] - base, pa.int64()),
                         pa.array(chars[[f[4] for f in found]] - base, pa.int64())], names=names)

        from pyspark.sql.pandas.types import to_arrow_type
        item_type = to_arrow_type(benchmark.schema[item_col].dataType)
        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.toDF(*final)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", rate: float = 0.1) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; decided in the scan itself."""
    names, at = docs.columns, docs.columns.index(text_col)
    out = tb.bound_batches(docs).toDF(*[f"c{i}" for i in range(len(names))])
    for shared in _blocks(benchmark, item_col, item_text, rate):
        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                for row, buf, offs in tb.chunks(b.column(at), 1 << 19):
                    for f in index.matches(buf, offs, once=True):
                        clean[row + f[0]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*names)
