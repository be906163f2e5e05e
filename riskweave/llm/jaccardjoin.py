"""Similarity self-join of documents on word shingles (Jaccard), with components.

A document's set holds its distinct ``size``-word shingles (A-Z lower-cased,
words split at ``[\\x20\\x09-\\x0D]``; a text with fewer words gives its whole
sequence as one shingle). Two documents link when
``den * |intersection| >= num * |union|`` (default 75 of 100).

Method (rare-first prefix filtering):

1. One pass gives each text its set size and a 128-bit set signature, and adds
   all shingles to a count sketch of fixed size (``2**sketch_bits`` counters).
   Equal sets form one class; its smallest id represents it from here on.
2. Shingles are ordered by sketched frequency, rarest first (ties by hash), the
   same total order everywhere. Two similar sets must share a shingle among
   their first ``n - ceil(t n) + 1``; only these are emitted. Any total order
   gives exact results; the sketch only makes the lists short.
3. The prefix rows are partitioned by shingle (frequent shingles over several
   blocks) and sorted; streaming them drops shingles of a single class.
4. First round: per shingle and size band, every class is compared only with the
   class that shares most shingles with others, so a large group of near copies
   costs a star around its least changed text and not all pairs. Pairs pass the
   length and positional filters, are made distinct, and are verified once, on
   whole sets, after a suffix filter (lower bound of the Hamming distance from
   the counts in fixed hash ranges).
5. Second round: shingles whose classes are still in different components are
   joined with themselves, and every pair of classes in different components
   that passes the filters and was not verified before is verified. What stays
   unverified lies within one component, so no component is missed.

Defined cases: a text that is null, empty or without words has an empty set and
links with nothing. Rows with one id are one document, with the links of all
its rows. A row with a null id links with nothing and has a null component. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbits as tb
from riskweave.operators.neighbors import connected_components
from riskweave.session import cut_lineage, drop_scratch

U64 = np.uint64
BLOCK_BITS = 14                      # counters per sketch block
HOT_ROWS = 10_000                    # rows of one shingle that one block should hold


def _sets(column: pa.Array, size: int):
    """Per chunk: first row, number of texts, and sorted distinct (text, shingle hash)."""
    for row, buf, offs in tb.chunks(column, 1 << 18):
        text, h = tb.shingle_hashes(tb.Words(buf, offs), size)
        text, h = tb.distinct_pairs(text, h)
        yield row, len(offs) - 1, text, h


def _signatures(text: np.ndarray, h: np.ndarray, n_texts: int):
    n = np.bincount(text, minlength=n_texts)
    s1 = np.zeros(n_texts, dtype=np.uint64)
    s2 = np.zeros(n_texts, dtype=np.uint64)
    if len(h):
        some = np.flatnonzero(n)
        at = np.r_[0, np.cumsum(n)[:-1]][some]
        s1[some] = np.add.reduceat(tb.mix(h ^ U64(0x5851F42D4C957F2D)), at)
        s2[some] = np.add.reduceat(tb.mix(h ^ U64(0x14057B7EF767814F)), at)
    return n, s1, s2


def _features(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """id, n, s1, s2 per row of ``docs``, and sketch blocks (block, counts) per task."""
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = docs.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    names = ["id", "n", "s1", "s2", "block", "counts"]

    def run(batches):
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        for b in batches:
            for row, k, text, h in _sets(b.column(1), size):
                np.add.at(sketch, (h >> U64(64 - bits)).astype(np.int64), np.uint32(1))
                n, s1, s2 = _signatures(text, h, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, k), pa.array(n.astype(np.int32)), pa.array(tb.as_signed(s1)),
                     pa.array(tb.as_signed(s2)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        parts = sketch.reshape(-1, 1 << min(BLOCK_BITS, bits))
        used = [i for i in range(len(parts)) if parts[i].any()]
        m = len(used)
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, arrow_id), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                 pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())],
                names=names)

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.IntegerType()),
                           T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
                           T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _sum_sketch(features: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: fixed size, whatever the corpus. Blocks are added as they stream by."""
    width = 1 << min(BLOCK_BITS, bits)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
                total[block] = total.get(block, np.zeros(width, dtype=np.uint64)) + got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                              pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                             names=["block", "counts"])

    blocks = (features.filter(F.col("block").isNotNull()).select("block", "counts").repartition("block")
                      .mapInArrow(run, "block int, counts binary").collect())
    sketch = np.zeros(1 << bits, dtype=np.uint64)
    for r in blocks:
        sketch[r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint64)
    return np.minimum(sketch, U64(2 ** 32 - 1)).astype(np.uint32)


def prefix_length(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


def _prefixes(docs: DataFrame, sketch, bits: int, size: int, num: int, den: int) -> DataFrame:
    """(token, salt, np, sid): the first shingles of each set; np = size * 2^32 + position."""

    def run(batches):
        counts = sketch.value
        noise = 4.0 * float(counts.sum(dtype=np.float64)) / len(counts)
        hot = max(HOT_ROWS, noise)
        seen: set[int] = set()
        for b in batches:
            for _, k, text, h in _sets(b.column(1), size):
                n, s1, _ = _signatures(text, h, k)
                new = np.zeros(k, dtype=bool)
                for i in np.flatnonzero(n):
                    if (s := int(s1[i])) not in seen:
                        seen.add(s)
                        new[i] = True
                pick = new[text]
                text, h = text[pick], h[pick]
                if not len(h):
                    continue
                est = counts[(h >> U64(64 - bits)).astype(np.int64)]
                order = np.lexsort((est, text))          # stable: ties stay in hash order
                text, h, est = text[order], h[order], est[order]
                n_new = np.bincount(text, minlength=k)
                pos = np.arange(len(text)) - np.r_[0, np.cumsum(n_new)[:-1]][text]
                head = pos < prefix_length(n_new, num, den)[text]
                text, h, est, pos = text[head], h[head], est[head], pos[head]
                spread = np.where(est > hot, np.ceil(est / hot), 1).astype(np.uint64)
                sid = s1[text]
                salt = np.where(spread > 1, 1 + tb.mix(sid) % spread, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tb.as_signed(h)), pa.array(salt), pa.array((n_new[text] << 32) + pos),
                     pa.array(tb.as_signed(sid))], names=["token", "salt", "np", "sid"])

    return docs.mapInArrow(run, "token long, salt int, np long, sid long")


def _postings(prefixes: DataFrame) -> DataFrame:
    """Streams rows sorted by (token, salt, np, sid); drops repeats and shingles of one class only."""
    names = ["token", "np", "sid"]

    def run(batches):
        held = None                                        # the last row, undecided until the next one is seen
        prev = None                                        # shingle block of the row before it

        def settle(cols, stop):
            """Of the first ``stop`` rows, those with a neighbour in their shingle block."""
            nonlocal prev
            tok, salt, npos, sid = cols
            m = len(tok)
            same = np.zeros(m + 1, dtype=bool)             # row i and row i - 1 belong to one block
            same[1:m] = (tok[1:] == tok[:-1]) & (salt[1:] == salt[:-1])
            same[0] = prev is not None and prev == (tok[0], salt[0])
            keep = np.flatnonzero(same[:stop] | same[1:stop + 1] | (salt[:stop] > 0))
            if stop:
                prev = (tok[stop - 1], salt[stop - 1])
            return pa.RecordBatch.from_arrays([pa.array(c[:stop][keep]) for c in (tok, npos, sid)], names=names)

        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(4)]
            if held is not None:
                cols = [np.r_[x, c] for x, c in zip(held, cols)]
            tok, salt, npos, sid = cols
            if not len(tok):
                continue
            once = np.ones(len(tok), dtype=bool)
            once[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1]) | (npos[1:] != npos[:-1])
            cols = [c[once] for c in cols]
            out = settle(cols, len(cols[0]) - 1)
            held = [c[-1:] for c in cols]
            if out.num_rows:
                yield out
        if held is not None:
            out = settle(held, 1)
            if out.num_rows:
                yield out

    order = ["token", "salt", "np", "sid"]
    return (prefixes.repartition("token", "salt").sortWithinPartitions(*order)
                    .mapInArrow(run, "token long, np long, sid long"))


def _stars(post: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of every row with the leader of its shingle and size band: the class that
    shares most shingles with others, which among near copies is the least changed one."""
    band = F.floor(F.log(F.shiftright("np", 32).cast("double")) / float(np.log(den / num)) + 1e-9)
    degree = post.groupBy("sid").agg(F.count("*").alias("degree"))
    ranked = cut_lineage(post.join(degree, "sid").withColumn("band", band))
    top = ranked.groupBy("token", "band").agg(F.max(F.struct("degree", "sid", "np")).alias("m"))
    pairs = ranked.join(top, ["token", "band"]).select(
        F.col("m.sid").alias("sa"), F.col("m.np").alias("na"), F.col("sid").alias("sb"), F.col("np").alias("nb"))
    return pairs.filter((F.col("sa") != F.col("sb")) & _may_match(F.col("na"), F.col("nb"), num, den))


def _may_match(np_a, np_b, num: int, den: int):
    """Length and positional filters for a common shingle at these places."""
    na, nb = (F.shiftright(c, 32) for c in (np_a, np_b))
    ra, rb = (F.shiftright(c, 32) - c.bitwiseAND(F.lit(0xFFFFFFFF)) for c in (np_a, np_b))
    return ((den * F.least(na, nb) >= num * F.greatest(na, nb))
            & ((num + den) * F.least(ra, rb) >= num * (na + nb)))


def _verify(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ids whose sets link; sets are shipped for the involved ids only."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(ids.hint("shuffle_hash"), "id", "left_semi")
    id_type = docs.schema["id"]

    def pack(batches):
        for b in batches:
            for row, k, text, h in _sets(b.column(1), size):
                n = np.bincount(text, minlength=k)
                offs = pa.array((np.r_[0, np.cumsum(n)] * 8).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), k, [None, offs.buffers()[1], pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, k), packed], names=["id", "items"])

    sets = cut_lineage(texts.mapInArrow(pack, T.StructType([id_type, T.StructField("items", T.BinaryType())])))
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").select("a", "b", "ia", "ib")
    cuts = np.arange(1, 16, dtype=np.uint64) << U64(60)

    def check(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            for i, (xa, xb) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (xa, xb))
                total = len(x) + len(y)
                # suffix filter: elements in one set only, counted from below per hash range
                cx, cy = (np.diff(np.r_[0, np.searchsorted(v, cuts), len(v)]) for v in (x, y))
                apart = int(np.abs(cx - cy).sum())
                if (num + den) * (total - apart) < 2 * num * total:
                    continue
                both_sorted = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both_sorted[1:] == both_sorted[:-1]).sum())
                ok[i] = den * common >= num * (total - common)
            if ok.any():
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    kind = id_type.dataType
    out = cut_lineage(both.mapInArrow(check, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct())
    drop_scratch(sets)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                       num: int = 75, den: int = 100, sketch_bits: int = 20) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``."""
    tb.bound_batches(docs)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = src.filter(F.col("id").isNotNull())
    feats = cut_lineage(_features(src, size, sketch_bits))
    sketch = src.sparkSession.sparkContext.broadcast(_sum_sketch(feats, sketch_bits))
    rows = feats.filter(F.col("block").isNull()).select("id", "n", "s1", "s2")
    full = rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = cut_lineage(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")))
    post = cut_lineage(_postings(_prefixes(known, sketch, sketch_bits, size, num, den)))

    # rows of one id in several classes make these one document
    shared = (full.groupBy("id").agg(F.min(F.struct("s1", "s2", "n")).alias("lo"), F.max(F.struct("s1", "s2", "n")).alias("hi"))
                  .filter("lo != hi").select("id"))
    torn = full.join(shared, "id").join(classes, ["s1", "s2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))

    def named(pairs: DataFrame) -> DataFrame:
        """(sid, np) pairs to distinct ordered pairs of representatives."""
        p = pairs.select("sa", F.shiftright("na", 32).cast("int").alias("na"),
                         "sb", F.shiftright("nb", 32).cast("int").alias("nb")).distinct()
        ca = classes.select(F.col("s1").alias("sa"), F.col("n").alias("na"), F.col("rep").alias("ra"))
        cb = classes.select(F.col("s1").alias("sb"), F.col("n").alias("nb"), F.col("rep").alias("rb"))
        return (p.join(ca, ["sa", "na"]).join(cb, ["sb", "nb"]).filter("ra != rb")
                 .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())

    first = cut_lineage(named(_stars(post, num, den)))
    links = _verify(known, first, size, num, den)
    reps = classes.select(F.col("rep").alias("id")).unionByName(torn.select(F.col("a").alias("id")))
    comps = connected_components(reps, links.unionByName(torn), src="a", dst="b")

    placed = classes.join(comps.withColumnRenamed("id", "rep"), "rep").select(
        F.col("s1").alias("sid"), "n", "component")
    where = cut_lineage(post.withColumn("n", F.shiftright("np", 32).cast("int")).join(placed, ["sid", "n"])
                            .select("token", "np", "sid", "component"))
    mixed = where.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    open_rows = cut_lineage(where.join(mixed.select("token"), "token", "left_semi"))
    x = open_rows.select("token", F.col("np").alias("na"), F.col("sid").alias("sa"), F.col("component").alias("ka"))
    y = open_rows.select("token", F.col("np").alias("nb"), F.col("sid").alias("sb"), F.col("component").alias("kb"))
    rest = named(x.join(y, "token").filter((F.col("ka") < F.col("kb")) & _may_match(F.col("na"), F.col("nb"), num, den)))
    second = cut_lineage(rest.join(first, ["a", "b"], "left_anti"))
    more = _verify(known, second, size, num, den)
    if not more.isEmpty():
        comps = connected_components(reps, links.unionByName(more).unionByName(torn), src="a", dst="b")

    placed = cut_lineage(classes.join(comps.withColumnRenamed("id", "rep"), "rep").select("s1", "s2", "n", "component"))
    linked = rows.join(placed, ["s1", "s2", "n"]).filter(F.col("id").isNotNull())
    alone = rows.filter((F.col("n") == 0) | F.col("id").isNull())
    out = (linked.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                         F.col("component").alias("component_id"))
                 .unionByName(alone.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                                           F.col("id").alias("component_id"))))
    drop_scratch(post, first, links, where, open_rows, second, more)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Rows of ``docs`` whose id is the least of its component, or null; all columns stay."""
    comp = cut_lineage(jaccard_components(docs, id_col, text_col, **params))
    out = comp.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(out.hint("shuffle_hash"), F.col(id_col) == F.col("_gone"), "left_anti")
