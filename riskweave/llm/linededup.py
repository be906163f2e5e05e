"""Line dedup over a whole corpus, returned as keep bitmaps.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
A-Z lower-cased. A key of at least ``min_chars`` code points that occurs in at
least two documents loses all its lines except those of the smallest id that
holds it.

Method: every such line becomes (128-bit key hash, id, text fingerprint,
position). The rows are range-partitioned and sorted by all of these, so a
hash that a third of all documents share simply spans several partitions.
Each partition is streamed once: the first row of a hash names the keeper,
later rows of another id are dropped. Only the first hash of a partition can
continue from the partition before; those boundaries (one row per partition)
are resolved together. What comes out are positions, packed per document into
a zlib-compressed bitmap; texts meet their bitmap only when it is applied.

Defined cases: a null or empty text is one empty line and loses nothing. Rows
with the same id are one document, so lines they share among themselves stay;
each row gets the bitmap of its own text. A null id counts as one document
that comes after all others. An empty table gives an empty result. Other
columns pass through ``apply_bitmaps`` whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbits as tb
from riskweave.session import cut_lineage, drop_scratch


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def _lines_of(buf: np.ndarray, offs: np.ndarray, min_chars: int):
    """(text, position, n_lines of each text, hash pair) of the lines with long enough keys."""
    nl = np.flatnonzero(buf == 0x0A)
    owner = np.searchsorted(offs, nl, side="right") - 1
    n_lines = np.bincount(owner, minlength=len(offs) - 1) + 1
    text = np.repeat(np.arange(len(n_lines)), n_lines)
    first = np.r_[0, np.cumsum(n_lines)[:-1]]
    pos = np.arange(len(text)) - first[text]
    start = offs[text].copy()
    end = offs[text + 1].copy()
    later = pos > 0
    start[later] = nl + 1                       # the k-th newline ends the k-th line that has a successor
    has_next = pos < n_lines[text] - 1
    end[has_next] = nl
    solid = np.flatnonzero(~tb.SPACE[buf])
    lo = np.searchsorted(solid, start)
    hi = np.searchsorted(solid, end)
    some = hi > lo
    s = solid[lo[some]]
    e = solid[hi[some] - 1] + 1
    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    long = points[e] - points[s] >= min_chars
    at = np.flatnonzero(some)[long]
    s, e = s[long], e[long]
    low = tb.LOWER[buf]
    return text[at], pos[at], n_lines, tb.range_hashes(low, s, e, 11), tb.range_hashes(low, s, e, 12)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line with a long enough key: h1, h2, id, fp, pos, n_lines."""
    id_type = docs.schema[id_col].dataType
    out_type = _arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0), b.column(1)
            for row, buf, offs in tb.chunks(b.column(2)):
                text, pos, n_lines, h1, h2 = _lines_of(buf, offs, min_chars)
                if len(text):
                    at = pa.array(text + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tb.as_signed(h1)), pa.array(tb.as_signed(h2)), ids.take(at).cast(out_type),
                         fps.take(at), pa.array(pos.astype(np.int32)), pa.array(n_lines[text].astype(np.int32))],
                        names=["h1", "h2", "id", "fp", "pos", "n_lines"])

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("fp"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                           T.StructField("id", id_type), T.StructField("fp", T.LongType()),
                           T.StructField("pos", T.IntegerType()), T.StructField("n_lines", T.IntegerType())])
    return src.mapInArrow(run, schema)


def _stream_firsts(lines: DataFrame) -> DataFrame:
    """Stream each sorted partition: rows to drop, rows of the partition's first
    hash (undecided until the boundaries are known), and one boundary row."""
    id_type = lines.schema["id"].dataType

    def run(batches):
        import pandas as pd
        pid = TaskContext.get().partitionId()
        first = last = None                      # (h1, h2)
        head_id = keep_id = None                 # keeper of the first and of the current hash
        groups = 0

        def same(a, b):
            return (a is None and b is None) or (a is not None and b is not None and a == b)

        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            h1, h2 = (np.asarray(b.column(i)) for i in (0, 1))
            ids = b.column(2)
            code = pd.factorize(pd.Series(ids.to_pandas(integer_object_nulls=True) if ids.null_count else ids.to_pandas()),
                                use_na_sentinel=False)[0]
            new = np.ones(n, dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            goes_on = last == (h1[0], h2[0])
            if goes_on:
                new[0] = False
            heads = np.flatnonzero(new)
            g = np.cumsum(new)                   # 0: the group carried over
            firsts = np.r_[-1, heads]
            keeper = np.where(firsts[g] >= 0, code[np.maximum(firsts[g], 0)], -2)
            if goes_on:
                carried = code[0] if same(ids[0].as_py(), keep_id) else -2   # sorted: a keeper's rows come first
                keeper[g == 0] = carried
            drop = keeper != code
            in_first = (g + groups) == 1
            if first is None:
                first, head_id = (h1[0], h2[0]), ids[0].as_py()
            if len(heads):
                keep_id = ids[int(heads[-1])].as_py()
            groups += len(heads)
            last = (h1[-1], h2[-1])
            at = np.flatnonzero(drop | in_first)
            m = len(at)
            if m:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), b.column(3).take(take), b.column(4).take(take), b.column(5).take(take),
                     pa.array(drop[at]), pa.array(np.full(m, pid), pa.int32(), mask=~in_first[at]),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.int64()), pa.nulls(m, ids.type)], names=names)
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([head_id], _arrow_type(id_type)), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                 pa.nulls(1, pa.int32()), pa.array([False]), pa.array([pid], pa.int32()),
                 pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([last[0]], pa.int64()),
                 pa.array([last[1]], pa.int64()), pa.array([groups], pa.int64()),
                 pa.array([keep_id], _arrow_type(id_type))], names=names)

    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("fp", T.LongType()), T.StructField("pos", T.IntegerType()),
         T.StructField("n_lines", T.IntegerType()), T.StructField("drop", T.BooleanType()),
         T.StructField("pid", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("f1", "f2", "l1", "l2", "groups")]
        + [T.StructField("last_keeper", id_type)])
    names = schema.fieldNames()
    return lines.mapInArrow(run, schema)


def _continued(edges: list) -> list[tuple]:
    """(pid, keeper) of the partitions whose first hash began in an earlier one."""
    out, prev_last, prev_keeper = [], None, None
    for r in sorted(edges, key=lambda r: r["pid"]):
        goes_on = prev_last == (r["f1"], r["f2"])
        if goes_on:
            out.append((r["pid"], prev_keeper))
        prev_last = (r["l1"], r["l2"])
        if not (goes_on and r["groups"] == 1):
            prev_keeper = r["last_keeper"]
    return out


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = 10) -> DataFrame:
    """(id, fp, n_lines, n_dropped, keep) for the documents that lose lines.

    ``keep`` is a zlib-compressed bitmap, one bit per line, first line in the
    highest bit of the first byte. ``fp`` is ``xxhash64`` of the text and tells
    rows of one id apart. Documents that keep every line have no row.
    """
    spark = docs.sparkSession
    lines = cut_lineage(line_keys(docs, id_col, text_col, min_chars))
    order = ["h1", "h2", F.col("id").asc_nulls_last(), "fp", "pos"]
    flags = cut_lineage(_stream_firsts(lines.repartitionByRange(*order).sortWithinPartitions(*order)))
    edges = flags.filter(F.col("groups").isNotNull()).collect()       # one row per partition
    goes_on = spark.createDataFrame(
        _continued(edges), T.StructType([T.StructField("pid", T.IntegerType()),
                                         T.StructField("keeper", docs.schema[id_col].dataType)]))
    rows = flags.filter(F.col("groups").isNull())
    decided = (rows.join(F.broadcast(goes_on.withColumn("on", F.lit(True))), "pid", "left")
                   .filter(F.when(F.col("on"), ~F.col("id").eqNullSafe(F.col("keeper"))).otherwise(F.col("drop"))))
    lost = decided.groupBy("id", "fp", "n_lines").agg(F.collect_set("pos").alias("lost"))

    def pack(batches):
        for b in batches:
            keep, dropped = [], []
            for n, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                bits = np.ones(n, dtype=np.uint8)
                bits[gone] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())],
                names=["id", "fp", "n_lines", "n_dropped", "keep"])

    schema = T.StructType([lost.schema["id"], lost.schema["fp"], lost.schema["n_lines"],
                           T.StructField("n_dropped", T.IntegerType()), T.StructField("keep", T.BinaryType())])
    out = cut_lineage(lost.mapInArrow(pack, schema))
    drop_scratch(lines, flags)
    return out


def _kept(text: bytes, n: int, keep: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n)
    return b"\n".join(line for line, k in zip(text.split(b"\n"), bits) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """``docs`` with the kept lines in ``text_col``, or with ``digest`` only
    (id, n_lines, n_dropped, kept_sha256)."""
    fields = [f for f in docs.schema.fields if not digest or f.name in (id_col, text_col)]
    at = {f.name: i for i, f in enumerate(fields)}
    left = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)])
    left = left.withColumn("_fp", F.xxhash64(f"c{at[text_col]}"))
    right = bitmaps.select(F.col("id").alias("_id"), F.col("fp").alias("_bfp"), "n_lines", "keep").hint("shuffle_hash")
    both = (left.join(right, F.col(f"c{at[id_col]}").eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_bfp")), "left")
                .drop("_id", "_bfp", "_fp"))
    k = len(fields)

    def run(batches):
        for b in batches:
            col = b.column(at[text_col])
            ns, keeps = b.column(k).to_pylist(), b.column(k + 1).to_pylist()
            raw = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            if not digest:
                texts = raw.to_pylist()
                for i, n in enumerate(ns):
                    if n is not None:
                        texts[i] = _kept(texts[i], n, keeps[i])
                cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at[text_col] else b.column(i) for i in range(k)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
                continue
            n_lines, dropped, sha = [], [], []
            for value, n, keep in zip(raw, ns, keeps):
                text = value.as_py() or b""
                n_lines.append(text.count(b"\n") + 1)
                if n is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n)
                    dropped.append(int(n - bits.sum()))
                    text = b"\n".join(line for line, kept in zip(text.split(b"\n"), bits) if kept)
                else:
                    dropped.append(0)
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(at[id_col]), pa.array(n_lines, pa.int64()),
                                              pa.array(dropped, pa.int64()), pa.array(sha, pa.string())],
                                             names=[id_col, "n_lines", "n_dropped", "kept_sha256"])

    if digest:
        schema = T.StructType([docs.schema[id_col], T.StructField("n_lines", T.LongType()),
                               T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        schema = T.StructType(fields)
    return both.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines removed; all columns and rows stay."""
    return apply_bitmaps(docs, line_keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256), one row per row of ``docs``."""
    return apply_bitmaps(docs, line_keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col, digest=True)
