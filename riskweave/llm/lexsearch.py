"""Ranked lexical search by dense blocked matrix products.

Every item is a query of terms, every document an integer impact per term:

    N documents with a term, L their terms with repeats, n one document's terms,
    df documents holding a term, tf its occurrences in the document
    w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m = 50 + (50 n N) div L
    score = sum over the item's terms of w * ((10^9 tf) div (1000 tf + 20 m))

A term is a maximal run outside ``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``,
with A-Z lower-cased.

1. Items are dealt into blocks of about ``block_bytes`` of text; a block's terms form
   a compact vocabulary (bounded by the block, so it may travel to the tasks).
2. One pass over the whole texts writes, per document, its number of terms and the
   vocabulary terms it holds with their occurrences, to the shared folder. N, L and df
   are aggregates of that table.
3. A second pass takes documents in tiles of ``tile_docs``. For every item tile the
   impacts of the tile's own vocabulary are laid out densely, ``strip`` terms at a
   time, and multiplied by the matrix of weights in float64. A strip is so narrow
   that no sum of its products reaches 2^53, so every partial sum is exact; strips are
   added in 64-bit integers.
4. Of each tile a task keeps, per item, what reaches its ``k``-th best score so far,
   ties included, and returns its best ``k`` by (score, id). The final rank is a window
   over these rows, at most ``k`` per item and task.

Defined cases: null and empty texts have no term, are not in N and are never found.
An item without terms gives no row. Items of one id (null too) are one query with the
terms of all their rows. Documents of one id are documents of their own; rows of equal
score and id come in any order among themselves. A null document id ranks after others
of the same score. An empty table gives an empty result. Only the named columns are
read, so other columns cannot clash. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbits as tb
from riskweave.session import cut_lineage, drop_scratch

U64 = np.uint64
TERM = np.ones(256, dtype=bool)
TERM[:0x80] = False
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = True
MAX_EXACT = 1 << 53
MAX_IMPACT = 1_000_000                     # 10^9 tf / (1000 tf + 20 m) stays below


def terms(buf: np.ndarray, offs: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every term occurrence, in text order."""
    low = tb.LOWER[buf]
    start, end, text = tb.runs(TERM[buf], offs)
    return text, tb.range_hashes(low, start, end, seed)


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[dict]:
    """Blocks of items as {id: sorted term hashes}, one block on the driver at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        block: dict = {}
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b)
        for row in part.toLocalIterator():
            raw = np.frombuffer((row["text"] or "").encode(), dtype=np.uint8)
            _, h = terms(raw, np.array([0, len(raw)]))
            block[row["item"]] = np.union1d(block.get(row["item"], np.zeros(0, U64)), h)
        if any(len(h) for h in block.values()):
            yield block


def _postings(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(id, n, term numbers of the vocabulary, occurrences) per document with a term."""
    out = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()),
                        T.StructField("term", T.ArrayType(T.IntegerType())),
                        T.StructField("tf", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in tb.chunks(batch.column(1)):
                m = len(offs) - 1
                text, h = terms(buf, offs)
                n = np.bincount(text, minlength=m)
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                hit = vocab[at] == h
                key, tf = np.unique(text[hit] * len(vocab) + at[hit], return_counts=True)
                of, term = key // len(vocab), (key % len(vocab)).astype(np.int32)
                edge = np.searchsorted(of, np.arange(m + 1)).astype(np.int32)
                live = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, m).filter(live), pa.array(n[n > 0]),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(term)).filter(live),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(tf.astype(np.int64))).filter(live)],
                    names=out.fieldNames())

    return tb.bound_batches(docs).mapInArrow(run, out)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """50 + (50 n N) div L; in Python's integers where the product would pass 64 bits."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // total for x in n], dtype=np.int64)
    return 50 + (50 * n * docs) // total


class ItemTile:
    """Some items, their compact vocabulary and the matrix of weights, in strips."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, strip: int):
        self.items = len(items)
        self.vocab = np.unique(np.concatenate(items))           # ascending numbers of the block's terms
        top = int(weight[self.vocab].max(initial=1)) or 1
        self.strip = max(1, min(strip, (MAX_EXACT - 1) // (top * MAX_IMPACT)))
        dense = np.zeros((len(self.vocab), self.items))
        for j, its in enumerate(items):
            dense[np.searchsorted(self.vocab, its), j] = weight[its]
        self.strips = [dense[a:a + self.strip] for a in range(0, len(self.vocab), self.strip)]

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """Exact scores (documents x items) of ``n`` documents' postings."""
        at = np.searchsorted(self.vocab, term)
        at[at == len(self.vocab)] = 0
        mine = self.vocab[at] == term
        doc, at, impact = doc[mine], at[mine], impact[mine]
        out = np.zeros((n, self.items), dtype=np.int64)
        for s, weights in enumerate(self.strips):
            lo = s * self.strip
            inside = (at >= lo) & (at < lo + self.strip) if len(self.strips) > 1 else slice(None)
            dense = np.zeros((n, len(weights)))
            dense[doc[inside], at[inside] - lo] = impact[inside]
            out += np.rint(dense @ weights).astype(np.int64)
        return out


def _best(table: pa.Table, k: int) -> pa.Table:
    """The first k rows of every item by score, then id (nulls last)."""
    order = pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")],
                            null_placement="at_end")
    table = table.take(order)
    item = table.column("item").to_numpy()
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return table.filter(pa.array(rank < k))


def _packed(numbers: list[np.ndarray], most: int, cells: int) -> list[list[np.ndarray]]:
    """Items in order, dealt into tiles of at most ``most`` items and ``cells`` matrix cells (one item may pass that)."""
    tiles, width = [], 0
    for its in numbers:
        if not tiles or len(tiles[-1]) == most or (width + len(its)) * (len(tiles[-1]) + 1) > cells:
            tiles.append([])
            width = 0
        tiles[-1].append(its)
        width += len(its)
    return tiles


def _top(postings: DataFrame, packed: list[list[np.ndarray]], weight: np.ndarray, docs: int, total: int,
         k: int, tile_docs: int, strip: int) -> DataFrame:
    out = T.StructType([T.StructField("item", T.IntegerType()), postings.schema["id"],
                        T.StructField("score", T.LongType())])
    first = np.r_[0, np.cumsum([len(items) for items in packed])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [ItemTile(items, weight, strip) for items in packed]
        floor = np.ones(first[-1], dtype=np.int64)               # a score below it cannot rank
        held: list[pa.Table] = []
        waiting = 0

        def settle():
            nonlocal held, waiting
            best = _best(pa.concat_tables(held), k)
            item = best.column("item").to_numpy()
            count = np.bincount(item, minlength=len(floor))
            full = np.flatnonzero(count >= k)
            last = np.cumsum(count)[full] - 1
            floor[full] = np.maximum(floor[full], best.column("score").to_numpy()[last])
            held, waiting = [best], 0

        for batch in batches:
            ids = batch.column(0)
            for a in range(0, batch.num_rows, tile_docs):
                part = batch.slice(a, tile_docs)
                rows = part.num_rows
                n = part.column(1).to_numpy()
                term = part.column(2).flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(rows), pc.list_value_length(part.column(2)).to_numpy())
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * lengths(n, docs, total)[doc])
                for t, tile in enumerate(tiles):
                    score = tile.scores(doc, term, impact, rows)
                    low = floor[first[t]:first[t + 1]]
                    if rows > k:                                  # the tile's own k-th best, ties stay
                        low = np.maximum(low, np.partition(score, rows - k, axis=0)[rows - k])
                    d, j = np.nonzero(score >= low)
                    if len(d):
                        held.append(pa.table({"item": pa.array((j + first[t]).astype(np.int32)),
                                              "id": ids.take(pa.array(d + a)), "score": pa.array(score[d, j])}))
                        waiting += len(d)
                if waiting > 4 * k * len(floor):
                    settle()
        if held:
            settle()
            for b in held[0].combine_chunks().to_batches():
                yield b

    return postings.mapInArrow(run, out)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", k: int = 50,
           block_bytes: int = 1 << 20, tile_docs: int = 512, tile_items: int = 128, tile_cells: int = 1 << 22,
           strip: int = 2048) -> DataFrame:
    """(item, rank, document, score): the ``k`` best documents with a score above 0 of every item."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    spark, found = docs.sparkSession, None
    for block in _item_blocks(asked, block_bytes):
        names = [i for i, h in block.items() if len(h)]
        vocab = np.unique(np.concatenate([block[i] for i in names]))
        postings = cut_lineage(_postings(texts, vocab))
        n_docs, total = postings.agg(F.count("*"), F.sum("n")).head()
        if not n_docs:
            break
        df = np.zeros(len(vocab), dtype=np.int64)
        for row in postings.select(F.explode("term").alias("t")).groupBy("t").count().collect():   # a row per term of the block
            df[row["t"]] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        numbers = [np.searchsorted(vocab, block[i]) for i in names]
        top = _top(postings, _packed(numbers, tile_items, tile_cells), weight, n_docs, total, k, tile_docs, strip)
        key = T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, asked.schema["item"].dataType)])
        named = spark.createDataFrame(list(enumerate(names)), key)   # bounded by the block
        by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = (top.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
                  .join(F.broadcast(named), "item").select(item_col, "rank", F.col("id").alias("_doc"), "score"))
        ranked = cut_lineage(ranked)
        drop_scratch(postings)
        found = ranked if found is None else found.unionAll(ranked)
    if found is None:
        schema = T.StructType([T.StructField(item_col, asked.schema["item"].dataType), T.StructField("rank", T.IntegerType()),
                               T.StructField("_doc", texts.schema["id"].dataType), T.StructField("score", T.LongType())])
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("_doc", id_col)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, stats GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), stats
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
