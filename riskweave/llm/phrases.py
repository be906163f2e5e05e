"""Phrase collocation mining on a weighted de Bruijn graph.

Texts (A-Z lower-cased) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
words ``[^\\x20\\x09]+``. Per language, the nodes of the graph are runs of three words,
an edge is a run of four, leading from its first three words to its last three, and
its weight is the number of times it occurs.

1. ``words``: one word count per language. Words below ``min_count``, and pairs of words
   below it, can be in no phrase; bitmaps of the hashes of the others (2^27 bits each at
   most) go to the tasks. They only save rows: a rare run that a bitmap lets through
   changes no count, and no count is taken from them.
2. ``edges``: every position in a piece gives one row, the longest run of at most four
   words that begins there and holds no rare word or pair. Runs of four are edges; shorter
   ones are the piece-end corrections: the run ends with its piece, or before what is too
   rare to be in a phrase. Rows are summed in the task, then over all tasks.
3. ``flows``: a run of three occurs as often as its node sends out edges, plus its
   corrections; runs of two and one follow from runs of three and two in the same way.
   No shorter run is ever counted in the texts.
4. ``paths``: an edge that enters a node with all of the node's flow and the one that
   leaves it with all of it belong together. Such unary chains are joined by pointer
   doubling over the edges of at least ``min_count`` (about log2 of the longest piece
   rounds, tables written to the shared folder), giving repeated passages of any
   length with one weight. The flow of a node inside a path is the path's weight, so
   only the nodes at path ends are looked up, and runs of three inside a path are
   dropped at once, the edge around them being as frequent.
5. ``scored``: for each candidate, the counts of the parts of every cut, the lowest
   score, and the longer candidates that cover it.

Words are compared by 64-bit hashes; phrases, scores and ranks are exact beyond that
(a false match needs two words of one language with the same hash). Scores are decimal
arithmetic. Keys that hold many rows (the first word of many phrases) are joined with
salted copies of the flows.

Defined cases: a null text is empty, a null language ``und``; an empty table gives an
empty result; repeated rows count as often as they occur; other columns are not read.
Very long texts, pieces and words are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import textbits as tb
from riskweave.session import cut_lineage, drop_scratch

U64 = np.uint64
BREAK, BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[0x0A:0x0E] = True
BLANK[[0x20, 0x09]] = True
LONGEST = 4
GRAM = ["w1", "w2", "w3", "w4"]
MAX_BITS = 27
SALTS = 8
HOLD = 2_000_000       # distinct pairs a task sums before it sends them on


def _read(batch: pa.RecordBatch):
    """(languages, language of each word, piece of each word, word hash, start, end, bytes) of runs of whole texts."""
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary
    code = langs.indices.to_numpy()
    for row, buf, offs in tb.chunks(batch.column(1)):
        low = tb.LOWER[buf]
        cut = BREAK[low]
        start, end, text = tb.runs(~(cut | BLANK[low]), offs)
        piece = np.cumsum(cut)[start] + text if len(start) else np.zeros(0, np.int64)
        yield names, code[row + text], piece, tb.range_hashes(low, start, end), start, end, low


def _group(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each distinct key, its number of rows)."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, n])


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return tb.bound_batches(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                                        F.col(text_col).alias("text")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, h, word, n) for every distinct word of a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, lang, _, h, start, end, low in _read(batch):
                at, n = _group([lang, h])
                raw = low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang[at])), pa.array(tb.as_signed(h[at])),
                     pa.array([raw[a:b] for a, b in zip(start[at], end[at])], pa.binary()).cast(pa.string()),
                     pa.array(n)], names=["lang", "h", "word", "n"])

    return texts.mapInArrow(run, "lang string, h long, word string, n long").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))


class Bitmap:
    """Hashes of the rows of ``keys.h``, as a bitmap that Spark builds in pieces of 32,768 bits."""

    def __init__(self, keys: DataFrame):
        self.bits = min(MAX_BITS, max(15, (16 * keys.count()).bit_length()))
        cell = F.shiftrightunsigned("h", 64 - self.bits)
        # bitmap positions count from 1 within buckets that also count from 1
        parts = (keys.select((cell + 1).alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("part"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("map")).collect())
        self.map = np.zeros((1 << self.bits) // 8, dtype=np.uint8)
        for r in parts:                                    # 4096 pieces at most
            self.map[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["map"], dtype=np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        cell = (h >> U64(64 - self.bits)).astype(np.int64)
        return (self.map[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _pair_hash(names: pa.Array, lang: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of each word, the one after it, and their language."""
    raw = [n.encode() for n in names.to_pylist()]
    offs = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
    of = tb.range_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), offs[:-1], offs[1:])
    return tb.mix(tb.mix(h[:-1] + of[lang[:-1]]) * U64(0x2545F4914F6CDD1D) + h[1:])


def wanted_pairs(texts: DataFrame, wanted: Bitmap, min_count: int) -> DataFrame:
    """(h): hashes of the pairs of wanted words found ``min_count`` times or more in a language.
    A task sums what it holds, up to about ``HOLD`` distinct pairs at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            h, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return h[at], np.add.reduceat(n, at)

        for batch in batches:
            for names, lang, piece, h, *_ in _read(batch):
                live = wanted.has(h)
                both = live[:-1] & live[1:] & (piece[:-1] == piece[1:])
                key, n = np.unique(_pair_hash(names, lang, h)[both], return_counts=True) if len(h) > 1 else (h[:0], np.zeros(0, np.int64))
                held.append((key, n))
                rows += len(key)
                if rows > HOLD:
                    held = [flush()]
                    rows = len(held[0][0])
                    if rows > HOLD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(tb.as_signed(held[0][0])), pa.array(held[0][1])], names=["h", "n"])
                        held, rows = [], 0
        if rows:
            key, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(tb.as_signed(key)), pa.array(n)], names=["h", "n"])

    return (texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count).select("h"))


def edge_counts(texts: DataFrame, words: Bitmap, pairs: Bitmap) -> DataFrame:
    """(lang, w1..w4, n): the longest run of at most four words without a rare word or pair at
    every position; missing words of shorter runs are null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, lang, piece, h, *_ in _read(batch):
                n = len(h)
                if n == 0:
                    continue
                want = words.has(h)
                joins = np.zeros(n, dtype=bool)            # the word and the next one may be in a phrase
                if n > 1:                                  # pieces never cross texts, so nor do runs
                    joins[:-1] = want[:-1] & want[1:] & (piece[:-1] == piece[1:])
                    joins[:-1] &= pairs.has(_pair_hash(names, lang, h))
                size = want.astype(np.int8)
                for k in range(1, LONGEST):
                    more = np.zeros(n, dtype=bool)
                    more[:n - k] = joins[k - 1:n - 1] if n > k else False
                    size += (size == k) & more
                at = np.flatnonzero(size > 0)
                size = size[at]
                src = np.minimum(at[:, None] + np.arange(LONGEST), n - 1)
                grams = [np.where(size > k, h[src[:, k]], U64(0)) for k in range(LONGEST)]
                first, count = _group([lang[at], size, *grams])
                size = size[first]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang[at][first]))]
                    + [pa.array(tb.as_signed(g[first]), mask=size <= k) for k, g in enumerate(grams)]
                    + [pa.array(count)], names=["lang", *GRAM, "n"])

    schema = "lang string, w1 long, w2 long, w3 long, w4 long, n long"
    return texts.mapInArrow(run, schema).groupBy("lang", *GRAM).agg(F.sum("n").alias("n"))


def flows(edges: DataFrame, min_count: int) -> list[DataFrame]:
    """[f1, f2, f3, f4]: runs of each length and their counts of ``min_count`` or more, from the
    edges down; each written."""
    found = {LONGEST: edges.filter("w4 IS NOT NULL").select("lang", *GRAM, F.col("n").alias("f"))}
    node = edges.filter("w3 IS NOT NULL").groupBy("lang", *GRAM[:3]).agg(F.sum("n").alias("f"))
    nodes = []
    for size in (3, 2, 1):
        node = cut_lineage(node)
        nodes.append(node)
        found[size] = node
        if size > 1:                                       # every run of size words continues one of size - 1
            short = edges.filter(F.col(GRAM[size - 2]).isNotNull() & F.col(GRAM[size - 1]).isNull())
            node = (node.select("lang", *GRAM[:size - 1], "f")
                    .unionByName(short.select("lang", *GRAM[:size - 1], F.col("n").alias("f")))
                    .groupBy("lang", *GRAM[:size - 1]).agg(F.sum("f").alias("f")))
    out = [cut_lineage(found[k].filter(F.col("f") >= min_count)) for k in range(1, LONGEST + 1)]
    drop_scratch(*nodes)
    return out


def unary_paths(f3: DataFrame, f4: DataFrame) -> DataFrame:
    """(lang, w1..w4, f, head, depth): every edge, the number of its path's first edge and its place in the path."""
    edges = f4
    into = edges.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "f",
                        F.struct(*GRAM).alias("prev"))
    out = edges.select("lang", "w1", "w2", "w3", "f", F.struct(*GRAM).alias("this"))
    # an edge with all of its node's flow is alone on that side, so these joins are one to one
    links = (f3.join(into, ["lang", "w1", "w2", "w3", "f"]).join(out, ["lang", "w1", "w2", "w3", "f"])
             .select("lang", "this", "prev"))
    at = cut_lineage(edges.select("lang", F.struct(*GRAM).alias("this"))
                     .join(links, ["lang", "this"], "left")
                     .select("lang", "this", F.coalesce("prev", "this").alias("to"),
                             F.col("prev").isNotNull().cast("int").alias("depth")))
    while True:
        far = at.select("lang", F.col("this").alias("to"), F.col("to").alias("next"), F.col("depth").alias("step"))
        after = cut_lineage(at.join(far, ["lang", "to"]).select(
            "lang", "this", F.col("next").alias("to"), (F.col("depth") + F.col("step")).alias("depth"),
            (F.col("step") > 0).alias("moved")))
        moving = after.filter("moved").limit(1).count()
        drop_scratch(at)
        at = after.drop("moved")
        at._scratch_path = after._scratch_path
        if not moving:
            break
    done = cut_lineage(at.select("lang", F.col("this.*"), F.col("to").alias("head"), "depth")
                       .join(edges, ["lang", *GRAM]))
    drop_scratch(at)
    return done


@dataclass
class Graph:
    """Tables of one corpus; ``drop`` deletes them once nothing reads them any more."""
    words: DataFrame
    totals: DataFrame
    counts: list[DataFrame]
    steps: DataFrame
    scratch: list[DataFrame]

    def drop(self) -> None:
        drop_scratch(*self.scratch)

    def paths(self) -> DataFrame:
        """(lang, words, weight): the compacted paths, as texts; a path is no longer than a piece."""
        spelled = self.steps
        for c in GRAM:
            spelled = _spell(spelled, self.words, c)
        by = spelled.groupBy("lang", "head").agg(F.max("f").alias("weight"), F.array_sort(F.collect_list(
            F.struct("depth", *[f"s_{c}" for c in GRAM]))).alias("edges"))
        first = F.array(*[F.col("edges")[0][f"s_{c}"] for c in GRAM[:3]])
        return by.select("lang", F.concat(first, F.col("edges.s_w4")).alias("words"), "weight")


def build(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30) -> Graph:
    texts = _texts(docs, text_col, lang_col)
    counted = cut_lineage(word_counts(texts))
    words = cut_lineage(counted.filter(F.col("n") >= min_count).select("lang", "h", "word"))
    totals = cut_lineage(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    drop_scratch(counted)
    wanted = Bitmap(words)
    common = cut_lineage(wanted_pairs(texts, wanted, min_count))
    pairs = Bitmap(common)
    drop_scratch(common)
    edges = cut_lineage(edge_counts(texts, wanted, pairs))
    counts = flows(edges, min_count)
    drop_scratch(edges)
    steps = unary_paths(counts[2], counts[3])
    return Graph(words, totals, counts, steps, [words, totals, *counts, steps])


def _spell(rows: DataFrame, words: DataFrame, col: str) -> DataFrame:
    """Adds ``s_<col>``, the word whose hash is in ``col``; a word of many rows is spread over SALTS keys."""
    spread = words.select("lang", F.col("h").alias(col), F.col("word").alias(f"s_{col}"),
                          F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("_salt"))
    salt = F.pmod(F.xxhash64(*GRAM), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(spread, ["lang", col, "_salt"], "left").drop("_salt")


def _part(words: list, known=None):
    """A run of one to three words as a key: (size, p1, p2, p3); without words where its count is known."""
    none = F.lit(None).cast("long")
    cols = [w if known is None else F.when(known.isNull(), w) for w in words]
    return F.struct(F.lit(len(words)).alias("size"), *[(cols[i] if i < len(words) else none).alias(f"p{i + 1}") for i in range(3)],
                    (none if known is None else known).alias("known"))


def _cuts(graph: Graph) -> DataFrame:
    """(lang, w1..w4 (null where shorter), a, k, l, r): every candidate with every cut and its parts' counts."""
    f2, f3 = graph.counts[1], graph.counts[2]
    # the flow of a node inside a path is the path's weight; only nodes at path ends are looked up
    last = graph.steps.groupBy("lang", "head").agg(F.max("depth").alias("end"))
    four = graph.steps.join(last, ["lang", "head"]).select("lang", *GRAM, F.col("f").alias("a"), "depth", "end")
    before, after = F.when(F.col("depth") > 0, F.col("a")), F.when(F.col("depth") < F.col("end"), F.col("a"))
    rows = None
    for size, table in ((2, f2), (3, f3), (4, four)):
        table = table.withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, size):
            left, right = [F.col(c) for c in GRAM[:k]], [F.col(c) for c in GRAM[k:size]]
            cuts.append(F.struct(F.lit(k).alias("k"), _part(left, before if k == 3 else None).alias("l"),
                                 _part(right, after if size - k == 3 else None).alias("r")))
        here = table.select("lang", *[F.col(c) if c in GRAM[:size] else F.lit(None).cast("long").alias(c) for c in GRAM], "a",
                            F.explode(F.array(*cuts)).alias("cut"))
        rows = here if rows is None else rows.unionByName(here)
    none = F.lit(0).cast("long")
    parts = None
    for size, table in enumerate(graph.counts[:3], 1):
        t = table.select("lang", F.lit(size).alias("size"), *[(F.col(GRAM[i]) if i < size else none).alias(f"p{i + 1}") for i in range(3)],
                         F.col("f"), F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("_salt"))
        parts = t if parts is None else parts.unionByName(t)
    key = ["lang", "size", "p1", "p2", "p3", "_salt"]
    salt = F.pmod(F.xxhash64(*GRAM), F.lit(SALTS)).cast("int").alias("_salt")
    for side in ("l", "r"):
        filled = [F.when(F.col(f"cut.{side}.size") > i, F.col(f"cut.{side}.p{i + 1}")).otherwise(none).alias(f"p{i + 1}") for i in range(3)]
        rows = (rows.select("*", F.col(f"cut.{side}.size").alias("size"), *filled, salt)
                .join(parts, key, "left").withColumn(f"n_{side}", F.coalesce(f"cut.{side}.known", "f")).drop(*key[1:], "f"))
    return rows.select("lang", *GRAM, "a", "cut.k", F.col("n_l").alias("l"), F.col("n_r").alias("r"))


def _covered(graph: Graph, cover_pct: int) -> DataFrame:
    """Candidates (lang, w1..w3) inside a longer one of at least ``cover_pct`` per cent of their count."""
    f1, f2, f3, f4 = graph.counts

    def inside(rows, size, length):
        return [rows.select("lang", *[F.col(GRAM[s + i]).alias(GRAM[i]) for i in range(size)], F.col("f").alias("over"))
                for s in range(length - size + 1)]

    out = []
    for size, parts in ((3, inside(f4, 3, 4)), (2, inside(f4, 2, 4) + inside(f3, 2, 3))):
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        keys = ["lang", *GRAM[:size]]
        most = rows.groupBy(*keys).agg(F.max("over").alias("over"))
        hit = graph.counts[size - 1].join(most, keys).filter(F.lit(100) * F.col("over") >= F.lit(cover_pct) * F.col("f"))
        out.append(hit.select(*keys, *[F.lit(None).cast("long").alias(c) for c in GRAM[size:]]))
    return out[0].unionByName(out[1])


SCALE = 2_000_000


def scored(graph: Graph, cover_pct: int = 80) -> DataFrame:
    """Candidates that no longer one covers: (lang, w1..w4, a, l, r, score) by the lowest-scoring cut."""
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    rows = (_cuts(graph).groupBy("lang", *GRAM, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
            .select("lang", *GRAM, "a", "cut.l", "cut.r", "cut.score"))
    gone = _covered(graph, cover_pct)
    same = [rows[c].eqNullSafe(gone[c]) for c in GRAM[2:]]
    return rows.join(gone, [rows["lang"] == gone["lang"], rows["w1"] == gone["w1"], rows["w2"] == gone["w2"], *same], "left_anti")


def top_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", k: int = 2000,
                min_count: int = 30, cover_pct: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``k`` phrases of every language by
    score, then count, then the phrase's bytes."""
    graph = build(docs, text_col, lang_col, min_count)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    first = cut_lineage(scored(graph, cover_pct).withColumn("place", F.rank().over(best)).filter(F.col("place") <= k).drop("place"))
    rows = first
    for c in GRAM:
        rows = _spell(rows, graph.words, c)
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"s_{c}" for c in GRAM])).join(graph.totals, "lang")
    final = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = cut_lineage(rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
                      .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    drop_scratch(first)
    graph.drop()
    return out


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
runs AS (
  SELECT lang, size, w[i:i + size - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size)
  WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, g, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE size >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.size, c.g, c.f AS a, k, x.f AS l, y.f AS r,
         ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.size = k AND x.g = c.g[1:k]
  JOIN f y ON y.lang = c.lang AND y.size = c.size - k AND y.g = c.g[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
parts AS (
  SELECT lang, g[s:s + size2 - 1] AS g, max(f) AS over
  FROM (SELECT lang, g, f, size, size2, unnest(range(1, size - size2 + 2)) AS s
        FROM cand, (SELECT unnest([2, 3]) AS size2) WHERE size2 < size)
  GROUP BY ALL),
alive AS (
  SELECT c.* FROM lowest c LEFT JOIN parts p ON p.lang = c.lang AND p.g = c.g
  WHERE p.over IS NULL OR 100 * p.over < 80 * c.a),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM alive)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
