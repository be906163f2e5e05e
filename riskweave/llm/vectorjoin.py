"""Exact cosine threshold join of embeddings by cover trees, within equal labels.

Vectors are scaled to unit length, so cosine >= c is distance <= sqrt(2 - 2c).
Equal vectors collapse to one weighted point first.

Top of the tree: labels with many vectors get pivots (a bounded sample, farthest
first); each point goes to its nearest pivot's cell, whose exact covering radius
is then measured. Two cells meet only if their pivots are no farther apart than
both radii and the threshold allow. Cells are dealt into blocks of about
``block`` points by a hash, and every pair of blocks of two cells that meet is
one task of at most two blocks, however many points a label or a cell holds.

Below: in a task each block becomes a cover tree, nested levels of centres whose
covering radii halve. Both trees are descended together: pairs of nodes too far
apart for their radii are dropped, pairs that must lie within the threshold are
linked as a whole, and what remains reaches the leaves, where the cosine is
computed in double precision. A task returns, per point, how many vectors it
links to and one root of its local component, never the pairs.

The pivots only route; every vector is compared, so links are exact.

Defined cases: a null vector, one that is zero or holds a null or non-finite
component, and a vector with a null label link with nothing. Vectors of unequal
length do not compare. Rows with one id are separate vectors of one component.
A null id is counted as a link but never names a component that has another id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbits as tb
from riskweave.operators.neighbors import connected_components
from riskweave.session import cut_lineage, drop_scratch

BLOCK = 1024                 # points of one block
GROUPS = 256                 # labels that get pivots: the largest ones
PIVOTS = 16                  # pivots of a label
SAMPLE = 64                  # rows of a label from which pivots are chosen
LEAF_LEVELS = 5              # levels of a tree below its root
SLACK = 1e-7                 # distance margin within which a bound decides nothing


def unit_rows(column: pa.Array) -> tuple[list, np.ndarray]:
    """Unit vectors as bytes (null where a vector can't link) and their lengths."""
    out, dims = [], np.zeros(len(column), dtype=np.int32)
    for i, v in enumerate(column):
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = np.asarray(v.values, dtype=np.float64)
            top = np.abs(x).max() if np.isfinite(x).all() else 0.0
            x = x / top if top > 0 else None                  # no overflow in the norm
        if x is None:
            out.append(None)
            continue
        dims[i] = len(x)
        out.append((x / np.sqrt(x @ x)).tobytes())
    return out, dims


class Tree:
    """Nested levels of centres over unit rows ``x``; the last level holds every point."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        n = len(x)
        dist = np.sqrt(np.maximum(2.0 - 2.0 * (x @ x.T), 0.0))
        np.fill_diagonal(dist, 0.0)                             # rounding must not set a point apart from itself
        radius = float(dist[0].max()) if n else 0.0
        levels, centres = [np.zeros(1, dtype=np.int64)], [0]
        for _ in range(LEAF_LEVELS):
            radius /= 2
            near = dist[centres].min(axis=0)
            while True:                                        # add uncovered points as centres, in order
                far = np.flatnonzero(near > radius)
                if not len(far):
                    break
                centres.append(int(far[0]))
                near = np.minimum(near, dist[far[0]])
            levels.append(np.array(centres))
            if len(centres) > n // 2:
                break
        levels.append(np.arange(n))
        self.x, self.levels, self.parent = x, levels, [np.zeros(1, dtype=np.int64)]
        for up, down in zip(levels, levels[1:]):
            self.parent.append(np.argmin(dist[np.ix_(up, down)], axis=0))
        # exact covering radius and weight of each node, from the points below it
        above = np.arange(n)
        self.radius, self.weight, self.above = [None] * len(levels), [None] * len(levels), [None] * len(levels)
        for k in range(len(levels) - 1, -1, -1):
            if k < len(levels) - 1:
                above = self.parent[k + 1][above]
            r = np.zeros(len(levels[k]))
            np.maximum.at(r, above, dist[levels[k][above], np.arange(n)])
            self.radius[k], self.above[k] = r, above
            self.weight[k] = np.bincount(above, weights=weight, minlength=len(levels[k]))


def dual_links(a: Tree, b: Tree, least_cos: float, same: bool):
    """(links of a's points, links of b's points, pairs (i, j) that connect what is linked)."""
    limit = np.sqrt(max(0.0, 2.0 - 2.0 * least_cos))
    na, nb = len(a.x), len(b.x)
    count_a, count_b = np.zeros(na), np.zeros(nb)
    joined = []
    depth = max(len(a.levels), len(b.levels))
    open_pairs = np.ones((1, 1), dtype=bool)
    pa_, pb_ = 0, 0
    for k in range(depth):
        ka, kb = min(k, len(a.levels) - 1), min(k, len(b.levels) - 1)
        if k:
            rows = a.parent[ka] if ka != pa_ else np.arange(len(a.levels[ka]))
            cols = b.parent[kb] if kb != pb_ else np.arange(len(b.levels[kb]))
            open_pairs = open_pairs[np.ix_(rows, cols)]
        pa_, pb_ = ka, kb
        if not open_pairs.any():
            break
        cos = a.x[a.levels[ka]] @ b.x[b.levels[kb]].T
        if k == depth - 1:
            i, j = np.nonzero(open_pairs & (cos >= least_cos))
            if same:
                i, j = i[i != j], j[i != j]
            count_a += np.bincount(i, weights=b.weight[-1][j], minlength=na)
            count_b += np.bincount(j, weights=a.weight[-1][i], minlength=nb)
            joined.append((i, j))
            break
        gap = np.sqrt(np.maximum(2.0 - 2.0 * cos, 0.0))
        reach = a.radius[ka][:, None] + b.radius[kb][None, :]
        open_pairs &= gap - reach <= limit + SLACK
        sure = open_pairs & (gap + reach <= limit - SLACK)
        if sure.any():                                         # every point below one links to every point below the other
            i, j = np.nonzero(sure)
            per_a = np.bincount(i, weights=b.weight[kb][j], minlength=len(a.levels[ka]))
            per_b = np.bincount(j, weights=a.weight[ka][i], minlength=len(b.levels[kb]))
            count_a += per_a[a.above[ka]]
            count_b += per_b[b.above[kb]]
            if same:                                           # but not to itself
                own = sure[a.above[ka], b.above[kb]]
                count_a -= own * a.weight[-1]
                count_b -= own * b.weight[-1]
            joined.append((a.levels[ka][i], b.levels[kb][j]))
            pts = np.flatnonzero(sure.any(axis=1)[a.above[ka]])    # all points below with one centre opposite
            joined.append((pts, b.levels[kb][np.argmax(sure, axis=1)][a.above[ka][pts]]))
            pts = np.flatnonzero(sure.any(axis=0)[b.above[kb]])
            joined.append((a.levels[ka][np.argmax(sure, axis=0)][b.above[kb][pts]], pts))
            open_pairs &= ~sure
    if joined:
        i, j = (np.concatenate(c) for c in zip(*joined))
    else:
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return count_a, count_b, i, j


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of each component of 0..n-1."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not (new[new] == new).all():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
        live = root[i] != root[j]
        i, j = i[live], j[live]
    return root


def _points(vectors: DataFrame) -> DataFrame:
    """id, label, dim, vec (unit vector as bytes, null if it can't link), h1, h2."""
    def run(batches):
        for b in batches:
            vec, dim = unit_rows(b.column(2))
            col = pa.array(vec, pa.binary())
            h = [np.zeros(len(vec), np.int64)] * 2
            if len(vec):
                parts = [[], []]
                for _, buf, offs in tb.chunks(col):
                    for seed in (0, 1):
                        parts[seed].append(tb.as_signed(tb.range_hashes(buf, offs[:-1], offs[1:], 41 + seed)))
                h = [np.concatenate(p) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dim), col, pa.array(h[0]), pa.array(h[1])],
                                             names=["id", "label", "dim", "vec", "h1", "h2"])

    kinds = vectors.schema
    return vectors.mapInArrow(run, T.StructType([
        kinds["id"], kinds["label"], T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType()),
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def _pivots(points: DataFrame, sizes: DataFrame) -> dict:
    """(label, dim) -> pivot matrix, for at most GROUPS labels: those of more than one block, largest first."""
    big = sizes.filter(F.col("n") > BLOCK).orderBy(F.col("n").desc(), "label", "dim").limit(GROUPS).collect()
    out = {}
    if not big:
        return out
    draw = F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(1_000_000_000))
    keep = F.lit(False)
    for r in big:
        keep = keep | ((F.col("label") == F.lit(r["label"])) & (F.col("dim") == r["dim"])
                       & (draw < int(1_000_000_000 * min(1.0, SAMPLE / r["n"])) + 1))
    groups: dict = {}
    for r in points.filter(keep).select("label", "dim", "vec", "h1", "h2").orderBy("h1", "h2").collect():
        groups.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["vec"]))
    for key, rows in groups.items():
        x = np.stack(rows)
        chosen, near = [0], np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
            if near.max() <= 0.1:
                break
            chosen.append(int(np.argmax(near)))
        out[key] = x[chosen]
    return out


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 least_cos: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    src = tb.bound_batches(vectors).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    rows = cut_lineage(_points(src))
    live = rows.filter(F.col("vec").isNotNull() & F.col("label").isNotNull())
    key = ["label", "dim", "h1", "h2"]
    # equal vectors are one point; its node number is its hash, its name the least id
    points = cut_lineage(live.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("vec").alias("vec"))
                             .withColumn("node", F.xxhash64(*key)))
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("n"))
    pivots = spark.sparkContext.broadcast(_pivots(points, sizes))          # at most GROUPS * PIVOTS vectors

    def place(batches):
        for b in batches:
            lab, dim, vec = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()
            cell, far = np.zeros(len(lab), dtype=np.int32), np.full(len(lab), 2.0)
            where: dict = {}
            for i, k in enumerate(zip(lab, dim)):
                where.setdefault(k, []).append(i)
            for k, at in where.items():
                p = pivots.value.get(k)
                if p is not None:
                    d = np.sqrt(np.maximum(2.0 - 2.0 * np.stack([np.frombuffer(vec[i]) for i in at]) @ p.T, 0.0))
                    cell[at], far[at] = np.argmin(d, axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(cell), pa.array(far)], names=names)

    keep = points.select("label", "dim", "node", "w", "vec")
    schema = T.StructType(keep.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    names = schema.fieldNames()
    placed = cut_lineage(keep.mapInArrow(place, schema))
    cells = cut_lineage(placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
                              .withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")))
    # which cells meet: pivoted labels only have more than one, at most GROUPS * PIVOTS rows in all
    known = pivots.value
    info: dict = {}
    many = cells.join(cells.filter("cell > 0").select("label", "dim").distinct(), ["label", "dim"], "left_semi")
    for r in many.collect():
        info.setdefault((r["label"], r["dim"]), []).append((r["cell"], r["blocks"], r["radius"]))
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * least_cos)))
    meets = []
    for (lab, dim), found in info.items():
        p = known[lab, dim]
        for c, n_c, r_c in found:
            for e, n_e, r_e in found:
                gap = float(np.sqrt(max(0.0, 2.0 - 2.0 * p[c] @ p[e])))
                if c == e or gap - r_c - r_e <= limit + SLACK:
                    meets.append((lab, dim, c, n_c, e, n_e))
    pairs_schema = T.StructType([placed.schema["label"], placed.schema["dim"]] + [
        T.StructField(c, T.IntegerType()) for c in ("cell", "own", "other", "others")])
    across = spark.createDataFrame(meets, pairs_schema)                     # bounded by GROUPS * PIVOTS^2
    alone = (cells.join(cells.filter("cell > 0").select("label", "dim").distinct(), ["label", "dim"], "left_anti")
                  .select("label", "dim", "cell", F.col("blocks").alias("own"), F.col("cell").alias("other"), F.col("blocks").alias("others")))
    routes = cut_lineage(across.unionByName(alone))
    sent = (placed.drop("far").join(routes, ["label", "dim", "cell"])
                  .withColumn("own", F.pmod(F.col("node"), F.col("own")).cast("int"))
                  .withColumn("opposite", F.explode(F.sequence(F.lit(0), F.col("others") - 1))))
    # each unordered pair of blocks once; both sides name it alike
    me, you = F.struct("cell", "own"), F.struct(F.col("other").alias("cell"), F.col("opposite").alias("own"))
    sent = sent.select("label", "dim", F.least(me, you).alias("lo"), F.greatest(me, you).alias("hi"),
                       (me <= you).alias("left"), "node", "w", "vec")

    def compare(pdf):
        import pandas as pd
        left = pdf["left"].to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        same = lo == hi
        a, b = pdf[left], (pdf[left] if same else pdf[~left])
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype({"node": "int64", "links": "int64", "root": "int64"})
        ta, tb_ = (Tree(np.stack([np.frombuffer(v) for v in s["vec"]]), s["w"].to_numpy(dtype=float)) for s in (a, b))
        ca, cb, i, j = dual_links(ta, tb_, least_cos, same)
        if same:
            root = local_roots(len(a), i, j)
            node, links = a["node"].to_numpy(), ca
        else:
            root = local_roots(len(a) + len(b), i, j + len(a))
            node, links = np.r_[a["node"].to_numpy(), b["node"].to_numpy()], np.r_[ca, cb]
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": np.rint(links[some]).astype(np.int64), "root": node[root[some]]})

    found = cut_lineage(sent.groupBy("label", "dim", "lo", "hi").applyInPandas(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(points.select(F.col("node").alias("id")), found.filter("node != root"), src="node", dst="root")
    named = cut_lineage(points.select(*key, "node", "rep", "w").join(comps.withColumnRenamed("id", "node"), "node")
                              .join(links, "node", "left"))
    least = cut_lineage(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    about = cut_lineage(named.join(least, "component").select(
        *key, "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    linked = live.join(about, key).select(F.col("id").alias(id_col), "n_links", "component_id")
    rest = rows.filter(F.col("vec").isNull() | F.col("label").isNull()).select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    drop_scratch(placed, cells, routes, found, named, least)
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
