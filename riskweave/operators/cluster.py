"""Clustering: DBSCAN, K-Means, Lloyd step, elbow; Ward is in ``hierarchy``.

All inputs are (id, features array<double>) DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import blocks as B
from riskweave.operators.neighbors import collapse, components, least_code, spread_join, sq_dist, wide_join
from riskweave.session import cut_lineage, drop_scratch


def noise_label(dtype: T.DataType):
    return F.lit(-1).cast(dtype)


# D1 --------------------------------------------------------------------------------
def _celled(e2: float):
    """Blocks with their points in the order of cells, the boxes of the cells, and ``nw``: the rows within eps
    of each point in its own block."""
    import pandas as pd

    def one(row):
        X = B.matrix(row)
        order, first = B.cells(X, e2)
        X, w = X[order], np.asarray(row.w)[order]
        lo, hi = B.boxes(X, first) if len(first) else (X, X)
        return {"blk": row.blk, "grp": row.grp, "n": row.n, "ids": np.asarray(row.ids)[order], "vecs": B.packed(X), "centre": row.centre,
                "radius": row.radius, "w": w, "cell": first, "lo": lo.tobytes(), "hi": hi.tobytes(), "nw": B.near_matrix(X, X, e2) @ w}

    def celled(it):
        for pdf in it:
            for row in pdf.itertuples():
                yield pd.DataFrame([one(row)])
    return celled


class _Cells:
    """The cells of a row of ``_celled``."""

    def __init__(self, row):
        self.first, self.n = np.asarray(row.cell), len(row.ids)
        d = len(row.centre)
        self.lo, self.hi = np.frombuffer(row.lo).reshape(-1, d), np.frombuffer(row.hi).reshape(-1, d)
        self.of = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, self.n)))

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags, self.first)

    def near(self, other: _Cells, e2: float) -> np.ndarray:
        return ~(B.gap2(self.lo, self.hi, other.lo, other.hi) > e2)


def _meeting(cells: np.ndarray, x: _Cells, y: _Cells, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of x and y, out of those flagged, in cells that are paired."""
    return np.flatnonzero(px & cells.any(1)[x.of]), np.flatnonzero(py & cells.any(0)[y.of])


def _weights_beyond(e2: float, enough: int):
    """Per point of one block that has not ``enough`` rows within eps in its own block: those in the other block."""
    import pandas as pd

    def count(x, y):
        cx, cy = _Cells(x), _Cells(y)
        near = cx.near(cy, e2)
        out = [pd.DataFrame({"blk": np.zeros(0, np.int64), "pos": np.zeros(0, np.int32), "nw": np.zeros(0, np.int64)})]
        for a, b, ca, cb, cells in ((x, y, cx, cy, near), (y, x, cy, cx, near.T)):
            free = np.asarray(a.nw) < enough
            i, j = _meeting(cells & ca.any(free)[:, None], ca, cb, free, np.ones(cb.n, dtype=bool))
            if len(i) and len(j):
                nw = B.near_matrix(B.matrix(a)[i], B.matrix(b)[j], e2) @ np.asarray(b.w)[j]
                out.append(pd.DataFrame({"blk": a.blk, "pos": i[nw > 0], "nw": nw[nw > 0]}))
        return pd.concat(out)
    return count


def _summed(found):
    return found.groupby(["blk", "pos"], as_index=False, sort=False)["nw"].sum()


def _rooted(e2: float, enough: int):
    """Rows of ``_celled`` with ``core``, the ``root`` of every core point among those its block links to it, and the
    points that are not core (``free``) beside such roots (``beside``). ``more``: (pos, nw) of other blocks."""
    import pandas as pd

    def one(row):
        ids, nw = np.asarray(row.ids), np.array(row.nw)
        if row.more is not None and len(row.more):
            at = np.array([(m["pos"], m["nw"]) for m in row.more])
            nw[at[:, 0]] += at[:, 1]
        core, X = nw >= enough, B.matrix(row)
        near = B.near_matrix(X, X, e2)
        root = np.full(len(ids), -1)
        at = np.flatnonzero(core)
        root[at] = ids[at][B.forest(near[np.ix_(at, at)])[:len(at)]]
        free = np.flatnonzero(~core)
        i, j = np.nonzero(near[np.ix_(free, at)])
        pair = np.unique(np.stack([ids[free[i]], root[at[j]]], axis=1), axis=0)
        return {**{c: getattr(row, c) for c in ("blk", "ids", "vecs", "centre", "cell", "lo", "hi")}, "core": core, "root": root,
                "free": pair[:, 0], "beside": pair[:, 1]}

    def rooted(it):
        for pdf in it:
            for row in pdf.itertuples():
                yield pd.DataFrame([one(row)])
    return rooted


def _links(e2: float):
    """Links between the roots of two blocks, and the roots of each that lie next to points of the other
    that are not core."""
    import pandas as pd

    def link(x, y):
        kx, ky = _Cells(x), _Cells(y)
        near = kx.near(ky, e2)
        cx, cy = np.asarray(x.core, dtype=bool), np.asarray(y.core, dtype=bool)
        X, Y, rx, ry = B.matrix(x), B.matrix(y), np.asarray(x.root), np.asarray(y.root)
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "border": np.zeros(0, bool)})]
        live = near & (kx.any(cx)[:, None] & ky.any(cy)[None, :]) if cx.any() and cy.any() else np.zeros_like(near)
        if live.any():
            roots, code = np.unique(np.concatenate([rx, ry]), return_inverse=True)
            ax, ay, m = code[:len(rx)], code[len(rx):], len(roots)
            # one core point a cell stands for the cell: what such points join need not be looked at again
            ca, cb = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
            pa, pb = _one_of(cx, kx)[ca], _one_of(cy, ky)[cb]
            i, j = np.nonzero(B.near_matrix(X[pa], Y[pb], e2))
            pairs = [np.unique(ax[pa[i]] * m + ay[pb[j]])]
            least = least_code(*np.divmod(pairs[0], m), m)
            # the least and greatest label of a cell's core points; several labels are never settled
            one, two = (_label_range(least[c], core, k, m) for c, core, k in ((ax, cx, kx), (ay, cy, ky)))
            alike = (one[0] == one[1])[:, None] & (two[0] == two[1])[None, :] & (one[0][:, None] == two[0][None, :])
            i, j = _meeting(live & ~alike, kx, ky, cx, cy)
            if len(i) and len(j):
                a, b = np.nonzero(B.near_matrix(X[i], Y[j], e2) & (least[ax[i]][:, None] != least[ay[j]][None, :]))
                pairs.append(np.unique(ax[i[a]] * m + ay[j[b]]))
            a, b = np.divmod(np.concatenate(pairs), m)
            out.append(pd.DataFrame({"a": roots[a], "b": roots[b], "border": False}))
        for free, core, ka, kb, cells, P, Q, ids, root in ((~cx, cy, kx, ky, near, X, Y, x.ids, ry), (~cy, cx, ky, kx, near.T, Y, X, y.ids, rx)):
            if not free.any() or not core.any():
                continue
            i, j = _meeting(cells & (ka.any(free)[:, None] & kb.any(core)[None, :]), ka, kb, free, core)
            if len(i) and len(j):
                a, b = np.nonzero(B.near_matrix(P[i], Q[j], e2))
                pair = np.unique(np.stack([np.asarray(ids)[i[a]], root[j[b]]], axis=1), axis=0)
                out.append(pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1], "border": True}))
        return pd.concat(out)
    return link


def _one_of(flags: np.ndarray, cells: _Cells) -> np.ndarray:
    """The place of the first flagged point of every cell (of no meaning where it has none)."""
    at = np.minimum.reduceat(np.where(flags, np.arange(len(flags)), len(flags)), cells.first)
    return np.minimum(at, len(flags) - 1)


def _label_range(label: np.ndarray, flags: np.ndarray, cells: _Cells, top: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.minimum.reduceat(np.where(flags, label, top), cells.first), np.maximum.reduceat(np.where(flags, label, -1), cells.first))


def _joined_links(found):
    """The links of several pairs of blocks as one forest: a row per core point at most, and the border
    points next to each of its roots."""
    import pandas as pd
    border = found["border"].to_numpy(dtype=bool)
    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    ids, code = np.unique(np.concatenate([a[~border], b[~border]]), return_inverse=True)
    least = least_code(*code.reshape(2, -1), len(ids))
    far = np.flatnonzero(least != np.arange(len(ids)))
    out = pd.DataFrame({"a": ids[far], "b": ids[least[far]], "border": False})
    if not border.any():
        return out
    near, root = a[border], b[border].copy()
    at = np.searchsorted(ids, root)
    known = at < len(ids)
    known[known] = ids[at[known]] == root[known]
    root[known] = ids[least[at[known]]]
    pair = np.unique(np.stack([near, root], axis=1), axis=0)
    return pd.concat([out, pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1], "border": True})])


def dbscan(df: DataFrame, id_col: str, eps: float, min_samples: int, features: str = "features",
           by: str | None = None, rows: int = B.ROWS) -> DataFrame:
    """DBSCAN with exact semantics, distributed.

    1. identical vectors collapse to one weighted point (exact: they are
       within eps of each other and of the same neighbours);
    2. points lie in metric blocks, and in small cells inside a block. Every block counts the
       weight near its points: a point is core at ``min_samples`` rows or more, its own
       counted. Only points that have fewer in their own block look into the blocks whose
       balls come within eps, and there into the cells whose boxes do;
    3. core points that a block links take one root. Blocks within eps then link roots: a cell
       is looked at no further where its roots are joined already. Other points bring the
       roots of core points next to them. What a tile of blocks finds is joined
       before it leaves the task. No pair of points is ever written;
    4. clusters = connected components of the linked roots;
    5. a border point joins the smallest cluster label among its core
       neighbours (the reference's choice depended on scan order);
    6. cluster label = least id among the cluster's core points; noise = -1.
    ``by`` runs an independent DBSCAN per group value (Mapper cubes) in the
    same jobs: blocks never hold two groups, and only blocks of one group meet.
    Output: ([by,] id, cluster, is_core).
    """
    id_type = df.schema[id_col].dataType
    keys = [by] if by else []
    points, members = collapse(df, id_col, features, keys)
    blocks = B.pack(points, "pid", features, ["w"], by=by, rows=rows)
    e2 = float(eps) * float(eps)
    held = ("blk long, ids array<long>, vecs binary, centre array<double>, cell array<int>, lo binary, hi binary")
    celled = cut_lineage(blocks.select("blk", "grp", "n", "ids", "vecs", "centre", "radius", "w").mapInPandas(
        _celled(e2), f"{held}, grp {blocks.schema['grp'].dataType.simpleString()}, n int, radius double, w array<long>, nw array<long>"))
    drop_scratch(blocks)
    pairs = cut_lineage(B.near_blocks(celled, eps).filter("i <> j"))
    short = celled.filter(F.exists("nw", lambda v: v < min_samples)).select("blk", F.lit(True).alias("short"))
    asked = (wide_join(wide_join(pairs, short.toDF("i", "si"), "i", "left"), short.toDF("j", "sj"), "j", "left")
             .filter("si OR sj").select("grp", "i", "j"))
    sent = celled.drop("grp", "n", "radius")
    more = (B.visit(sent, asked, _weights_beyond(e2, min_samples), "blk long, pos int, nw long", merge=_summed)
            .groupBy("blk", "pos").agg(F.sum("nw").alias("nw")).groupBy("blk").agg(F.collect_list(F.struct("pos", "nw")).alias("more")))
    cored = cut_lineage(wide_join(sent.drop("w"), more, "blk", "left").mapInPandas(
        _rooted(e2, min_samples), f"{held}, core array<boolean>, root array<long>, free array<long>, beside array<long>"))
    drop_scratch(celled)
    found = cut_lineage(B.visit(cored.drop("free", "beside"), pairs, _links(e2), "a long, b long, border boolean", merge=_joined_links))
    flags = (cored.select(F.explode(F.arrays_zip("ids", "core", "root")).alias("p"))
             .select(F.col("p.ids").alias("pid"), F.col("p.core").alias("is_core"), F.col("p.root").alias("root")))
    cores = flags.filter("is_core")
    least = cut_lineage(wide_join(cores.select("pid", "root"), points.select("pid", "uid"), "pid").groupBy("root").agg(F.min("uid").alias("uid")))
    comp = components(least.select("root"), found.filter("NOT border"), "root", "a", "b")
    named = wide_join(comp, least, "root")
    label = named.groupBy("component").agg(F.min("uid").alias("label"))
    named = cut_lineage(spread_join(named.select("root", "component"), label, ["component"], "root").select("root", "label"))
    # a root may be near many border points, and hold most core points: its label is copied to SALTS keys
    beside = (cored.select(F.explode(F.arrays_zip("free", "beside")).alias("p")).select(F.col("p.free").alias("pid"), F.col("p.beside").alias("root"))
              .unionByName(found.filter("border").select(F.col("a").alias("pid"), F.col("b").alias("root"))))
    border = spread_join(beside, named, ["root"], "pid").groupBy("pid").agg(F.min("label").alias("label"))
    lab = (spread_join(cores, named, ["root"], "pid").select("pid", "is_core", "label")
           .unionByName(wide_join(flags.filter("NOT is_core").select("pid", "is_core"), border, "pid", "left"))
           .select("pid", "is_core", F.coalesce("label", noise_label(id_type)).alias("cluster")))
    out = cut_lineage(spread_join(members, lab, ["pid"], id_col).select(*keys, id_col, "cluster", "is_core"))
    drop_scratch(points, pairs, cored, found, least, named, comp)
    return out


# K2 / M4 ---------------------------------------------------------------------------
def nearest_centre(features: str, centres: np.ndarray):
    """Index of the nearest centre (ties -> lowest index), as a column expression."""
    # spell the distances out only while the expression stays small enough to
    # compile quickly; beyond that the higher-order form is cheaper overall
    dim = len(centres[0]) if len(centres) * len(centres[0]) <= 64 else None
    d = F.array(*[sq_dist(F.col(features), F.array(*[F.lit(float(x)) for x in c]), dim) for c in centres])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def centroids(df: DataFrame, group: str, features: str = "features") -> DataFrame:
    """Per-group mean vector (posexplode + avg), as (group, n, centroid array)."""
    ex = df.select(group, F.posexplode(features).alias("pos", "x"))
    per_dim = ex.groupBy(group, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return (per_dim.groupBy(group).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid")))


def lloyd_step(df: DataFrame, centres: np.ndarray, features: str = "features") -> DataFrame:
    """K2: assign to nearest centre, recompute means -> (cluster, n, centroid)."""
    a = df.select(nearest_centre(features, centres).alias("cluster"), features)
    return centroids(a, "cluster", features)


def wcss(df: DataFrame, group: str, features: str = "features") -> DataFrame:
    """M4: sum of squared distances to the own group's centroid (one row), from one aggregate
    per group; rows never meet centroids."""
    from riskweave.operators.quality import group_moments
    return group_moments(df, [group], features).agg(F.sum("ss").alias("wcss"))


# K1 / K3 / K4 ----------------------------------------------------------------------
PARTITION_ROWS = 65_536      # rows of one K-Means partition
MAX_STARTS = 16              # starts under way at once: each keeps its centres on the driver


def _kmeans_rows(df: DataFrame, id_col: str, features: str) -> tuple[DataFrame, DataFrame]:
    """(rows as vectors, the same rows dealt and sorted for the starts, kept in memory)."""
    from pyspark.ml.functions import array_to_vector
    rows = cut_lineage(df.select(id_col, array_to_vector(F.col(features)).alias("_v")))
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    data = rows.repartition(parts, id_col).sortWithinPartitions(id_col).persist()
    data.count()
    return rows, data


def _kmeans_starts(data: DataFrame, starts: Sequence[tuple[int, int]], max_iter: int, tol: float,
                   parallelism: int | None):
    """(model, training cost) of every (k, seed), ``parallelism`` jobs at a time (by default one a core, as
    a start over few partitions leaves the other cores idle)."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans

    def start(k_seed):
        model = KMeans(k=k_seed[0], seed=k_seed[1], maxIter=max_iter, tol=tol, featuresCol="_v",
                       initMode="k-means||").fit(data)
        return model, model.summary.trainingCost

    jobs = parallelism or max(4, data.sparkSession.sparkContext.defaultParallelism)
    with ThreadPool(max(1, min(jobs, MAX_STARTS, len(starts)))) as pool:
        return pool.map(inheritable_thread_target(data.sparkSession)(start), starts, chunksize=1)


def kmeans(df: DataFrame, id_col: str, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300,
           features: str = "features", tol: float = 1e-4, parallelism: int | None = None
           ) -> tuple[DataFrame, np.ndarray, float]:
    """K1: MLlib k-means|| restarted ``n_init`` times, best training cost kept.

    k-means|| draws per partition, so rows are dealt by id hash into
    partitions of about ``PARTITION_ROWS`` rows, sorted by id: neither the
    caller's partitioning nor the number of cores changes the answer. Starts
    are independent jobs, ``parallelism`` of them at a time (one a core by default). Clusters are
    relabelled by sorted centre order; equal costs keep the earliest start.
    Returns (assignments (id, cluster), centres k x d, wcss).
    """
    rows, data = _kmeans_rows(df, id_col, features)
    found = _kmeans_starts(data, [(k, seed + i) for i in range(n_init)], max_iter, tol, parallelism)
    model, cost = min(found, key=lambda mc: mc[1])
    data.unpersist()
    centres = np.array(model.clusterCenters())
    order = sorted(range(len(centres)), key=lambda j: tuple(np.round(centres[j], 9)))
    names = F.array(*[F.lit(order.index(j)) for j in range(len(order))])
    assign = model.transform(rows).select(id_col, names[F.col("prediction")].alias("cluster"))
    return assign, centres[order], float(cost)


def elbow(df: DataFrame, id_col: str, k_values: Sequence[int], seed: int = 42, n_init: int = 3,
          features: str = "features", max_iter: int = 300, tol: float = 1e-4, parallelism: int | None = None) -> DataFrame:
    """K3: WCSS per k: the best of ``n_init`` starts each, all on one copy of the input."""
    spark = df.sparkSession
    ks = [int(k) for k in k_values]
    _, data = _kmeans_rows(df, id_col, features)
    found = _kmeans_starts(data, [(k, seed + i) for k in ks for i in range(n_init)], max_iter, tol, parallelism)
    data.unpersist()
    rows = [(k, float(min(cost for _, cost in found[j * n_init:(j + 1) * n_init]))) for j, k in enumerate(ks)]
    return spark.createDataFrame(rows, "k int, wcss double")


def elbow_choice(wcss_df: DataFrame, k_col: str = "k", w_col: str = "wcss") -> DataFrame:
    """K4: relative drop (W_k - W_{k+1}) / W_k per k, flag the largest drop.

    The table has one row per tried k (tens of rows), so the global window
    is over a bounded input.
    """
    w = Window.orderBy(k_col)
    d = wcss_df.withColumn("drop", (F.col(w_col) - F.lead(w_col).over(w)) / F.col(w_col))
    best = d.filter(F.col("drop").isNotNull()).orderBy(F.col("drop").desc(), F.col(k_col)).limit(1) \
        .select(F.col(k_col).alias("_best"))
    return d.join(best, how="left", on=F.col(k_col) == F.col("_best")) \
        .select(k_col, w_col, "drop", F.col("_best").isNotNull().alias("is_elbow"))
