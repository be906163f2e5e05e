"""Similarity join, connected components, nearest labelled point.

eps_join
    Exact all-pairs-within-eps, by one of two strategies with the same rows. The grid:
    points are projected on ``m`` orthonormal principal axes; projection never
    lengthens a distance, so two points within eps fall in grid cells (side
    eps) that differ by at most one step on every projected axis. Each point
    probes its 3^m neighbour cells, the probe side equi-joins the home side
    on the cell, and the exact squared distance filters the candidates. A hot cell is
    split into buckets. Or metric blocks, see ``operators.blocks``. Identical vectors
    should be collapsed to weighted points first (``collapse``; ``dbscan`` does).

connected_components
    Randomised contraction: every vertex with edges picks the first of its
    closed neighbourhood in a random order drawn per round, edges are
    rewritten to the picks and loops dropped. The edge table shrinks by a
    constant factor per round whatever the diameter, and the loop runs until
    no edge is left. Each round's tables lie in the shared checkpoint folder,
    so a lost executor recomputes one round, and are deleted after use.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut_lineage, drop_scratch


# costs of the two strategies of eps_join, in nanoseconds: measured on one machine, they only choose
GRID_NS, GRID_NS_PER_DIM, BLOCK_NS_PER_DIM, PACK_NS = 150, 100, 4, 20_000
EXPLICIT_MAX_DIM = 16  # above this a spelled-out sum makes methods too large for the JIT


def dot(vec: Column, weights: Sequence[float]) -> Column:
    """Projection on a fixed axis. Low dimensions are spelled out element by
    element (compiled by whole-stage codegen); high ones use ``aggregate``."""
    if len(weights) > EXPLICIT_MAX_DIM:
        w = F.array(*[F.lit(float(x)) for x in weights])
        return F.aggregate(F.zip_with(vec, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    terms = [vec[i] * F.lit(float(w)) for i, w in enumerate(weights)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def sq_dist(a: Column, b: Column, d: int | None = None) -> Column:
    """Squared Euclidean distance of two equal-length arrays, summed left to right.

    With a known, small dimension ``d`` the sum is spelled out element by
    element, which whole-stage codegen compiles to straight-line code; in
    high dimensions (or unknown ``d``) a higher-order ``aggregate`` over
    ``zip_with`` is used, which keeps generated methods small enough to JIT.
    """
    if d is None or d > EXPLICIT_MAX_DIM:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    out = None
    for i in range(d):
        t = (a[i] - b[i]) * (a[i] - b[i])
        out = t if out is None else out + t
    return out


def vector_dim(df: DataFrame, features: str = "features") -> int:
    first = df.select(F.size(features)).first()
    return int(first[0]) if first is not None else 0


def principal_axes(df: DataFrame, features: str = "features", k: int = 2) -> np.ndarray:
    """k orthonormal principal axes (k x d) from a distributed covariance (MLlib PCA).

    Any orthonormal axes keep the grid exact (projection is contractive);
    principal ones prune best. Degenerate input (one row, zero variance)
    falls back to the first k coordinate axes.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    some = df.select(features).limit(2).collect()
    d = len(some[0][0]) if some else 1
    k = max(1, min(k, d))
    if len(some) < 2:  # a covariance needs two rows
        return np.eye(d)[:k]
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(F.col(features)).alias("_v")))
    axes = np.array(model.pc.toArray().T)
    return axes if np.all(np.isfinite(axes)) else np.eye(d)[:k]


def with_cells(df: DataFrame, axes: np.ndarray, eps: float, features: str = "features") -> DataFrame:
    cells = [F.floor(dot(F.col(features), a) / F.lit(float(eps))).cast("long") for a in axes]
    return df.withColumn("_cell", F.array(*cells))


def grid_candidates(cells: DataFrame, n_col: str, keys: Sequence[str], m: int) -> int:
    """Candidates of the grid join: per cell, its points times those of the 3^m cells around it."""
    around = F.explode(F.transform(_offsets(m), lambda off: F.zip_with(F.col("_cell"), off, lambda x, y: x + y)))
    other = cells.select(*keys, around.alias("_to"), F.col(n_col).alias("_a"))
    own = cells.select(*keys, F.col("_cell").alias("_to"), F.col(n_col).alias("_b"))
    return int(other.join(own, [*keys, "_to"]).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0)


def _offsets(m: int) -> Column:
    return F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=m)])


def eps_join(df: DataFrame, id_col: str, eps: float, features: str = "features", axes: int = 2,
             carry: Sequence[str] = (), axes_matrix: np.ndarray | None = None, by: str | None = None,
             max_cell: int = 512, strategy: str = "auto") -> DataFrame:
    """All pairs (src < dst) with Euclidean distance <= eps (inclusive).

    ``by`` restricts pairs to equal values of a group column (e.g. the
    Mapper cube), which becomes part of the equi-join key: every group is
    joined in the same distributed pass.

    ``grid`` joins neighbouring cells of a grid on principal axes. ``blocks``
    compares metric blocks (``operators.blocks``), which prune better where two
    axes say little, as in many dimensions. ``auto`` counts the candidates of
    both from cell sizes and block summaries and takes the cheaper; both give
    the same pairs. Blocks need an integer or string id.

    Hot cells of the grid are salted: cell sizes come from one partial aggregate; a cell
    with more than ``max_cell`` points is split into ceil(size / max_cell)
    buckets by a hash of the id on the target side, and each probe into that
    cell is replicated once per bucket. A cell holding a third of all points
    therefore spreads over many tasks instead of one, and no pair is lost
    (every target row sits in exactly one bucket, every probe visits all).
    Output: src, dst, dist, plus ``src_<c>`` / ``dst_<c>`` for each carried column.
    """
    from riskweave.operators import blocks as B
    carry = list(dict.fromkeys([*carry, *([by] if by is not None else [])]))
    pts = df.select(id_col, features, *carry)
    simple = df.schema[id_col].dataType.simpleString() in ("bigint", "int", "string")
    if strategy == "blocks":
        return B.eps_pairs(B.pack(pts, id_col, features, carry, by=by), eps, carry)
    A = principal_axes(pts, features, axes) if axes_matrix is None else axes_matrix
    if strategy == "auto" and simple:
        dim, keys = A.shape[1], [by] if by is not None else []
        cells = cut_lineage(with_cells(pts, A, eps, features).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")))
        work = grid_candidates(cells, "_n", keys, len(A)) * (GRID_NS if dim <= EXPLICIT_MAX_DIM else GRID_NS_PER_DIM * dim)
        points = cells.agg(F.sum("_n")).first()[0] or 0
        drop_scratch(cells)
        if work > PACK_NS * points:
            blocks = B.pack(pts, id_col, features, carry, by=by)
            n = blocks.select("blk", "n")
            pairs = (B.near_blocks(blocks, eps).join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
                     .agg(F.sum(F.col("ni").cast("long") * F.col("nj"))).first()[0] or 0)
            if BLOCK_NS_PER_DIM * dim * pairs < work:
                return B.eps_pairs(blocks, eps, carry)
            drop_scratch(blocks)
    home = with_cells(pts, A, eps, features)
    key = ["_cell"] + ([by] if by is not None else [])
    # buckets per cell (one row per non-empty cell; AQE broadcasts it when small)
    sizes = (home.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
                 .select(*key, F.ceil(F.col("_n") / F.lit(max_cell)).cast("int").alias("_nb")))
    home = home.join(sizes, key)
    m = len(A)
    offsets = _offsets(m)
    probe = home.select(
        F.col(id_col).alias("src"), F.col(features).alias("_fa"),
        *[F.col(c).alias(f"src_{c}") for c in carry],
        F.explode(F.transform(offsets, lambda off: F.zip_with(F.col("_cell"), off, lambda x, y: x + y)))
         .alias("_pcell"))
    psizes = sizes.select(F.col("_cell").alias("_pcell"), *([F.col(by).alias(f"src_{by}")] if by else []),
                          F.col("_nb").alias("_pnb"))
    probe = (probe.join(psizes, ["_pcell"] + ([f"src_{by}"] if by else []))
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_pnb") - 1))).drop("_pnb"))
    target = home.select(F.col(id_col).alias("dst"), F.col(features).alias("_fb"),
                         *[F.col(c).alias(f"dst_{c}") for c in carry], F.col("_cell"),
                         F.pmod(F.xxhash64(F.col(id_col)), F.col("_nb")).cast("int").alias("_tsalt"))
    cond = ((probe["_pcell"] == target["_cell"]) & (probe["_salt"] == target["_tsalt"])
            & (probe["src"] < target["dst"]))
    if by is not None:
        cond = cond & (probe[f"src_{by}"] == target[f"dst_{by}"])
    cand = probe.join(target, cond)
    d2 = sq_dist(F.col("_fa"), F.col("_fb"), A.shape[1])
    return (cand.withColumn("_d2", d2).filter(F.col("_d2") <= F.lit(float(eps) * float(eps)))
                .select("src", "dst", F.sqrt("_d2").alias("dist"),
                        *[f"src_{c}" for c in carry], *[f"dst_{c}" for c in carry]))


def both_directions(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return (edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
                 .unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))))


def connected_components(vertices: DataFrame, edges: DataFrame, vertex: str = "id", src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """(vertex, component) with component = least vertex id of its component.

    Randomised contraction. In each round every vertex that still has edges
    picks, from itself and its neighbours, the one that comes first in an
    order drawn anew for the round (a hash of round and id), the edges are
    rewritten to the picked vertices, and loops and repeats are dropped. A
    vertex with an edge survives only if some vertex picks it, so the graph
    shrinks by a constant factor per round whatever its diameter: a path of
    n vertices takes about log2(n) rounds. The loop ends when no edge is
    left; there is no round limit. The per-round maps are then composed from
    the last to the first, and each component takes its least id.

    Before the first round every run of ``SMALL_GRAPH`` edges of a partition is replaced by stars
    over its own components, in place, together with the stars of the runs before as long as these
    are few: edges that lie together, or repeat, are contracted without a shuffle.

    A hub with very many edges costs one row per map task in the partial
    aggregate; the joins that rewrite edges shuffle written tables on both
    sides (a round's table may hold every vertex, so none is broadcast), and AQE
    can split a hub's rows. Rows with a null end and loops are
    ignored; every vertex of ``vertices`` comes back once.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a") != F.col("b"))
    if edges.schema[src].dataType.simpleString() in ("bigint", "int", "string") and edges.schema[src].dataType == edges.schema[dst].dataType:
        e = cut_lineage(_local_stars(e))
    else:
        e = cut_lineage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        rnd = F.lit(len(maps))
        near = both_directions(e, "a", "b")
        pick = (near.groupBy("a").agg(F.min(F.struct(F.xxhash64(rnd, "b").alias("h"), F.col("b").alias("v"))).alias("m"))
                    .select(F.col("a").alias("v"),
                            F.least("m", F.struct(F.xxhash64(rnd, "a").alias("h"), F.col("a").alias("v")))["v"].alias("to")))
        pick = cut_lineage(pick)
        maps.append(pick)
        left = wide_join(e, pick.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        both = wide_join(left, pick.select(F.col("v").alias("b"), F.col("to").alias("y")), "b").select("x", "y")
        shrunk = cut_lineage(both.filter(F.col("x") != F.col("y"))
                                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop_scratch(e)
        e = shrunk
    verts = vertices.select(F.col(vertex).alias("v")).distinct()
    if not maps:
        return verts.select(F.col("v").alias(vertex), F.col("v").alias("component"))
    roots = maps[-1]
    for m in reversed(maps[:-1]):
        later = roots.select(F.col("v").alias("to"), F.col("to").alias("root"))
        roots = wide_join(m, later, "to", "left").select("v", F.coalesce("root", "to").alias("to"))
    roots = cut_lineage(roots)
    least = cut_lineage(roots.groupBy("to").agg(F.min("v").alias("component")))
    named = wide_join(roots, least, "to").select("v", "component")
    out = cut_lineage(wide_join(verts, named, "v", "left")
                           .select(F.col("v").alias(vertex), F.coalesce("component", "v").alias("component")))
    drop_scratch(e, roots, least, *maps)
    return out


SALTS = 16


def spread_join(rows: DataFrame, one: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to a table of at most one row per key. The rows of a key are spread over
    ``salts`` keys by a hash of column ``by`` and ``one`` is copied as often, so a key that a
    third of all rows share is no single task."""
    copies = one.withColumn("_salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return wide_join(salted, copies, [*on, "_salt"], how).drop("_salt")


def wide_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` with both sides shuffled, never broadcast: for tables that grow with
    the input. Spark judges a written table by its compressed size, and repeated values are many
    times larger in memory, so a table of every row would pass through the driver."""
    return left.join(right.hint("merge"), on, how)


def collapse(df: DataFrame, id_col: str, features: str = "features", keys: Sequence[str] = ()
             ) -> tuple[DataFrame, DataFrame]:
    """(points, members): one written row per distinct vector (``uid`` its least id, ``w`` its
    rows, ``pid`` a number), and the point of every row."""
    pts = df.select(*keys, id_col, features)
    points = cut_lineage(pts.groupBy(*keys, features).agg(F.min(id_col).alias("uid"), F.count(F.lit(1)).alias("w"))
                            .withColumn("pid", F.monotonically_increasing_id()))
    # a vector of one row is that row's; only shared vectors are copied to meet their rows
    known = points.dropna(subset=[*keys, features])
    alone = known.filter("w = 1").select(*keys, F.col("uid").alias(id_col), "uid", "pid")
    shared = known.filter("w > 1").select(*keys, features, "uid", "pid")
    members = spread_join(pts, shared, [*keys, features], id_col)
    return points, alone.unionByName(members.select(*keys, id_col, "uid", "pid"))


SMALL_GRAPH = 1 << 17      # edges that one task may hold


def least_code(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of the component of each of n nodes, with an edge from every a to its b."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        np.minimum.at(after, least[a], low)
        np.minimum.at(after, least[b], low)
        after = after[after]
        if np.array_equal(after, least):
            return least
        least = after


def _local_stars(e: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of ``e``: every run of about ``SMALL_GRAPH`` rows of a partition becomes
    a star per component, around the vertex that is first in the order of the first round. Stars of
    few rows meet the rows that follow, so many edges of few vertices leave few rows."""
    import pandas as pd
    kind, most = e.schema["a"].dataType.simpleString(), SMALL_GRAPH

    def star(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, first, code = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_index=True, return_inverse=True)
        place_of = np.concatenate([pdf["ha"], pdf["hb"]])[first]
        order = np.argsort(place_of, kind="stable")      # ids are sorted: ties by id
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        least = least_code(*place[code].reshape(2, -1), len(ids))
        named, far, place_of = ids[order], np.flatnonzero(least != np.arange(len(ids))), place_of[order]
        return pd.DataFrame({"a": named[least[far]], "b": named[far], "ha": place_of[least[far]], "hb": place_of[far]})

    def stars(it):
        held, n = [], 0
        for pdf in it:
            held.append(pdf)
            n += len(pdf)
            if n >= most:
                held = [star(pd.concat(held))]
                n = len(held[0])
                if 2 * n > most:
                    yield held[0][["a", "b"]]
                    held, n = [], 0
        if n:
            yield star(pd.concat(held))[["a", "b"]]

    rnd = F.lit(0)
    return e.select("a", "b", F.xxhash64(rnd, "a").alias("ha"), F.xxhash64(rnd, "b").alias("hb")).mapInPandas(stars, f"a {kind}, b {kind}")


def components(vertices: DataFrame, edges: DataFrame, vertex: str = "id", src: str = "src", dst: str = "dst",
               small: int = SMALL_GRAPH) -> DataFrame:
    """``connected_components``, without its rounds where the graph has at most ``small`` edges: then
    one task labels them (the bound is on rows, so no larger graph ever meets in a task). The
    labels are the same. ``edges`` is counted first, so pass a written table."""
    import pandas as pd
    simple = edges.schema[src].dataType.simpleString()
    if simple not in ("bigint", "int", "string") or edges.limit(small + 1).count() > small:
        return connected_components(vertices, edges, vertex, src, dst)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        a, b = code.reshape(-1, 2).T
        return pd.DataFrame({"v": ids, "component": ids[least_code(a, b, len(ids))]})  # ids are sorted: the least code is the least id

    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    named = pairs.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(label, f"v {simple}, component {simple}")
    verts = vertices.select(F.col(vertex).alias("v")).distinct()
    return cut_lineage(wide_join(verts, named, "v", "left").select(F.col("v").alias(vertex), F.coalesce("component", "v").alias("component")))


def pack_blocks(df: DataFrame, id_col: str, label: str, features: str = "features", weight: str | None = None,
                rows: int = 1024) -> DataFrame:
    """Points packed into blocks of at most ``rows`` rows, one row per block:
    (blk, ids, labels, weights, dim, vecs), ``vecs`` a row-major float64 matrix.

    Every task packs what it holds, batch by batch; sort or partition the
    input first where blocks should hold few labels. The result is written,
    so block numbers stay the same for every later reader.
    """
    import pandas as pd
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, label)}

    def block(ids, labs, w, vecs):
        X = np.array(vecs, dtype=float)
        return {"ids": ids, "labels": labs, "weights": w, "dim": X.shape[1], "vecs": X.tobytes()}

    def pack(it):
        for pdf in it:
            out = []
            for lo in range(0, len(pdf), rows):
                part = pdf.iloc[lo:lo + rows]
                w = part["_w"].to_numpy(dtype=np.int64)
                out.append(block(part[id_col].to_numpy(), part[label].to_numpy(), w, part[features].tolist()))
            if out:
                yield pd.DataFrame(out)

    src = df.select(id_col, label, (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), features)
    schema = (f"ids array<{types[id_col]}>, labels array<{types[label]}>, weights array<bigint>, "
              "dim int, vecs binary")
    return cut_lineage(src.mapInPandas(pack, schema).withColumn("blk", F.monotonically_increasing_id()))


CELL_PAIRS, MIN_CELLS = 256, 64      # pairs of blocks a cell holds at most; cells there are at least


def pair_blocks(left: DataFrame, right: DataFrame, score, schema: str) -> DataFrame:
    """Apply ``score(left block, right block) -> pandas frame`` to every pair of blocks.

    Fragment and replicate on a grid of side s: a left block takes one grid
    row and is copied to its s cells, a right block takes one column, and the
    two meet by co-grouping on the cell. A cell holds about ``CELL_PAIRS``
    pairs, so about 16 blocks of each side, whatever the number of blocks (fewer
    where there would be less than ``MIN_CELLS`` cells); work spreads over
    s * s keys and a block is shipped s times, not once per partner.
    """
    import pandas as pd
    n = max(left.count(), 1) * max(right.count(), 1)
    side = int(np.ceil(np.sqrt(n / min(CELL_PAIRS, max(16, n / MIN_CELLS)))))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    own = F.pmod(F.xxhash64("blk"), F.lit(side)).cast("int")
    a = left.select("*", own.alias("_row")).select("*", every.alias("_col"))
    b = right.select("*", own.alias("_col")).select("*", every.alias("_row"))

    def cell(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = [score(x, y) for x in lp.itertuples() for y in rp.itertuples()]
        return pd.concat(out) if out else pd.DataFrame()

    return a.groupBy("_row", "_col").cogroup(b.groupBy("_row", "_col")).applyInPandas(cell, schema)


def block_matrix(block) -> np.ndarray:
    return np.frombuffer(block.vecs).reshape(-1, block.dim)


def nearest_labelled(points: DataFrame, sample: DataFrame, id_col: str, label_col: str,
                     features: str = "features", sample_id: str | None = None,
                     max_broadcast_rows: int = 200_000) -> DataFrame:
    """Label of the nearest sample point (ties -> lowest sample id).

    Distances are compared after rounding their squares to 9 places. Up to
    ``max_broadcast_rows`` sample points are shipped to every task, which
    scores its partition in numpy blocks. Beyond that, points and sample are
    packed into blocks, every block pair gives each point its best partner,
    and an aggregate per point keeps the best of those: the same rows either
    way. Point ids must be unique.
    """
    import pandas as pd
    sample_id = sample_id or id_col
    id_type = points.schema[id_col].dataType.simpleString()
    lab_type = sample.schema[label_col].dataType.simpleString()
    sid_type = sample.schema[sample_id].dataType.simpleString()
    sample = sample.select(F.col(sample_id).alias("_sid"), label_col, features)
    n = sample.count()
    if n > max_broadcast_rows:
        def best(x, y):
            sids = np.asarray(y.ids)
            order = np.argsort(sids, kind="stable")  # the first minimum is the lowest id
            d2 = np.round(_sq_block(block_matrix(x), block_matrix(y)[order]), 9)
            j = np.argmin(d2, axis=1)
            return pd.DataFrame({"id": x.ids, "d2": d2[np.arange(len(j)), j], "sid": sids[order][j],
                                 "lab": np.asarray(y.labels)[order][j]})

        found = pair_blocks(pack_blocks(points.withColumn("_none", F.lit(0)), id_col, "_none", features),
                            pack_blocks(sample, "_sid", label_col, features), best,
                            f"id {id_type}, d2 double, sid {sid_type}, lab {lab_type}")
        top = found.groupBy("id").agg(F.min(F.struct("d2", "sid", "lab")).alias("m"))
        return top.select(F.col("id").alias(id_col), F.col("m.lab").alias(label_col), F.col("m.sid").alias("nearest_id"))
    s = sample.orderBy("_sid").toPandas()  # at most max_broadcast_rows rows
    S = np.array(s[features].tolist(), dtype=float) if n else np.zeros((0, 0))
    bc = points.sparkSession.sparkContext.broadcast((S, s["_sid"].to_numpy(), s[label_col].to_numpy()))

    def score(it):
        S_, ids_, lab_ = bc.value
        for pdf in it:
            if len(pdf) == 0 or len(S_) == 0:
                continue
            X = np.array(pdf[features].tolist(), dtype=float)
            near = np.concatenate([np.argmin(np.round(_sq_block(X[lo:lo + 512], S_), 9), axis=1)
                                   for lo in range(0, len(X), 512)])  # first (= lowest id) among ties
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), label_col: lab_[near], "nearest_id": ids_[near]})

    schema = f"{id_col} {id_type}, {label_col} {lab_type}, nearest_id {sid_type}"
    return points.select(id_col, features).mapInPandas(score, schema)


def _sq_block(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of X to all rows of Y."""
    d2 = (X * X).sum(axis=1)[:, None] + (Y * Y).sum(axis=1)[None, :] - 2 * X @ Y.T
    return np.maximum(d2, 0.0)
