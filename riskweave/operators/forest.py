"""Minimum spanning forest up to a threshold without an edge list, and the Euler
curve of the neighbourhood graph (V3 re-aimed).

Points lie in metric blocks (``operators.blocks``). In every Boruvka round each block first
looks inside itself, which bounds how far the nearest foreign point of its components can
lie; then only blocks within that reach are visited. A visit returns at most one edge per
component and side, so memory stays linear in the points however many pairs are near.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import blocks as B
from riskweave.operators.neighbors import collapse, components, spread_join
from riskweave.session import cut_lineage, drop_scratch

EDGE = "c long, d2 double, a long, b long, foreign long"


def _nearest_foreign(e2: float):
    """Per component of block x: its shortest edge to another component's point in block y."""
    import pandas as pd

    def find(x, y):
        cx, cy = np.asarray(x.comp), np.asarray(y.comp)
        ix, iy = np.asarray(x.ids), np.asarray(y.ids)
        i, j, d2 = B.nearest_pairs(B.matrix(x), B.matrix(y), cx[:, None] != cy[None, :], e2)
        lo, hi = np.minimum(ix[i], iy[j]), np.maximum(ix[i], iy[j])
        edges = pd.DataFrame({"c": cx[i], "d2": d2, "a": lo, "b": hi, "foreign": cy[j]})
        # equal lengths: the least pair of ids
        return edges.sort_values(["c", "d2", "a", "b"]).drop_duplicates("c") if len(edges) else edges
    return find


def spanning_forest(df: DataFrame, id_col: str, thresh: float, features: str = "features", rows: int = B.ROWS
                    ) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, dist), components (id, component)) of the distinct vectors of ``df``, each
    named by its least id. Edges follow the total order (length, number of the two points)."""
    points, members = collapse(df.filter(F.col(features).isNotNull()), id_col, features)
    blocks = B.pack(points, "pid", features, rows=rows)
    place = cut_lineage(blocks.select("blk", F.posexplode("ids").alias("pos", "pid")))
    comp = cut_lineage(place.select("pid", F.col("pid").alias("component")))
    e2 = float(thresh) * float(thresh)
    find, taken = _nearest_foreign(e2), []
    least = F.min(F.struct("d2", "a", "b", "foreign")).alias("m")
    while True:
        held = (place.join(comp, "pid").groupBy("blk").agg(
            F.array_sort(F.collect_list(F.struct("pos", "component"))).alias("c"),
            F.min("component").alias("lo"), F.max("component").alias("hi")))
        now = cut_lineage(blocks.join(held, "blk").withColumn("comp", F.col("c.component")).drop("c"))
        own = now.filter("lo <> hi").select("grp", F.col("blk").alias("i"), F.col("blk").alias("j"))
        near = cut_lineage(B.visit(now, own, find, EDGE).groupBy("c").agg(least))
        # a block reaches as far as the component in it that still has the longest way
        bound = (place.join(comp, "pid").select("blk", "component").distinct()
                 .join(near.select(F.col("c").alias("component"), F.sqrt("m.d2").alias("d")), "component", "left")
                 .groupBy("blk").agg(F.max(F.coalesce("d", F.lit(float(thresh)))).alias("reach")))
        ranged = now.join(bound, "blk")
        sides = now.select("blk", "lo", "hi")
        pairs = (B.near_blocks(ranged, "reach", ordered=False).filter("i <> j")
                 .join(sides.toDF("i", "li", "ui"), "i").join(sides.toDF("j", "lj", "uj"), "j")
                 .filter("NOT (li = ui AND lj = uj AND li = lj)").select("grp", "i", "j"))
        far = B.visit(now, pairs, find, EDGE).groupBy("c").agg(least)
        best = cut_lineage(near.unionByName(far).groupBy("c").agg(F.min("m").alias("m")).select("c", "m.*"))
        drop_scratch(now, near)
        if best.isEmpty():
            drop_scratch(best)
            break
        taken.append(best)
        merged = components(comp.select(F.col("component").alias("v")).distinct(), best, "v", "c", "foreign")
        names = merged.toDF("component", "into")
        after = cut_lineage(spread_join(comp, names, ["component"], "pid").select("pid", F.col("into").alias("component")))
        drop_scratch(comp, merged)
        comp = after
    uid = points.select("pid", "uid")
    edges = None
    for t in taken:
        part = t.select("a", "b", F.sqrt("d2").alias("dist")).distinct()
        edges = part if edges is None else edges.unionByName(part)
    kind = points.schema["uid"].dataType.simpleString()
    if edges is None:
        named = df.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, dist double")
    else:
        named = cut_lineage(edges.join(uid.toDF("a", "src"), "a").join(uid.toDF("b", "dst"), "b").select("src", "dst", "dist"))
    tops = comp.join(uid, "pid").groupBy("component").agg(F.min("uid").alias("top"))
    out = cut_lineage(spread_join(comp.join(uid, "pid"), tops, ["component"], "pid").select(
        F.col("uid").alias("id"), F.col("top").alias("component")))
    drop_scratch(points, blocks, place, comp, *taken)
    return named, out


def persistence_h0(df: DataFrame, id_col: str, thresh: float, features: str = "features") -> DataFrame:
    """Vietoris-Rips H0 up to ``thresh``: births 0, deaths = lengths of the minimum spanning forest,
    one infinite bar per remaining component; zero-length bars (equal rows) omitted."""
    edges, comp = spanning_forest(df, id_col, thresh, features)
    finite = edges.filter(F.col("dist") > 0).select(F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("dist").alias("death"))
    inf = comp.select("component").distinct().select(F.lit(0).alias("dim"), F.lit(0.0).alias("birth"),
                                                     F.lit(float("inf")).alias("death"))
    return finite.unionByName(inf)


CELL_ARCS = 1 << 20      # edges of a cell, about
WEDGES = 1 << 21         # wedges looked up at once


def _cells(arcs: DataFrame, parts: int, levels: int) -> DataFrame:
    """(cell, u, v, m): every arc (u, v, k) in each of the ``parts`` cells that its vertices' colours and a
    third one name; m holds the two colours and the level."""
    colour = {c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("long") for c in ("u", "v")}
    three = F.array_sort(F.array("cu", "cv", "cx"))
    return (arcs.select("u", "v", "k", colour["u"].alias("cu"), colour["v"].alias("cv"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("cx"))
            .select(((three[0] * parts + three[1]) * parts + three[2]).alias("cell"), "u", "v",
                    ((F.col("cu") * parts + F.col("cv")) * levels + F.col("k")).alias("m")))


def _count_triangles(parts: int, levels: int):
    """Triangles of one cell whose colours are just the cell's, by the level of their longest edge."""
    import pandas as pd

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, total = int(pdf["cell"].iloc[0]), np.zeros(levels, dtype=np.int64)
        pdf = pdf.sort_values("u", kind="stable")
        code, names = pd.factorize(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]))
        u, v = code.astype(np.int64).reshape(2, -1)
        colours, k = np.divmod(pdf["m"].to_numpy(), levels)
        cu, cv = np.divmod(colours, parts)
        key = np.minimum(u, v) * len(names) + np.maximum(u, v)
        order = np.argsort(key, kind="stable")
        key, closing = key[order], k[order]
        once = len(key) < 2 or bool((key[1:] != key[:-1]).all())
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        after = np.repeat(np.r_[start[1:], len(u)], np.diff(np.r_[start, len(u)])) - np.arange(len(u)) - 1      # later arcs of one start
        upto = np.r_[0, np.cumsum(after)]
        a = 0
        while a < len(u):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + WEDGES, side="right")) - 1)
            i = np.repeat(np.arange(a, b), after[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:b] - upto[a], after[a:b])
            low = np.minimum(np.minimum(cu[i], cv[i]), cv[j])
            high = np.maximum(np.maximum(cu[i], cv[i]), cv[j])
            own = (v[i] != v[j]) & ((low * parts + (cu[i] + cv[i] + cv[j] - low - high)) * parts + high == cell)
            i, j = i[own], j[own]
            third = np.minimum(v[i], v[j]) * len(names) + np.maximum(v[i], v[j])
            at = np.searchsorted(key, third)
            many = (np.searchsorted(key, third, side="right") if not once else at + (key[np.minimum(at, len(key) - 1)] == third)) - at
            hit = np.flatnonzero(many)
            i, j, at, many = i[hit], j[hit], at[hit], many[hit]
            edge = np.repeat(at, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            longest = np.maximum(np.repeat(np.maximum(k[i], k[j]), many), closing[edge])
            total += np.bincount(longest, minlength=levels)
            a = b
        return pd.DataFrame({"k": np.arange(levels, dtype=np.int32), "t": total})
    return count


def euler_curve(vertices: DataFrame, pairs: DataFrame, thresholds: Sequence[float], id_col: str = "id",
                cell_arcs: int = CELL_ARCS) -> DataFrame:
    """(threshold, n_vertices, n_edges, n_triangles, euler) of the graph of ``pairs`` (src, dst, dist)
    no longer than each threshold; euler = vertices - edges + triangles.

    Edges point from the end of lower (degree, id) to the other, so no vertex starts more than
    about sqrt(2 edges) of them and a hub's wedges stay few. A triangle is two edges of one start closed by a third; it is
    counted once, at the level of its longest edge, and the levels are added up.

    No wedge is ever a row. Vertices are dealt into p colours; each three colours are a cell, which
    receives the edges between vertices of its colours and counts the triangles of just these
    colours. An edge goes to p cells and a cell holds about 6 edges / p^2 of them, ``cell_arcs`` by the choice of p,
    so what is shuffled grows as edges^1.5 and not as the wedges."""
    cuts = sorted(float(t) for t in thresholds)
    level = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        level = F.when(F.col("dist") <= F.lit(cuts[k]), F.lit(k)).otherwise(level)
    e = cut_lineage(pairs.select("src", "dst", level.alias("k")).filter(F.col("k") < len(cuts)))
    deg = (e.select(F.col("src").alias("v")).unionAll(e.select(F.col("dst").alias("v")))
           .groupBy("v").agg(F.count(F.lit(1)).alias("g")))
    ends = spread_join(spread_join(e, deg.toDF("src", "gs"), ["src"], "dst"), deg.toDF("dst", "gd"), ["dst"], "src")
    forward = F.struct("gs", "src") < F.struct("gd", "dst")
    arcs = ends.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"),
                       F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"), "k")
    parts = max(1, math.ceil(math.sqrt(6 * e.count() / cell_arcs)))
    tri = (_cells(arcs, parts, len(cuts)).groupBy("cell").applyInPandas(_count_triangles(parts, len(cuts)), "k int, t long")
           .groupBy("k").agg(F.sum("t").alias("t")))
    edges = e.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    grid = vertices.sparkSession.createDataFrame(list(enumerate(cuts)), "k int, threshold double")
    n = vertices.select(id_col).distinct().agg(F.count(F.lit(1)).alias("n_vertices"))
    # one row per level: the running sums are over the thresholds, not the data
    counted = grid.join(edges, "k", "left").join(tri, "k", "left").select("k", "threshold", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("t", F.lit(0)).alias("t"))
    upto = counted.select(F.col("k").alias("k_"), F.col("m").alias("m_"), F.col("t").alias("t_"))
    summed = (counted.join(upto, F.col("k_") <= F.col("k")).groupBy("k", "threshold")
              .agg(F.sum("m_").alias("n_edges"), F.sum("t_").alias("n_triangles")))
    return (summed.crossJoin(n).select("threshold", "n_vertices", "n_edges", "n_triangles",          # one-row table
                                       (F.col("n_vertices") - F.col("n_edges") + F.col("n_triangles")).alias("euler")))

