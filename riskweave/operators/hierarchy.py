"""Ward clustering of all rows by reciprocal nearest neighbours.

The Ward cost of joining two clusters, sqrt(2 nA nB / (nA + nB)) * |meanA - meanB|, never
falls below the cheaper of two costs when those two clusters are joined first. So every
pair of clusters that are each other's cheapest partner belongs to the tree, and all
such pairs are joined in the same round, whatever happens elsewhere. A cluster whose
partner was not joined keeps it; only the others search again.

A cluster is a row (id, rows, sum of vectors), named by its least row id. The search runs
on metric blocks (``operators.blocks``): first inside each block, which bounds how far
the cheapest partner can lie, then in blocks within that reach. Once the clusters left
fit one block, the same rounds run on inside it (at most ``rows`` clusters, whatever the
size of the table). The tree is a table of merges; nothing of it is on the driver. The
number of rounds follows the data (a chain of ever wider gaps joins one pair a round,
evenly mixed data halve the clusters).

Costs are compared after rounding to 9 places; ties go to the lower partner id, as if
pairs were ordered by (cost, lower id, higher id). This order keeps the argument above
valid for tied costs, so the merges are those of joining the first pair again and again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import blocks as B
from riskweave.operators.neighbors import collapse, components, spread_join
from riskweave.operators.ranks import with_rank
from riskweave.session import cut_lineage, drop_scratch

PLACES = 9


def _cost(x, y) -> np.ndarray:
    """Rounded Ward cost of every cluster of block x with every cluster of block y."""
    na, nb = np.asarray(x.n_rows, dtype=float)[:, None], np.asarray(y.n_rows, dtype=float)[None, :]
    return np.round(np.sqrt(2 * na * nb / (na + nb) * B.sq_matrix(B.matrix(x), B.matrix(y))), PLACES)


def _cheapest(x, y):
    """The cheapest partner in y of every cluster of x that searches, lower id on ties."""
    import pandas as pd
    seek = np.flatnonzero(np.asarray(x.seeks, dtype=bool))
    ids = np.asarray(y.ids)
    cost = _cost(x, y)[seek]
    if x.blk == y.blk:
        cost[np.arange(len(seek)), seek] = np.inf
    order = np.argsort(ids, kind="stable")
    j = order[cost[:, order].argmin(1)] if len(ids) else np.zeros(0, int)
    best = cost[np.arange(len(seek)), j]
    live = np.isfinite(best)
    n = np.asarray(x.n_rows, dtype=float)[seek]
    # no partner of cost c is further away than c / sqrt(2 n / (n + 1))
    reach = (best + 10.0 ** -PLACES) / np.sqrt(2 * n / (n + 1))
    return pd.DataFrame({"blk": x.blk, "id": np.asarray(x.ids)[seek][live], "to": ids[j][live], "cost": best[live],
                         "reach": reach[live]})


def _partners(state: DataFrame, rows: int, homes: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """(id, to, cost): the cheapest partner of every cluster without one; and what to delete after use."""
    ident = state.schema["id"].dataType.simpleString()
    schema = f"blk long, id {ident}, to {ident}, cost double, reach double"
    pts = state.select("id", F.transform("sums", lambda v: v / F.col("n_rows")).alias("mean"), "n_rows",
                       F.col("to").isNull().alias("seeks"))
    blocks = B.pack(pts, "id", "mean", ["n_rows", "seeks"], rows=rows, homes=homes)
    asks = blocks.withColumn("any", F.exists("seeks", lambda v: v))
    own = asks.filter("any").select("grp", F.col("blk").alias("i"), F.col("blk").alias("j"))
    near = cut_lineage(B.visit(blocks, own, _cheapest, schema))
    # a cluster alone in its block has no bound yet: its block reaches everywhere
    held = near.groupBy("blk").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("bounded"))
    wanted = F.aggregate("seeks", F.lit(0), lambda a, v: a + v.cast("int"))
    reach = F.when(F.coalesce("bounded", F.lit(0)) < wanted, F.lit(float("inf"))).otherwise(F.col("reach"))
    ranged = asks.join(held, "blk", "left").withColumn("reach", reach)
    pairs = B.near_blocks(ranged, "reach", "any", ordered=False).filter("i <> j")
    found = near.unionByName(B.visit(blocks, pairs, _cheapest, schema))
    best = found.groupBy("id").agg(F.min(F.struct("cost", "to")).alias("m")).select("id", "m.to", "m.cost")
    return best, [blocks, near]


def _finish(first_round: int):
    """All merges of the clusters of one block, by the same rounds."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n = pdf["id"].to_numpy(), pdf["n_rows"].to_numpy(dtype=float)
        sums = np.array(pdf["sums"].tolist(), dtype=float).reshape(len(ids), -1)
        alive = np.ones(len(ids), dtype=bool)
        cost = np.full((len(ids), len(ids)), np.inf)

        def price(at):
            js = np.flatnonzero(alive)
            mean = sums[js] / n[js][:, None]
            c = np.round(np.sqrt(2 * n[at][:, None] * n[js][None, :] / (n[at][:, None] + n[js][None, :])
                                 * B.sq_matrix(sums[at] / n[at][:, None], mean)), PLACES)
            cost[np.ix_(at, js)] = c
            cost[np.ix_(js, at)] = c.T
            cost[at, at] = np.inf

        price(np.arange(len(ids)))
        out, step = [], first_round
        while alive.sum() > 1:
            to = cost.argmin(1)                            # rows are in id order: ties go to the lower id
            i = np.flatnonzero(alive & (to[to] == np.arange(len(ids))) & (np.arange(len(ids)) < to))
            j = to[i]
            n[i] += n[j]
            sums[i] += sums[j]
            out.append(pd.DataFrame({"a": ids[i], "b": ids[j], "height": cost[i, j], "size": n[i].astype(np.int64), "round": step}))
            alive[j] = False
            cost[j, :] = cost[:, j] = np.inf
            price(i)
            step += 1
        return pd.concat(out) if out else pd.DataFrame(columns=["a", "b", "height", "size", "round"])
    return run


class WardTree:
    """``merges`` (step, a, b, height, size): a and b are the least row ids of the two clusters
    joined, size the rows of the result. ``members`` (id, uid): every row's distinct vector,
    named by its least row. One merge per row but one; equal rows join first, at height 0."""

    def __init__(self, merges: DataFrame, members: DataFrame, n_rows: int):
        self.merges, self.members, self.n_rows = merges, members, n_rows

    def labels(self, n_clusters: int) -> DataFrame:
        """(id, cluster): the clusters left when ``n_clusters`` remain, numbered from 0 by least id."""
        return self._named(self._cut(F.col("step") <= F.lit(self.n_rows - n_clusters)))

    def labels_below(self, height: float) -> DataFrame:
        """(id, cluster): the clusters joined at or below ``height``."""
        return self._named(self._cut(F.col("height") <= F.lit(float(height))))

    def _cut(self, done) -> DataFrame:
        """(id, root): components over the merges that are ``done``."""
        merges = self.merges.filter(done)
        leaves = self.members.select("uid").distinct()
        between = merges.filter("NOT equal_rows")
        roots = components(leaves.withColumnRenamed("uid", "id"), between, "id", "a", "b")
        rows = spread_join(self.members, roots.select(F.col("id").alias("uid"), "component"), ["uid"], "id")
        # a row whose merge with its equals is not done yet stands alone
        alone = self.merges.filter(~done).filter("equal_rows").select(F.col("b").alias("id"), F.lit(True).alias("alone"))
        return rows.join(alone, "id", "left").select("id", F.when(F.col("alone"), F.col("id")).otherwise(
            F.col("component")).alias("root"))

    def _named(self, cut: DataFrame) -> DataFrame:
        cut = cut_lineage(cut)
        number = with_rank(cut.select("root").distinct(), ["root"], "place")
        named = number.select("root", (F.col("place") - 1).cast("int").alias("cluster"))
        return spread_join(cut, named, ["root"], "id").select("id", "cluster")

    def cut_height(self, n_clusters: int) -> DataFrame:
        """One row: the heights between which ``n_clusters`` clusters exist, the cut halfway, and the
        colour threshold of the usual dendrogram (0.7 of the greatest height)."""
        top = self.merges.orderBy(F.col("step").desc()).limit(n_clusters)
        place = F.lit(self.n_rows) - F.col("step")                    # 1 for the last merge
        out = top.agg(F.max(F.when(place == n_clusters, F.col("height"))).alias("below"),
                      F.max(F.when(place == n_clusters - 1, F.col("height"))).alias("above"),
                      (F.max("height") * 0.7).alias("colour_threshold"))
        return out.select(F.lit(n_clusters).alias("n_clusters"), "below", "above",
                          ((F.col("below") + F.col("above")) / 2).alias("cut"), "colour_threshold")


def ward_tree(df: DataFrame, id_col: str, features: str = "features", rows: int = B.ROWS) -> WardTree:
    """The Ward tree of all rows of ``df``.

    Ids must be unique and not null; rows with a null vector are left out. A table of one row
    gives no merge, an empty one an empty tree."""
    data = df.select(F.col(id_col).alias("id"), F.col(features).alias("features")).filter(F.col("features").isNotNull())
    points, members = collapse(data, "id")
    members = cut_lineage(members.select("id", "uid"))
    n_rows, total = members.count(), points.count()
    ident = data.schema["id"].dataType.simpleString()
    homes = B.pivots(points, "uid", "features", rows) if total else np.zeros((0, 0))
    state = cut_lineage(points.select(F.col("uid").alias("id"), F.col("w").cast("long").alias("n_rows"),
                                      F.col("features").alias("sums"))
                        .withColumn("sums", F.transform("sums", lambda v: v * F.col("n_rows")))
                        .withColumn("to", F.lit(None).cast(ident)).withColumn("cost", F.lit(None).cast("double")))
    drop_scratch(points)
    done: list[DataFrame] = []
    while total > rows:
        found, scratch = _partners(state, rows, homes)
        fresh = found.select("id", F.col("to").alias("to_"), F.col("cost").alias("cost_"))
        full = cut_lineage(state.join(fresh, "id", "left").select(
            "id", "n_rows", "sums", F.coalesce("to", "to_").alias("to"), F.coalesce("cost", "cost_").alias("cost")))
        drop_scratch(state, *scratch)
        a, b = full.alias("a"), full.alias("b")
        joined = cut_lineage(
            a.join(b, (F.col("a.id") == F.col("b.to")) & (F.col("a.to") == F.col("b.id")) & (F.col("a.id") < F.col("b.id")))
            .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.cost").alias("height"),
                    (F.col("a.n_rows") + F.col("b.n_rows")).alias("size"),
                    F.zip_with("a.sums", "b.sums", lambda x, y: x + y).alias("sums"), F.lit(len(done) + 1).alias("round")))
        done.append(joined)
        total -= joined.count()
        used = joined.select(F.col("a").alias("x")).unionAll(joined.select(F.col("b").alias("x")))
        rest = (full.join(used, full["id"] == used["x"], "left_anti")
                .join(used.withColumnRenamed("x", "y"), F.col("to") == F.col("y"), "left")
                .select("id", "n_rows", "sums", F.when(F.col("y").isNull(), F.col("to")).alias("to"),
                        F.when(F.col("y").isNull(), F.col("cost")).alias("cost")))
        new = joined.select(F.col("a").alias("id"), F.col("size").alias("n_rows"), "sums",
                            F.lit(None).cast(ident).alias("to"), F.lit(None).cast("double").alias("cost"))
        state = cut_lineage(rest.unionByName(new))
        drop_scratch(full)
    # what is left fits one block: its rounds run on, in one task of at most ``rows`` clusters
    top = cut_lineage(state.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        _finish(len(done) + 1), f"a {ident}, b {ident}, height double, size long, round int"))
    done.append(top)
    drop_scratch(state)
    # equal rows, in id order: each joins those before it at height 0
    place = with_rank(members, ["uid", "id"], "place")
    first = place.groupBy("uid").agg(F.min("place").alias("first"))
    equal = (spread_join(place.filter("id <> uid"), first, ["uid"], "id")
             .select(F.col("uid").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"),
                     (F.col("place") - F.col("first") + 1).alias("size"), F.lit(0).alias("round")))
    every = equal
    for j in done:
        every = every.unionByName(j.select("a", "b", "height", "size", "round"))
    ranked = with_rank(every, ["height", "round", "a", "size", "b"], "step")
    merges = cut_lineage(ranked.select("step", "a", "b", "height", "size", (F.col("round") == 0).alias("equal_rows")))
    drop_scratch(ranked, place, *done)
    return WardTree(merges, members, n_rows)
