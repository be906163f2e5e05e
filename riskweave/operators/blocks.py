"""Points in metric blocks: exact near-pair and nearest-partner searches.

``pack`` gives every point the nearest pivot as its home (pivots are a bounded sample,
searched on two levels), sorts by (group, home, distance to it) and cuts the run into
blocks of at most ``rows`` points. A block is one row: its ids and numbers, its vectors as one binary, and the
ball (centre, radius) that holds them.

``near_blocks`` pairs blocks whose balls come within a reach of each other. Only the
small summaries (one row per block) meet, on (group, salt); a pair of blocks whose
balls are too far apart is never read again.

``visit`` brings the blocks of surviving pairs together and applies a numpy function to
every pair. Pairs of many blocks meet in tiles of about ``TILE`` by ``TILE`` blocks that lie
next to each other in the sorted run, so a block travels once per tile, not once per pair, and
to few tiles. A tile holds some 2 * ``TILE`` * ``rows`` points, however skewed the data, and
no pair of points is written unless the function returns it; what it returns leaves the task
pair of blocks by pair of blocks.

Distances are summed dimension by dimension, left to right, as the SQL definition
does, so a pair exactly at a threshold is decided the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

ROWS = 1024          # points of a block
MAX_PIVOTS = 16384   # bound of the pivot sample, hence of what travels to every task
TOPS = 128           # pivots of the upper level
TILE = 16            # blocks a side that meet in one task
TILE_FROM = 16       # tiles a side there are at least
SLACK = 1e-9         # relative slack of ball bounds, for rounding in centres and radii


def sq_matrix(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of X to all rows of Y, summed left to right."""
    out = np.zeros((len(X), len(Y)))
    for k in range(X.shape[1] if len(X) and len(Y) else 0):
        diff = X[:, k][:, None] - Y[:, k][None, :]
        out += diff * diff
    return out


EXACT_DIM = 6        # up to here the sum by dimensions costs no more than the screen


def near_matrix(X: np.ndarray, Y: np.ndarray, e2: float) -> np.ndarray:
    """``sq_matrix(X, Y) <= e2``, decided by a matrix product; pairs so close to ``e2`` that its
    rounding could matter are summed left to right."""
    if X.shape[1] <= EXACT_DIM or not len(X) or not len(Y):
        return sq_matrix(X, Y) <= e2
    d2, slack = _screen(X, Y)
    if not slack < 1e290:                    # the product may not be a number
        return sq_matrix(X, Y) <= e2
    near, maybe = d2 < e2 - slack, d2 <= e2 + slack
    if np.count_nonzero(near) != np.count_nonzero(maybe):
        i, j = np.nonzero(maybe & ~near)
        near[i, j] = sq_pairs(X, Y, i, j) <= e2
    return near


def nearest_pairs(X: np.ndarray, Y: np.ndarray, allowed: np.ndarray, e2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance): the allowed pairs within ``e2`` that are the shortest of their row of X,
    all of them on ties. The product leaves out what cannot be shortest; the rest are summed left
    to right."""
    if not len(X) or not len(Y):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    d2, slack = (sq_matrix(X, Y), 0.0) if X.shape[1] <= EXACT_DIM else _screen(X, Y)
    least = np.where(allowed, d2 - slack, np.inf)
    most = np.where(allowed, d2 + slack, np.inf).min(1)
    i, j = np.nonzero(allowed & ~(least > np.minimum(most, e2)[:, None]))
    exact = sq_pairs(X, Y, i, j)
    best = np.full(len(X), np.inf)
    np.minimum.at(best, i, exact)
    keep = (exact == best[i]) & (exact <= e2) & np.isfinite(exact)
    return i[keep], j[keep], exact[keep]


def _screen(X: np.ndarray, Y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product from a common origin, and a bound on how far they may
    lie from those of ``sq_matrix``."""
    mid = X.mean(0)
    X, Y = X - mid, Y - mid
    nx, ny = (X * X).sum(1), (Y * Y).sum(1)
    # the squares are two more columns of the product: the matrix is written once
    d2 = np.column_stack([X, nx, np.ones(len(X))]) @ np.column_stack([-2 * Y, np.ones(len(Y)), ny]).T
    grain = 16 * (X.shape[1] + 4) * np.finfo(float).eps
    shift = float(np.abs(mid).max(initial=0.0)) ** 2 * X.shape[1]  # rounding of the subtraction itself
    return d2, float(grain * (nx.max() + ny.max() + shift))


def sq_pairs(X: np.ndarray, Y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``sq_matrix(X, Y)[i, j]``, summed in the same order."""
    out = np.zeros(len(i))
    for k in range(X.shape[1]):
        diff = X[i, k] - Y[j, k]
        out += diff * diff
    return out


def matrix(row) -> np.ndarray:
    """The vectors of a packed block (a row of the frame that ``visit`` hands over)."""
    n = len(row.ids)
    short = len(row.vecs) < 8 * n * len(row.centre)       # see ``packed``
    return np.frombuffer(row.vecs, np.float32 if short else np.float64).astype(float, copy=False).reshape(n, -1)


def packed(X: np.ndarray) -> bytes:
    """The vectors of a block, in single precision where that holds the same numbers."""
    with np.errstate(over="ignore"):
        short = X.astype(np.float32)
    return short.tobytes() if np.array_equal(short, X) else X.tobytes()


def cells(X: np.ndarray, e2: float) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the rows of X in an order that keeps cells together, and where each cell begins.
    A box is halved along its widest side until its points are all within ``e2`` (squared) of each other
    or few."""
    few = max(8, X.shape[1])
    done, todo = [], [np.arange(len(X))] if len(X) else []
    while todo:
        at = todo.pop()
        P = X[at]
        lo, hi = P.min(0), P.max(0)
        if len(at) > few and gap2(hi[None], lo[None], hi[None], lo[None])[0, 0] > e2:
            k = int(np.argmax(hi - lo))
            left = P[:, k] <= lo[k] + (hi[k] - lo[k]) / 2
            if left.any() and not left.all():
                todo += [at[~left], at[left]]
                continue
        done.append(at)
    return (np.concatenate(done) if done else np.zeros(0, int)), np.cumsum([0, *map(len, done[:-1])])[:max(len(done), 0)]


def boxes(X: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of every cell."""
    return np.minimum.reduceat(X, first), np.maximum.reduceat(X, first)


def gap2(lx: np.ndarray, hx: np.ndarray, ly: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """Squared gaps of all boxes of x to all boxes of y. Summed as ``sq_matrix`` sums, whose rounding is
    monotone: no distance of their points is summed to less."""
    out = np.zeros((len(lx), len(ly)))
    for k in range(lx.shape[1]):
        apart = np.maximum(np.maximum(lx[:, k][:, None] - hy[:, k][None, :], ly[:, k][None, :] - hx[:, k][:, None]), 0.0)
        out += apart * apart
    return out


def pivots(df: DataFrame, id_col: str, features: str, rows: int) -> np.ndarray:
    """About four points per block, at most MAX_PIVOTS, picked by a hash of the id.

    Every task sends the driver as many rows as are wanted in all, so rows whose hash is not among
    the least are left out first; the pick is the same."""
    n = df.count()
    want = int(min(MAX_PIVOTS, max(1, 4 * n // rows)))
    place = F.xxhash64(F.lit(7), F.col(id_col))
    some, share = [], (want + 8 * want ** 0.5 + 8) / max(n, 1)
    if share < 1:
        low = df.select(features, id_col).filter(place <= F.lit(int(share * 2 ** 64) - 2 ** 63))
        some = low.orderBy(place, id_col).limit(want).collect()
    if len(some) < want:            # ids that repeat may leave too few
        some = df.select(features, id_col).orderBy(place, id_col).limit(want).collect()
    return np.array([r[0] for r in some], dtype=float)


class Homes:
    """Nearest pivot on two levels: the nearest of the first pivots, then of those nearest to it."""

    def __init__(self, pivots: np.ndarray):
        tops = pivots[:max(1, min(TOPS, int(np.sqrt(len(pivots)))))]
        owner = _near(pivots, tops)[0]
        owner[:len(tops)] = np.arange(len(tops))          # an upper pivot is never without lower ones
        order = np.argsort(owner, kind="stable")
        self.tops, self.all = tops, pivots[order]
        self.first = np.searchsorted(owner[order], np.arange(len(tops) + 1))

    def __call__(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = _near(X, self.tops)[0]
        home, away = np.zeros(len(X), dtype=np.int32), np.zeros(len(X))
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            near, dist = _near(X[at], self.all[self.first[t]:self.first[t + 1]])
            home[at], away[at] = near + self.first[t], dist
        return home, away


def _near(X: np.ndarray, P: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (X * X).sum(1)[:, None] + (P * P).sum(1)[None, :] - 2 * X @ P.T
    return d2.argmin(1), np.sqrt(np.maximum(d2.min(1), 0))


def pack(df: DataFrame, id_col: str, features: str = "features", carry: Sequence[str] = (), by: str | None = None,
         rows: int = ROWS, homes: np.ndarray | None = None) -> DataFrame:
    """(grp, blk, n, ids, vecs, centre, radius, and an array per carried column), written to the
    shared folder, so block numbers stay the same for every reader. ``by`` keeps groups apart.

    Ids must be unique within a group; null vectors are not allowed."""
    import pandas as pd
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, *carry)}
    group = F.col(by) if by else F.lit(0)
    src = df.select(group.alias("grp"), F.col(id_col).alias("id"), F.col(features).alias("vec"), *carry)
    P = pivots(src, "id", "vec", rows) if homes is None else homes

    def place(it):
        homes_of = Homes(P) if len(P) else None
        for pdf in it:
            for a in range(0, len(pdf), 2048):
                part = pdf.iloc[a:a + 2048]
                X = np.array(part["vec"].tolist(), dtype=float).reshape(len(part), -1)
                home, away = homes_of(X)
                yield part.drop(columns="vec").assign(vec=[v.tobytes() for v in X], home=home, away=away)

    gtype = src.schema["grp"].dataType.simpleString()
    cols = "".join(f", {c} {types[c]}" for c in carry)
    placed = src.mapInPandas(place, f"grp {gtype}, id {types[id_col]}{cols}, vec binary, home int, away double")
    if len(P) > 1 or by:
        placed = placed.repartitionByRange("grp", "home", "away", "id").sortWithinPartitions("grp", "home", "away", "id")
    else:
        placed = placed.coalesce(1).sortWithinPartitions("id")       # fewer than two blocks of rows

    def blocks(it):
        held = None
        for pdf in it:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            done, held = _cut(held, rows, last=False)
            if done:
                yield pd.DataFrame(done)
        if held is not None and len(held):
            done, _ = _cut(held, rows, last=True)
            yield pd.DataFrame(done)

    def _cut(pdf, rows, last):
        new = np.flatnonzero(pdf["grp"].to_numpy()[1:] != pdf["grp"].to_numpy()[:-1]) + 1 if by else []
        edges = [0, *new, len(pdf)]
        done, rest = [], len(pdf)
        for a, b in zip(edges, edges[1:]):
            for s in range(a, b, rows):
                if not last and b == len(pdf) and s + rows >= b:      # it may still grow
                    rest = s
                    break
                part = pdf.iloc[s:min(b, s + rows)]
                X = np.frombuffer(b"".join(part["vec"])).reshape(len(part), -1)
                centre = X.mean(0)
                reach = float(np.sqrt(((X - centre) ** 2).sum(1).max())) if X.shape[1] else 0.0
                row = {"grp": part["grp"].iloc[0], "n": len(part), "ids": part["id"].to_numpy(), "vecs": packed(X),
                       "centre": centre, "radius": reach * (1 + SLACK)}
                done.append(row | {c: part[c].to_numpy() for c in carry})
        return done, pdf.iloc[rest:]

    arrays = "".join(f", {c} array<{types[c]}>" for c in carry)
    schema = f"grp {gtype}, n int, ids array<{types[id_col]}>, vecs binary, centre array<double>, radius double{arrays}"
    return cut_lineage(placed.mapInPandas(blocks, schema).withColumn("blk", F.monotonically_increasing_id()))


def near_blocks(blocks: DataFrame, reach, left: str | None = None, ordered: bool = True) -> DataFrame:
    """(grp, i, j): block pairs whose balls are within ``reach`` (a number, or the name of a
    column of ``blocks`` holding the left block's reach). ``left`` names a boolean column: only
    such blocks are left sides. ``ordered`` keeps i <= j only (for searches both ways)."""
    from riskweave.operators.neighbors import sq_dist
    far = F.col(reach) if isinstance(reach, str) else F.lit(float(reach))
    ball = blocks.select("grp", "blk", "centre", "radius", far.alias("far"), *([left] if left else []))
    parts = max(1, -(-blocks.count() // 1024))
    a = (ball.filter(left) if left else ball).select(
        "grp", F.col("blk").alias("i"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), "far",
        F.pmod(F.xxhash64("blk"), F.lit(parts)).cast("int").alias("salt"))
    b = ball.select("grp", F.col("blk").alias("j"), F.col("centre").alias("cb"), F.col("radius").alias("rb"),
                    F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"))
    gap = F.sqrt(sq_dist(F.col("ca"), F.col("cb"))) * F.lit(1 - SLACK) - F.col("ra") - F.col("rb")
    pairs = a.join(b, ["grp", "salt"]).filter((F.col("i") == F.col("j")) | (gap <= F.col("far")))
    if ordered:
        pairs = pairs.filter(F.col("i") <= F.col("j"))
    return pairs.select("grp", "i", "j")


def _places(blocks: DataFrame) -> tuple[int, Callable]:
    """(blocks, block number -> its place in the sorted run). Block numbers hold the partition that wrote
    the block and its place there; a row per partition reaches the driver."""
    part, at = F.shiftright("blk", 33), F.col("blk").bitwiseAND(F.lit((1 << 33) - 1))
    held = sorted(tuple(r) for r in blocks.groupBy(part).agg(F.count(F.lit(1)), F.max(at) + 1).collect())
    first = dict(zip([h[0] for h in held], np.cumsum([0, *[h[2] for h in held]]).tolist()))
    starts = F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(held[-1][0] + 1)]) if held else F.array(F.lit(0).cast("long"))

    def place(number):
        return F.element_at(starts, F.shiftright(number, 33).cast("int") + 1) + F.col(number).bitwiseAND(F.lit((1 << 33) - 1))

    return sum(h[1] for h in held), place


def visit(blocks: DataFrame, pairs: DataFrame, f: Callable, schema: str, merge: Callable | None = None) -> DataFrame:
    """``f(left row, right row) -> pandas frame`` on every pair (the same row twice where i = j).
    Frames leave the task one by one. ``merge(frame) -> frame`` shortens what the pairs of one tile
    returned before it leaves the task; pass none where the rows of ``f`` may grow with the pairs of points."""
    from collections.abc import Iterator

    import pandas as pd
    from riskweave.operators.neighbors import wide_join
    n, place = _places(blocks)
    if n >= 2 * TILE_FROM:
        side = min(TILE, n // TILE_FROM)
        ti, tj = (F.floor(place(c) / F.lit(side)).cast("int") for c in ("i", "j"))
        met = pairs.select("i", "j", F.least(ti, tj).alias("ti"), F.greatest(ti, tj).alias("tj"))  # both orders in one tile
        none = F.lit(None).cast("long").alias("to")
        need = (met.select(F.col("i").alias("blk"), "ti", "tj", F.col("j").alias("to"))
                .unionByName(met.select(F.col("j").alias("blk"), "ti", "tj", none))
                .groupBy("blk", "ti", "tj").agg(F.collect_list("to").alias("partners")))

        def tiled(held):
            rows = {r.blk: r for pdf in held for r in pdf.itertuples()}
            out = (f(r, rows[to]) for r in rows.values() for to in r.partners)
            if not merge:
                yield from out
            elif out := list(out):
                yield merge(pd.concat(out, ignore_index=True))

        tiled.__annotations__ = {"held": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
        return wide_join(blocks, need, "blk").groupBy("ti", "tj").applyInPandas(tiled, schema)
    a = wide_join(blocks, pairs.select(F.col("i").alias("blk"), "i", "j"), "blk")
    b = wide_join(blocks, pairs.filter("i <> j").select(F.col("j").alias("blk"), "i", "j"), "blk")

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r.blk: r for r in pdf.itertuples()}
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        return f(rows[i], rows[j])

    return a.unionByName(b).groupBy("i", "j").applyInPandas(both, schema)


def eps_pairs(blocks: DataFrame, eps: float, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs (src < dst) of one group within eps: src, dst, dist and src_<c>, dst_<c>."""
    import pandas as pd
    types = {f.name: f.dataType for f in blocks.schema.fields}
    item = {c: types[c].elementType.simpleString() for c in carry}
    ident = types["ids"].elementType.simpleString()
    e2 = float(eps) * float(eps)

    def pairs(x, y):
        X, Y = matrix(x), matrix(y)
        ia, ib = np.nonzero(near_matrix(X, Y, e2))
        ida, idb = np.asarray(x.ids)[ia], np.asarray(y.ids)[ib]
        if x.blk == y.blk:
            keep = ia < ib
            ia, ib, ida, idb = ia[keep], ib[keep], ida[keep], idb[keep]
        swap = np.array([p > q for p, q in zip(ida, idb)], dtype=bool) if ida.dtype == object else ida > idb
        out = {"src": np.where(swap, idb, ida), "dst": np.where(swap, ida, idb), "dist": np.sqrt(sq_pairs(X, Y, ia, ib))}
        for c in carry:
            ca, cb = np.asarray(getattr(x, c))[ia], np.asarray(getattr(y, c))[ib]
            out[f"src_{c}"], out[f"dst_{c}"] = np.where(swap, cb, ca), np.where(swap, ca, cb)
        return pd.DataFrame(out)

    schema = f"src {ident}, dst {ident}, dist double" + "".join(
        f", {side}_{c} {t}" for side in ("src", "dst") for c, t in item.items())
    return visit(blocks, near_blocks(blocks, eps), pairs, schema)


def forest(links: np.ndarray) -> np.ndarray:
    """Label of each of n + m nodes of a bipartite graph (n x m booleans): the least node of its component."""
    n, m = links.shape
    label = np.full(n + m, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left = np.array([seed])
        while len(left):
            hit = np.flatnonzero(links[left].any(0))
            hit = hit[label[n + hit] < 0]
            label[n + hit] = seed
            left = np.flatnonzero(links[:, hit].any(1)) if len(hit) else hit
            left = left[label[left] < 0]
            label[left] = seed
    lone = np.flatnonzero(label < 0)
    label[lone] = lone
    return label
