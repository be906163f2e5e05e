"""Group rates, sizes, quantiles and cluster-quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Frequency of each non-null value, count desc then value asc."""
    out = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
             .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("value")))
    return out.limit(n) if n is not None else out


# A7 / A8 / A13 / A14 -------------------------------------------------------------
def rate_by_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """n_total, n_morosos, tasa per group, rate desc then group asc."""
    y = F.col(label).cast("int")
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("n_total"), F.sum(y).cast("long").alias("n_morosos"),
                                  F.avg(y.cast("double")).alias("tasa"))
              .orderBy(F.col("tasa").desc(), F.col(group)))


def rate_summary(rates: DataFrame) -> DataFrame:
    """Global (weighted), max, min rate and range over a rate_by_group table."""
    return rates.agg((F.sum("n_morosos") / F.sum("n_total")).alias("tasa_global"),
                     F.max("tasa").alias("tasa_max"), F.min("tasa").alias("tasa_min"),
                     (F.max("tasa") - F.min("tasa")).alias("rango"))


def cluster_sizes(df: DataFrame, group: str, top: int | None = 10) -> DataFrame:
    """Size and share of total per group, largest first (group breaks ties)."""
    total = df.agg(F.count(F.lit(1)).alias("_tot"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = (sizes.crossJoin(F.broadcast(total))  # one-row table
                .select(group, "n", (F.col("n") * 100.0 / F.col("_tot")).alias("pct"))
                .orderBy(F.col("n").desc(), F.col(group)))
    return out.limit(top) if top else out


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Nunique (nulls excluded); HyperLogLog only when asked for."""
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(f.alias("n_distinct"))


def profile_stats(members: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Per group and feature: mean, min, max (unpivot then one aggregate)."""
    long = members.unpivot([group], features, "feature", "value")
    return long.groupBy(group, "feature").agg(F.avg("value").alias("mean"), F.min("value").alias("min"),
                                               F.max("value").alias("max"))


# A9 / A10 -----------------------------------------------------------------------------
def quantiles_by_group(df: DataFrame, cols: list[str], group: str, positive_only: bool = False,
                       probs=(0.25, 0.5, 0.75), approx: int | None = None) -> DataFrame:
    """P25/P50/P75 (linear interpolation, as numpy) per group and column.

    With ``positive_only`` only values > 0 count, and the dropped count and
    share are reported. Exact, unless ``approx`` gives a sketch accuracy
    (see ``ranks.quantiles``). Long output: (group, variable, n, n_dropped,
    pct_dropped, p25, p50, p75).
    """
    from riskweave.operators.ranks import quantiles
    long = df.unpivot([group], cols, "variable", "value").withColumn("value", F.col("value").cast("double"))
    keep = (F.col("value") > 0) if positive_only else F.col("value").isNotNull()
    dropped = F.count_if(~keep | F.col("value").isNull())
    counts = long.groupBy(group, "variable").agg(
        F.count_if(keep).alias("n"), dropped.alias("n_dropped"), (dropped * 100.0 / F.count(F.lit(1))).alias("pct_dropped"))
    q = quantiles(long.filter(keep), [group, "variable"], "value", probs, approx)
    # one row per group and column on both sides; a null group has its row too
    key = F.struct(group, "variable")
    return (counts.withColumn("_g", key).join(q.select(key.alias("_g"), "q"), "_g", "left")
            .select(group, "variable", "n", "n_dropped", "pct_dropped",
                    *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(probs)]))


def box_stats(df: DataFrame, col: str, group: str, whis: float = 1.5, approx: int | None = None) -> DataFrame:
    """A10: quartiles, whiskers (furthest values within whis*IQR) and flier count.

    Whiskers and fliers are read from the distinct values of each group with their
    counts; a group's values are spread over several tasks."""
    from riskweave.operators.neighbors import spread_join
    from riskweave.operators.ranks import quantiles
    data = df.select(F.struct(F.col(group).alias("v")).alias("_g"), F.col(col).cast("double").alias("_x"))
    q = quantiles(data, ["_g"], "_x", (0.25, 0.5, 0.75), approx).select(
        "_g", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))
    every = data.select("_g").distinct().join(q, "_g", "left")
    runs = data.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_c"))
    lo = F.col("q1") - whis * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + whis * (F.col("q3") - F.col("q1"))
    return (spread_join(runs, every, ["_g"], "_x").groupBy("_g", "q1", "med", "q3").agg(
        F.min(F.when(F.col("_x") >= lo, F.col("_x"))).alias("whislo"),
        F.max(F.when(F.col("_x") <= hi, F.col("_x"))).alias("whishi"),
        F.coalesce(F.sum(F.when((F.col("_x") < lo) | (F.col("_x") > hi), F.col("_c"))), F.lit(0)).alias("n_fliers"))
        .select(F.col("_g.v").alias(group), "q1", "med", "q3", "whislo", "whishi", "n_fliers"))


# O2 / O3 ------------------------------------------------------------------------------
def top_k_groups(rates: DataFrame, group: str, k: int = 3, exclude_noise: bool = True,
                 noise=-1) -> DataFrame:
    """O2: top-k groups by rate; noise is dropped *before* the limit."""
    r = rates.filter(F.col(group) != F.lit(noise)) if exclude_noise else rates
    return r.orderBy(F.col("tasa").desc(), F.col(group)).limit(k)


def pure_groups(rates: DataFrame, group: str, k: int = 5, noise=-1) -> DataFrame:
    """O3: groups whose rate is exactly 1.0, non-noise, top k (largest first)."""
    return (rates.filter((F.col("tasa") == 1.0) & (F.col(group) != F.lit(noise)))
                 .orderBy(F.col("n_total").desc(), F.col(group)).limit(k))


# M1-M4 --------------------------------------------------------------------------------
def silhouette(df: DataFrame, label: str, features: str = "features", noise=None,
               sample_ids: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """M1: mean silhouette, plain Euclidean distance (MLlib's is squared).

    Equal (label, vector) rows collapse to one weighted point. Points are
    range-partitioned by label and packed into blocks of 1024; every pair of
    blocks gives, per evaluated point and cluster, the sum of distances and
    the row count, never the pairs. An aggregate adds them up; a and b follow
    exactly, singletons score 0; fewer than 2 clusters -> null.

    All rows are evaluated, against all rows, unless the caller passes
    ``sample_ids`` (with ``id_col``): the work is evaluated points x points.
    Rows with a null label or vector and rows labelled ``noise`` are left
    out. Output: one row (silhouette, n_evaluated, sampled).
    """
    import numpy as np
    import pandas as pd
    from riskweave.operators.neighbors import _sq_block, block_matrix, pack_blocks, pair_blocks

    def blocks(rows: DataFrame) -> DataFrame:
        pts = rows.select(label, features).filter(F.col(label).isNotNull() & F.col(features).isNotNull())
        if noise is not None:
            pts = pts.filter(F.col(label) != F.lit(noise))
        u = pts.groupBy(label, features).agg(F.count(F.lit(1)).alias("w"))
        u = u.withColumn("_h", F.xxhash64(features)).repartitionByRange(label, "_h").sortWithinPartitions(label, "_h")
        return pack_blocks(u, "_h", label, features, "w")

    targets = blocks(df)
    evaluated = targets if sample_ids is None else blocks(df.join(sample_ids, id_col, "left_semi"))
    lab_type = df.schema[label].dataType.simpleString()

    def partial(x, y):
        D = np.sqrt(_sq_block(block_matrix(x), block_matrix(y))) * np.asarray(y.weights, dtype=float)
        labs, w = pd.Series(y.labels), np.asarray(y.weights)
        out = []
        for lv in labs.unique():
            at = (labs == lv).to_numpy()
            out.append(pd.DataFrame({"blk": x.blk, "pos": np.arange(len(D)), "own": x.labels, "w": x.weights,
                                     "lab": lv, "s": D[:, at].sum(axis=1), "c": int(w[at].sum())}))
        return pd.concat(out)

    sums = (pair_blocks(evaluated, targets, partial,
                        f"blk long, pos int, own {lab_type}, w long, lab {lab_type}, s double, c long")
            .groupBy("blk", "pos", "own", "w", "lab").agg(F.sum("s").alias("s"), F.sum("c").alias("c")))
    mine = F.col("lab") == F.col("own")
    per = sums.groupBy("blk", "pos", "w").agg(
        F.max(F.when(mine, F.col("c"))).alias("n_own"), F.max(F.when(mine, F.col("s"))).alias("s_own"),
        F.min(F.when(~mine, F.col("s") / F.col("c"))).alias("b"))
    a = F.col("s_own") / F.nullif(F.col("n_own") - 1, F.lit(0))
    wider = F.greatest(a, F.col("b"))
    s = F.when((F.col("n_own") <= 1) | (wider == 0), F.lit(0.0)).otherwise((F.col("b") - a) / wider)
    return per.agg(
        F.when(F.count("b") > 0, F.sum(s * F.col("w")) / F.sum("w")).alias("silhouette"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("n_evaluated")).withColumn("sampled", F.lit(sample_ids is not None))


def group_moments(df: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """(keys, n, mean, ss): size, mean vector and squared distance to the mean of every group, by one
    aggregate with partial sums; only one row per group is shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = Summarizer.metrics("count", "mean", "variance").summary(F.col("_v"))
    rows = df.select(*keys, array_to_vector(F.col(features)).alias("_v"))
    m = rows.groupBy(*keys).agg(parts.alias("m"))
    spread = F.aggregate(vector_to_array(F.col("m.variance")), F.lit(0.0), lambda a, v: a + v)
    return m.select(*keys, F.col("m.count").alias("n"), vector_to_array(F.col("m.mean")).alias("mean"),
                    (spread * (F.col("m.count") - 1)).alias("ss"))


def _without_noise(df: DataFrame, label: str, noise) -> DataFrame:
    return df if noise is None else df.filter(F.col(label) != F.lit(noise))


def davies_bouldin(df: DataFrame, label: str, features: str = "features", noise=None) -> DataFrame:
    """M2: mean over clusters of max_j (S_i + S_j) / d(c_i, c_j); S = mean distance to centroid.

    Rows meet their centroid on a salted key; centroids meet each other in blocks."""
    import numpy as np
    import pandas as pd
    from riskweave.operators.blocks import sq_matrix
    from riskweave.operators.neighbors import block_matrix, pack_blocks, pair_blocks, spread_join, sq_dist, vector_dim
    pts = _without_noise(df.select(label, features), label, noise).filter(F.col(label).isNotNull())
    c = group_moments(pts, [label], features).select(label, "mean")
    s = (spread_join(pts, c, [label], features)
         .groupBy(label).agg(F.avg(F.sqrt(sq_dist(F.col(features), F.col("mean"), vector_dim(pts, features)))).alias("S")))
    cs = pack_blocks(c.join(s, label), label, "S", "mean")
    ltype = df.schema[label].dataType.simpleString()

    def worst(x, y):
        d = np.sqrt(sq_matrix(block_matrix(x), block_matrix(y)))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (np.asarray(x.labels)[:, None] + np.asarray(y.labels)[None, :]) / d
        if x.blk == y.blk:
            np.fill_diagonal(r, -np.inf)
        return pd.DataFrame({"i": x.ids, "r": r.max(1)})

    r = pair_blocks(cs, cs, worst, f"i {ltype}, r double").groupBy("i").agg(F.max("r").alias("r"))
    return r.filter(F.col("r") > F.lit(float("-inf"))).agg(F.avg("r").alias("davies_bouldin"))


def within_between(moments: DataFrame, by: list[str]) -> DataFrame:
    """(by, ssw, ssb, k, n): sums of squares within and between groups, from ``group_moments``."""
    dims = moments.select(*by, "n", F.posexplode("mean").alias("p", "x"))
    between = (dims.groupBy(*by, "p").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("x")).alias("s"),
                                          F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q"))
               .groupBy(*by).agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("t")).alias("ssb")))
    within = moments.groupBy(*by).agg(F.sum("ss").alias("ssw"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return within.join(between, by) if by else within.crossJoin(between)          # two one-row tables


def calinski_harabasz(df: DataFrame, label: str, features: str = "features", noise=None) -> DataFrame:
    """M3: (SSB / SSW) * ((n - k) / (k - 1)), from one aggregate per group."""
    m = group_moments(_without_noise(df.select(label, features), label, noise).filter(F.col(label).isNotNull()), [label], features)
    return within_between(m, []).select(
        (F.col("ssb") / F.nullif("ssw", F.lit(0.0)) * ((F.col("n") - F.col("k")) / F.nullif(F.col("k") - 1, F.lit(0)))).alias("calinski_harabasz"))
