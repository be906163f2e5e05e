"""Topological data analysis: PCA lens, Mapper, graph metrics, bars;
spanning forests are in ``forest``.

Mapper runs as *one* distributed job for all cubes: the cover emits
(id, cube) rows by arithmetic (no scan per cube), and DBSCAN takes the cube
as an extra key, so all cubes are clustered by the same joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.cluster import dbscan
from riskweave.operators.neighbors import components, spread_join, wide_join
from riskweave.session import cut_lineage


# F11 -------------------------------------------------------------------------------
def pca_project(df: DataFrame, k: int = 2, features: str = "features", out: str = "pc"):
    """Principal components via MLlib (distributed covariance), projected.

    MLlib's transform does not centre, so feed z-scores. Each axis' sign is
    fixed so its largest absolute loading is positive (deterministic).
    Returns (df with ``out`` array, explained-variance ratios, axes k x d).
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from riskweave.operators.neighbors import dot
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(F.col(features)).alias("_v")))
    axes = np.array(model.pc.toArray().T)  # writable copy for the sign fix
    for i in range(len(axes)):
        j = int(np.argmax(np.abs(axes[i])))
        if axes[i][j] < 0:
            axes[i] = -axes[i]
    proj = df.withColumn(out, F.array(*[dot(F.col(features), a) for a in axes]))
    return proj, [float(x) for x in model.explainedVariance.toArray()], axes


# T1 ----------------------------------------------------------------------------------
def cover_spec(df: DataFrame, lens: Sequence[str], n_cubes: int, overlap: float) -> list[dict]:
    """Per lens axis: start, step, half-width of the cubes (one min/max aggregate)."""
    row = df.agg(*[x for c in lens for x in (F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"))]).first()
    spec = []
    for c in lens:
        mn, mx = float(row[f"mn_{c}"]), float(row[f"mx_{c}"])
        rng = mx - mn
        inset = rng / (2 * n_cubes)
        start, stop = mn + inset, mx - inset
        step = (stop - start) / (n_cubes - 1) if n_cubes > 1 else 0.0
        spec.append({"col": c, "start": start, "step": step, "r": rng / (2 * n_cubes * (1 - overlap)),
                     "n": n_cubes})
    return spec


def cover(df: DataFrame, id_col: str, lens: Sequence[str], n_cubes: int = 15, overlap: float = 0.3,
          spec: list[dict] | None = None) -> DataFrame:
    """Rows (id, cube) for every hypercube containing the point.

    Centre i of an axis is start + i * step (start = min + R/2n, step so the
    last centre is max - R/2n); a point is in the cube when |x - c| <= r on
    every axis, r = R / (2n(1 - overlap)). Candidate indices come from
    arithmetic and are checked exactly; cube = row-major index over axes.
    """
    spec = spec or cover_spec(df, lens, n_cubes, overlap)
    out = df.select(id_col, *lens)
    cube = F.lit(0)
    for s in spec:
        x = F.col(s["col"])
        if s["step"] > 0:
            lo = F.greatest(F.floor((x - s["r"] - s["start"]) / s["step"]) - 1, F.lit(0))
            hi = F.least(F.ceil((x + s["r"] - s["start"]) / s["step"]) + 1, F.lit(s["n"] - 1))
        else:
            lo, hi = F.lit(0), F.lit(0)
        ix = f"_i_{s['col']}"
        out = out.withColumn(ix, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
        out = out.filter(F.abs(x - (F.lit(s["start"]) + F.col(ix) * F.lit(s["step"]))) <= F.lit(s["r"]))
        cube = cube * s["n"] + F.col(ix)
    return out.select(id_col, cube.cast("int").alias("cube"))


# T2 / T3 / T4 / T5 ---------------------------------------------------------------------
def mapper(df: DataFrame, id_col: str, lens: Sequence[str], n_cubes: int = 15, overlap: float = 0.3,
           eps: float = 0.5, min_samples: int = 5, features: str = "features") -> DataFrame:
    """Mapper members: (node_id, cube, id). DBSCAN per cube on the full
    features; noise dropped; node ``cube{c}_cluster{j}`` with j the cluster's
    rank inside its cube by least member id (bounded per cube)."""
    cov = cover(df, id_col, lens, n_cubes, overlap)
    pts = wide_join(cov, df.select(id_col, features), id_col)
    cl = dbscan(pts, id_col, eps, min_samples, features, by="cube")
    noise = F.lit(-1).cast(df.schema[id_col].dataType)
    mem = cut_lineage(cl.filter(F.col("cluster") != noise).select("cube", "cluster", id_col))
    nodes = mem.select("cube", "cluster").distinct().withColumn(
        "j", F.dense_rank().over(Window.partitionBy("cube").orderBy("cluster")) - 1)
    return (spread_join(mem, nodes, ["cube", "cluster"], id_col)
               .select(F.concat(F.lit("cube"), F.col("cube").cast("string"), F.lit("_cluster"),
                                F.col("j").cast("string")).alias("node_id"), "cube", id_col))


def nerve(members: DataFrame, id_col: str, min_intersection: int = 1) -> DataFrame:
    """Edges (src < dst) between nodes sharing >= min_intersection members.

    Self-join on the member id: a point lies in a bounded number of cubes
    (set by the overlap), so pairs per id are bounded too.
    """
    a = members.select(F.col("node_id").alias("src"), id_col)
    b = members.select(F.col("node_id").alias("dst"), id_col)
    return (wide_join(a, b, id_col).filter(F.col("src") < F.col("dst"))
             .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
             .filter(F.col("shared") >= min_intersection))


def node_rates(members: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    y = F.col(label_col).cast("int")
    return (wide_join(members, labels.select(id_col, label_col), id_col)
                   .groupBy("node_id").agg(F.count(F.lit(1)).alias("size"), F.avg(y.cast("double")).alias("tasa")))


def edge_rates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node_id", "tasa")
    near = wide_join(edges, n.withColumnRenamed("node_id", "src").withColumnRenamed("tasa", "t_src"), "src")
    return (wide_join(near, n.withColumnRenamed("node_id", "dst").withColumnRenamed("tasa", "t_dst"), "dst")
                 .select("src", "dst", ((F.col("t_src") + F.col("t_dst")) / 2).alias("tasa")))


# T6 / T9 -------------------------------------------------------------------------------
def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, components, isolated, share isolated, largest component,
    mean node size, nodes with rate > 0.5 / > 0.8, density 2m / (n (n-1))."""
    comp = components(nodes.select(F.col("node_id").alias("id")), edges, "id")
    deg = (edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v")))
                .distinct())
    ns = nodes.agg(F.count(F.lit(1)).alias("n_nodos"), F.avg("size").alias("tam_medio"),
                   F.count_if(F.col("tasa") > 0.5).alias("n_mora_50"),
                   F.count_if(F.col("tasa") > 0.8).alias("n_mora_80"))
    es = edges.agg(F.count(F.lit(1)).alias("n_aristas"))
    cs = (comp.groupBy("component").agg(F.count(F.lit(1)).alias("sz"))
              .agg(F.count(F.lit(1)).alias("n_componentes"), F.max("sz").alias("comp_principal")))
    iso = (nodes.join(deg, nodes["node_id"] == deg["v"], "left_anti").agg(F.count(F.lit(1)).alias("n_aislados")))
    j = ns.crossJoin(es).crossJoin(cs).crossJoin(iso)  # four one-row tables
    n = F.col("n_nodos")
    return j.select(
        "n_nodos", "n_aristas", "n_componentes", "n_aislados",
        (F.col("n_aislados") / F.greatest(n, F.lit(1))).alias("pct_aislados"),
        F.coalesce("comp_principal", F.lit(0)).alias("comp_principal"), "tam_medio", "n_mora_50", "n_mora_80",
        F.when(n > 1, 2.0 * F.col("n_aristas") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("densidad"))


def top_nodes(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` riskiest nodes (rate, then size, then id)."""
    return nodes.orderBy(F.col("tasa").desc(), F.col("size").desc(), F.col("node_id")).limit(k)


def node_overlap(members: DataFrame, id_col: str) -> DataFrame:
    """Share of ids present in two or more nodes (pct_solapamiento)."""
    per = members.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"))
    return per.agg((F.count_if(F.col("k") >= 2) * 1.0 / F.count(F.lit(1))).alias("pct_solapamiento"))


# T7 ------------------------------------------------------------------------------------
# The configurations compared.
SENSITIVITY_CONFIGS = [
    # name, n_cubes, overlap, eps, min_samples, lens
    ("A", 15, 0.3, 0.5, 5, "pca"),
    ("B", 8, 0.5, 0.5, 3, "pca"),
    ("C", 10, 0.6, 0.5, 3, "pca"),
    ("D", 10, 0.5, 1.0, 3, "pca"),
    ("E", 10, 0.5, 0.5, 3, "l2"),
]


def mapper_graph(df, id_col, lens, n_cubes, overlap, eps, min_samples, label_df, label_col,
                 features="features"):
    mem = mapper(df, id_col, lens, n_cubes, overlap, eps, min_samples, features)
    nodes = node_rates(mem, label_df, id_col, label_col)
    edges = nerve(mem, id_col)
    return mem, nodes, edges


def mapper_sensitivity(df: DataFrame, id_col: str, label_df: DataFrame, label_col: str,
                       configs=SENSITIVITY_CONFIGS, features: str = "features",
                       isolated_flag: float = 0.4) -> DataFrame:
    """Graph metrics per configuration (lens on the cached features), flagged
    when the isolated share exceeds ``isolated_flag``."""
    from riskweave.operators.features import l2_norm
    base = cut_lineage(df.select(id_col, features))
    proj, _, _ = pca_project(base, 2, features)
    proj = cut_lineage(proj.select(id_col, features, F.col("pc")[0].alias("l0"), F.col("pc")[1].alias("l1"),
                                   l2_norm(features).alias("l2")))
    out = None
    for name, nc, ov, eps, ms, lens in configs:
        lens_cols = ["l0", "l1"] if lens == "pca" else ["l2"]
        _, nodes, edges = mapper_graph(proj, id_col, lens_cols, nc, ov, eps, ms, label_df, label_col, features)
        m = graph_metrics(nodes, edges).select(F.lit(name).alias("config"), F.lit(nc).alias("n_cubes"),
                                               F.lit(ov).alias("overlap"), F.lit(eps).alias("eps"),
                                               F.lit(ms).alias("min_samples"), F.lit(lens).alias("lens"), "*")
        out = m if out is None else out.unionByName(m)
    return out.withColumn("fragmentado", F.col("pct_aislados") > isolated_flag)


# T10 / T11 -----------------------------------------------------------------------------
# The thresholds of the five rules.
def interpret_profile(pd_mean=None, volume=None, asnef_debt=None, limit=None, rate_pct=None) -> Column:
    """Rule list of a node/cluster profile as an array of codes (display text is the UI's)."""
    rules = []
    if pd_mean is not None:
        p = F.col(pd_mean) if isinstance(pd_mean, str) else pd_mean
        rules.append(F.when(p > 0.05, "pd_high").when(p > 0.02, "pd_moderate").when(p.isNotNull(), "pd_low"))
    if volume is not None:
        v = F.col(volume) if isinstance(volume, str) else volume
        rules.append(F.when(v < 5000, "volume_very_low").when(v < 50000, "volume_moderate")
                     .when(v.isNotNull(), "volume_high"))
    if asnef_debt is not None:
        d = F.col(asnef_debt) if isinstance(asnef_debt, str) else asnef_debt
        rules.append(F.when(d > 5000, "debt_high").when(d > 1000, "debt_moderate").when(d > 0, "debt_minimal")
                     .when(d.isNotNull(), "debt_none"))
    if limit is not None:
        lm = F.col(limit) if isinstance(limit, str) else limit
        rules.append(F.when(lm < 5000, "limit_restricted").when(lm < 50000, "limit_standard")
                     .when(lm.isNotNull(), "limit_wide"))
    if rate_pct is not None:
        r = F.col(rate_pct) if isinstance(rate_pct, str) else rate_pct
        rules.append(F.when(r > 25, "rate_very_high").when(r > 15, "rate_high").when(r > 5, "rate_watch")
                     .when(r > 0, "rate_healthy").otherwise("rate_zero"))
    return F.array_compact(F.array(*rules))


def risk_colour(rate_pct) -> Column:
    r = F.col(rate_pct) if isinstance(rate_pct, str) else rate_pct
    return F.when(r > 10, "red").when(r > 5, "orange").otherwise("green")


# V1 ------------------------------------------------------------------------------------
def distance_percentile(sample: DataFrame, id_col: str, q: float = 0.5, features: str = "features") -> DataFrame:
    """Percentile of pairwise distances of a bounded sample (self-join a < b).

    Pass a sample (e.g. ``uniform_sample``): the pair count is quadratic in
    the input, so this operator is not meant for whole tables.
    """
    from riskweave.operators.neighbors import sq_dist
    a = sample.select(F.col(id_col).alias("a"), F.col(features).alias("fa"))
    b = sample.select(F.col(id_col).alias("b"), F.col(features).alias("fb"))
    d = a.join(b, F.col("a") < F.col("b")).select(F.sqrt(sq_dist(F.col("fa"), F.col("fb"))).alias("d"))
    return d.agg(F.percentile("d", q).alias("distance"))


# V4 ------------------------------------------------------------------------------------
def top_bars(diagram: DataFrame, k: int = 5) -> DataFrame:
    """Longest finite bars by death - birth (infinite ones kept apart)."""
    fin = diagram.filter(~F.isnan("death") & (F.col("death") != float("inf")))
    return (fin.withColumn("length", F.col("death") - F.col("birth"))
               .orderBy(F.col("length").desc(), F.col("dim"), F.col("birth")).limit(k))
