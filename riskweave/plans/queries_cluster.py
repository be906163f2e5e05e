"""Registered queries: neighbours, clustering and cluster quality (N, G3, D1, K, H, M, A7-A10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import cluster as K
from riskweave.operators import features as FE
from riskweave.operators import hierarchy as H
from riskweave.operators import neighbors as N
from riskweave.operators import quality as Q
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register
from riskweave.session import cut_lineage

EMB_EPS, EMB_MIN = 1.18, 5
LOWD_EPS, LOWD_MIN = 0.5, 5


def lowd(spark, sf):
    """Six numeric customer columns, z-scored (population std), rounded to 6 places."""
    # materialise the customer columns once: the z-score statistics and every
    # later action (cover bounds, PCA axes, grid joins) read this copy
    cr = cut_lineage(T.customer_risk(spark, sf).select("cif_nif", "es_moroso", *FE.NUMERIC_FEATURES))
    z = FE.zscore(cr, FE.NUMERIC_FEATURES)
    z = z.withColumns({c: F.round(F.col(c), 6) for c in FE.NUMERIC_FEATURES})
    return FE.assemble(z, FE.NUMERIC_FEATURES).select(F.col("cif_nif").alias("id"),
                                                      F.col("es_moroso").alias("label"), "features")


def emb(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label",
                    F.col("embedding").cast("array<double>").alias("features"))


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@register("eps_join", O.with_testbed(
    f"SELECT a.id AS src, b.id AS dst, round(sqrt({O.d2_sql('a.f', 'b.f')}), 6) AS dist "
    f"FROM emb a JOIN emb b ON a.id < b.id WHERE {O.d2_sql('a.f', 'b.f')} <= {EMB_EPS} * {EMB_EPS}", O.EMB_CTE))
def q_eps_join(spark, sf):
    return N.eps_join(emb(spark, sf), "id", EMB_EPS).select("src", "dst", _r("dist"))


@register("connected_components", O.with_testbed("""
SELECT v AS id, min(r) AS component FROM reach GROUP BY v""", O.EMB_CTE + f""",
ep AS (SELECT a.id AS s, b.id AS d FROM emb a JOIN emb b ON a.id <> b.id
       WHERE {O.d2_sql('a.f', 'b.f')} <= {EMB_EPS} * {EMB_EPS}),
reach(v, r) AS (SELECT id, id FROM emb UNION SELECT ep.d, reach.r FROM reach JOIN ep ON reach.v = ep.s)"""))
def q_connected_components(spark, sf):
    e = emb(spark, sf)
    edges = N.eps_join(e, "id", EMB_EPS)
    return N.connected_components(e.select("id"), edges, "id")


@register("dbscan", O.with_risk("SELECT * FROM dres", O.LOWD_CTE + "," + O.dbscan_sql("lowd", LOWD_EPS, LOWD_MIN, "'-1'")))
def q_dbscan(spark, sf):
    return K.dbscan(lowd(spark, sf), "id", LOWD_EPS, LOWD_MIN)


@register("dbscan_embeddings", O.with_testbed("SELECT * FROM dres",
                                              O.EMB_CTE + "," + O.dbscan_sql("emb", EMB_EPS, EMB_MIN, "-1")))
def q_dbscan_embeddings(spark, sf):
    return K.dbscan(emb(spark, sf), "id", EMB_EPS, EMB_MIN)


_INIT_K = 10
_LLOYD_CTES = O.EMB_CTE + f""",
init AS (SELECT f AS cf, row_number() OVER (ORDER BY id) - 1 AS c FROM emb QUALIFY c < {_INIT_K}),
asg AS (SELECT id, f, c FROM (SELECT e.id, e.f, i.c, row_number() OVER (PARTITION BY e.id ORDER BY
          {O.d2_sql('e.f', 'i.cf')}, i.c) AS rn FROM emb e, init i) t WHERE rn = 1),
dims AS (SELECT c, p, avg(f[p]) AS m, count(*) AS n FROM asg, range(1, 65) r(p) GROUP BY c, p)"""


def _first_k_centres(e, k):
    rows = e.orderBy("id").limit(k).collect()
    return np.array([r["features"] for r in rows], dtype=float)


@register("lloyd_step", O.with_testbed(
    "SELECT CAST(c AS INTEGER) AS cluster, CAST(max(n) AS BIGINT) AS n, list(round(m, 6) ORDER BY p) AS centroid "
    "FROM dims GROUP BY c", _LLOYD_CTES))
def q_lloyd_step(spark, sf):
    e = emb(spark, sf)
    out = K.lloyd_step(e, _first_k_centres(e, _INIT_K))
    return out.select("cluster", "n", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


_LAB_CENT = O.EMB_CTE + """,
lc AS (SELECT label, p, avg(f[p]) AS m, count(*) AS n FROM emb, range(1, 65) r(p) GROUP BY label, p),
cent AS (SELECT label, list(m ORDER BY p) AS c, max(n) AS n FROM lc GROUP BY label)"""


@register("wcss", O.with_testbed(
    f"SELECT round(sum({O.d2_sql('e.f', 'c.c')}), 6) AS wcss FROM emb e JOIN cent c ON e.label = c.label",
    _LAB_CENT))
def q_wcss(spark, sf):
    return K.wcss(emb(spark, sf), "label").select(_r("wcss"))


@register("nearest_labelled", O.with_testbed(f"""
SELECT id, label, nearest_id FROM (
  SELECT e.id, c.label AS label, c.label AS nearest_id,
         row_number() OVER (PARTITION BY e.id ORDER BY round({O.d2_sql('e.f', 'c.c')}, 9), c.label) AS rn
  FROM emb e, cent c) t WHERE rn = 1""", _LAB_CENT))
def q_nearest_labelled(spark, sf):
    e = emb(spark, sf)
    cents = K.centroids(e, "label").select(F.col("label").alias("sid"), "label",
                                           F.col("centroid").alias("features"))
    return N.nearest_labelled(e, cents, "id", "label", sample_id="sid").select(
        "id", "label", F.col("nearest_id").cast("int").alias("nearest_id"))


@register("silhouette", O.with_testbed("""
SELECT round(avg(s), 6) AS silhouette, CAST(count(*) AS BIGINT) AS n_evaluated, false AS sampled FROM (
  SELECT id, CASE WHEN n_own <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM (
    SELECT id, max(CASE WHEN same THEN cnt END) AS n_own,
           max(CASE WHEN same THEN sm END) / (max(CASE WHEN same THEN cnt END) - 1) AS a,
           min(CASE WHEN NOT same THEN sm / cnt END) AS b
    FROM (SELECT x.id, y.label = x.label AS same, y.label, sum(sqrt(""" + O.d2_sql('x.f', 'y.f') + """)) AS sm,
                 count(*) AS cnt
          FROM emb x JOIN emb y ON true GROUP BY x.id, x.label, y.label) t GROUP BY id) u) v""", O.EMB_CTE))
def q_silhouette(spark, sf):
    return Q.silhouette(emb(spark, sf), "label").select(_r("silhouette"), "n_evaluated", "sampled")


@register("davies_bouldin", O.with_testbed(f"""
SELECT round(avg(r), 6) AS davies_bouldin FROM (
  SELECT a.label, max((a.s + b.s) / sqrt({O.d2_sql('a.c', 'b.c')})) AS r
  FROM sc a JOIN sc b ON a.label <> b.label GROUP BY a.label) t""", _LAB_CENT + f""",
sc AS (SELECT c.label, c.c, avg(sqrt({O.d2_sql('e.f', 'c.c')})) AS s FROM emb e JOIN cent c ON e.label = c.label
       GROUP BY c.label, c.c)"""))
def q_davies_bouldin(spark, sf):
    return Q.davies_bouldin(emb(spark, sf), "label").select(_r("davies_bouldin"))


@register("calinski_harabasz", O.with_testbed(f"""
SELECT round((SELECT sum(n * {O.d2_sql('c', 'g')}) FROM cent, gcent) /
             (SELECT sum({O.d2_sql('e.f', 'c.c')}) FROM emb e JOIN cent c ON e.label = c.label) *
             (((SELECT count(*) FROM emb) - (SELECT count(*) FROM cent)) / ((SELECT count(*) FROM cent) - 1)), 6)
  AS calinski_harabasz""", _LAB_CENT + """,
gl AS (SELECT p, avg(f[p]) AS m FROM emb, range(1, 65) r(p) GROUP BY p),
gcent AS (SELECT list(m ORDER BY p) AS g FROM gl)"""))
def q_calinski_harabasz(spark, sf):
    return Q.calinski_harabasz(emb(spark, sf), "label").select(_r("calinski_harabasz"))


@register("rate_by_group", O.with_risk("""
SELECT provincia, CAST(count(*) AS BIGINT) AS n_total, CAST(sum(CAST(es_moroso AS INT)) AS BIGINT) AS n_morosos,
       round(avg(CAST(es_moroso AS INT)), 6) AS tasa FROM crc GROUP BY provincia""", O.clean_cte()))
def q_rate_by_group(spark, sf):
    from riskweave.plans.queries_features import customers_clean
    return Q.rate_by_group(customers_clean(spark, sf), "provincia", "es_moroso").select(
        "provincia", "n_total", "n_morosos", _r("tasa"))


@register("cluster_sizes", O.with_testbed("""
SELECT label, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM emb), 6) AS pct
FROM emb GROUP BY label ORDER BY n DESC, label LIMIT 10""", O.EMB_CTE))
def q_cluster_sizes(spark, sf):
    return Q.cluster_sizes(emb(spark, sf), "label", 10).select("label", "n", _r("pct"))


@register("quantiles_by_group", O.with_risk("""
SELECT es_moroso, variable, CAST(count(*) FILTER (WHERE value > 0) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE NOT (value > 0) OR value IS NULL) AS BIGINT) AS n_dropped,
  round(count(*) FILTER (WHERE NOT (value > 0) OR value IS NULL) * 100.0 / count(*), 6) AS pct_dropped,
  round(quantile_cont(value, 0.25) FILTER (WHERE value > 0), 6) AS p25,
  round(quantile_cont(value, 0.5) FILTER (WHERE value > 0), 6) AS p50,
  round(quantile_cont(value, 0.75) FILTER (WHERE value > 0), 6) AS p75
FROM (UNPIVOT (SELECT es_moroso, CAST(saldo_pendiente_total AS DOUBLE) AS saldo_pendiente_total,
                      CAST(n_facturas_totales AS DOUBLE) AS n_facturas_totales,
                      CAST(n_facturas_vencidas AS DOUBLE) AS n_facturas_vencidas FROM customer_risk)
      ON saldo_pendiente_total, n_facturas_totales, n_facturas_vencidas INTO NAME variable VALUE value)
GROUP BY es_moroso, variable"""))
def q_quantiles_by_group(spark, sf):
    cols = ["saldo_pendiente_total", "n_facturas_totales", "n_facturas_vencidas"]
    cr = T.customer_risk(spark, sf).select("es_moroso", *[F.col(c).cast("double").alias(c) for c in cols])
    out = Q.quantiles_by_group(cr, cols, "es_moroso", positive_only=True)
    return out.select("es_moroso", "variable", "n", "n_dropped", _r("pct_dropped"), _r("p25"), _r("p50"), _r("p75"))


_BOX = """
SELECT b.tipo, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
  round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS whislo,
  round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS whishi,
  CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_fliers
FROM bx b JOIN bq q ON b.tipo = q.tipo GROUP BY b.tipo, q1, med, q3"""
_BOX_CTES = """bx AS (SELECT tipo, CAST(saldo_pendiente_total AS DOUBLE) AS x FROM customer_risk),
bq AS (SELECT tipo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
       FROM bx GROUP BY tipo)"""


@register("box_stats", O.with_risk(_BOX, _BOX_CTES))
def q_box_stats(spark, sf):
    cr = T.customer_risk(spark, sf).select("tipo", F.col("saldo_pendiente_total").cast("double").alias("x"))
    out = Q.box_stats(cr, "x", "tipo")
    return out.select("tipo", *[_r(c) for c in ("q1", "med", "q3", "whislo", "whishi")], "n_fliers")


@register("profile_stats", O.with_risk("""
SELECT tipo, variable AS feature, round(avg(value), 6) AS mean, round(min(value), 6) AS min,
       round(max(value), 6) AS max
FROM (UNPIVOT (SELECT tipo, CAST(saldo_pendiente_total AS DOUBLE) AS saldo_pendiente_total,
                      CAST(dias_mora_maximo AS DOUBLE) AS dias_mora_maximo FROM customer_risk)
      ON saldo_pendiente_total, dias_mora_maximo INTO NAME variable VALUE value)
GROUP BY tipo, variable"""))
def q_profile_stats(spark, sf):
    cr = T.customer_risk(spark, sf).select("tipo", F.col("saldo_pendiente_total").cast("double").alias(
        "saldo_pendiente_total"), F.col("dias_mora_maximo").cast("double").alias("dias_mora_maximo"))
    out = Q.profile_stats(cr, "tipo", ["saldo_pendiente_total", "dias_mora_maximo"])
    return out.select("tipo", "feature", _r("mean"), _r("min"), _r("max"))


@register("distinct_count", O.with_testbed(
    "SELECT CAST(count(DISTINCT trim(upper(vat))) AS BIGINT) AS n_distinct FROM tb_customers WHERE trim(vat) <> ''"))
def q_distinct_count(spark, sf):
    from riskweave.functions.exprs import normalise_id
    c = T.customers(spark, sf).filter(F.trim("vat_registration_no_") != "")
    return Q.distinct_count(c.select(normalise_id("vat_registration_no_").alias("cif")), "cif")


# Rates per DBSCAN cluster, top-k risky clusters (noise dropped first), pure clusters.
_DB_RATES = O.EMB_CTE + "," + O.dbscan_sql("emb", EMB_EPS, EMB_MIN, "-1") + """,
drates AS (SELECT r.cluster, CAST(count(*) AS BIGINT) AS n_total, CAST(sum(CAST(e.label < 5 AS INT)) AS BIGINT)
                  AS n_morosos, avg(CAST(e.label < 5 AS INT)) AS tasa
           FROM dres r JOIN emb e ON r.id = e.id GROUP BY r.cluster)"""


def _db_rates(spark, sf):
    e = emb(spark, sf)
    lab = N.wide_join(K.dbscan(e, "id", EMB_EPS, EMB_MIN), e.select("id", (F.col("label") < 5).alias("y")), "id")
    return Q.rate_by_group(lab, "cluster", "y")


@register("top_k_groups", O.with_testbed(
    "SELECT cluster, n_total, n_morosos, round(tasa, 6) AS tasa FROM drates WHERE cluster <> -1 "
    "ORDER BY tasa DESC, cluster LIMIT 3", _DB_RATES))
def q_top_k_groups(spark, sf):
    return Q.top_k_groups(_db_rates(spark, sf), "cluster", 3).select("cluster", "n_total", "n_morosos", _r("tasa"))


@register("pure_groups", O.with_testbed(
    "SELECT cluster, n_total, n_morosos, round(tasa, 6) AS tasa FROM drates WHERE tasa = 1.0 AND cluster <> -1 "
    "ORDER BY n_total DESC, cluster LIMIT 5", _DB_RATES))
def q_pure_groups(spark, sf):
    return Q.pure_groups(_db_rates(spark, sf), "cluster", 5).select("cluster", "n_total", "n_morosos", _r("tasa"))


# Iterative / randomised ones: brute-force checked in pytest, rows-only here.
@register("kmeans")
def q_kmeans(spark, sf):
    assign, _, _ = K.kmeans(lowd(spark, sf), "id", 10, seed=42, n_init=10)
    return assign


@register("elbow")
def q_elbow(spark, sf):
    return K.elbow(lowd(spark, sf), "id", range(2, 31), n_init=10)


@register("elbow_choice")
def q_elbow_choice(spark, sf):
    return K.elbow_choice(K.elbow(lowd(spark, sf), "id", range(2, 31), n_init=10))


def _customer_tree(spark, sf):
    return H.ward_tree(lowd(spark, sf), "id")


@register("ward")
def q_ward(spark, sf):
    return _customer_tree(spark, sf).labels(5)


@register("merge_tree")
def q_merge_tree(spark, sf):
    return _customer_tree(spark, sf).merges.drop("equal_rows")


@register("cut_height")
def q_cut_height(spark, sf):
    return _customer_tree(spark, sf).cut_height(5)


@register("pca")
def q_pca(spark, sf):
    from riskweave.operators.topology import pca_project
    proj, _, _ = pca_project(lowd(spark, sf), 2)
    return proj.select("id", F.round(F.col("pc")[0], 6).alias("pc1"), F.round(F.col("pc")[1], 6).alias("pc2"))


@register("connected_components_chain", """
WITH v AS (SELECT DISTINCT l_suppkey AS s, l_suppkey * 10000000000 + l_orderkey AS id FROM lineitem)
SELECT id, min(id) OVER (PARTITION BY s) AS component FROM v""")
def q_connected_components_chain(spark, sf):
    """Long paths: the orders of each supplier, chained in md5 order."""
    from pyspark.sql import Window
    v = (spark.read.parquet(f"{sf}/lineitem.parquet")
              .select(F.col("l_suppkey").alias("s"), (F.col("l_suppkey") * F.lit(10_000_000_000) + F.col("l_orderkey")).alias("id"))
              .distinct())
    order = Window.partitionBy("s").orderBy(F.md5(F.col("id").cast("string")))
    edges = v.withColumn("dst", F.lead("id").over(order)).filter("dst is not null").select(F.col("id").alias("src"), "dst")
    return N.connected_components(v.select("id"), edges, "id")
