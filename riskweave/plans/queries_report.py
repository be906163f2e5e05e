"""Registered queries: predictive scoring, reports, alerts, split layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import cluster as K
from riskweave.operators import features as FE
from riskweave.operators import report as RP
from riskweave.operators import topology as TP
from riskweave.operators.neighbors import wide_join
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register
from riskweave.plans.queries_cluster import LOWD_EPS, LOWD_MIN, lowd
from riskweave.session import cut_lineage
from riskweave.sources.io import read_split_layout
from riskweave.streaming import alerts as AL


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@register("label_balance", O.with_risk(
    "SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(sum(CAST(es_moroso AS INT)) AS BIGINT) AS n_morosos, "
    "round(avg(CAST(es_moroso AS INT)) * 100, 6) AS pct_morosos FROM customer_risk"))
def q_label_balance(spark, sf):
    return RP.label_balance(T.customer_risk(spark, sf), "es_moroso").select("n_total", "n_morosos", _r("pct_morosos"))


_DB_LOWD = O.LOWD_CTE + "," + O.dbscan_sql("lowd", LOWD_EPS, LOWD_MIN, "'-1'")


@register("cluster_as_classifier", O.with_risk("""
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) END, 6) AS recall,
       round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2 * (tp * 1.0 / (tp + fp)) * (tp * 1.0 / (tp + fn)) /
             ((tp * 1.0 / (tp + fp)) + (tp * 1.0 / (tp + fn))) END, 6) AS f1_score
FROM (SELECT count(*) FILTER (WHERE pred AND y = 1) AS tp, count(*) FILTER (WHERE pred AND y = 0) AS fp,
             count(*) FILTER (WHERE NOT pred AND y = 1) AS fn
      FROM (SELECT CAST(l.label AS INT) AS y, (CASE WHEN r.cluster = '-1' THEN 0.0 ELSE g.rate END) > 0.5 AS pred
            FROM dres r JOIN lowd l ON r.id = l.id JOIN grates g ON r.cluster = g.cluster) a) b""",
    _DB_LOWD + ", grates AS (SELECT r.cluster, avg(CAST(l.label AS INT)) AS rate FROM dres r JOIN lowd l "
               "ON r.id = l.id GROUP BY r.cluster)"))
def q_cluster_as_classifier(spark, sf):
    d = lowd(spark, sf)
    lab = wide_join(K.dbscan(d, "id", LOWD_EPS, LOWD_MIN), d.select("id", "label"), "id")
    out = RP.cluster_as_classifier(lab, "cluster", "label", 0.5, noise="-1")
    return out.select("tp", "fp", "fn", _r("precision"), _r("recall"), _r("f1_score"))


_TF_CTES = O.ZSR_CTE + ", zl AS (UNPIVOT (SELECT tipo, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END) AS {c}"
    for c in O.NUMERIC6) + " FROM customer_risk, zsr) ON " + ", ".join(O.NUMERIC6) + " INTO NAME feature VALUE value)"


@register("top_features", O.with_risk("""
SELECT tipo, feature, round(mean, 6) AS mean, CAST(rank AS INTEGER) AS rank FROM (
  SELECT tipo, feature, mean, row_number() OVER (PARTITION BY tipo ORDER BY abs(mean) DESC, feature) AS rank
  FROM (SELECT tipo, feature, avg(value) AS mean FROM zl GROUP BY tipo, feature) t) u WHERE rank <= 3""", _TF_CTES))
def q_top_features(spark, sf):
    cr = T.customer_risk(spark, sf).select("tipo", *FE.NUMERIC_FEATURES)
    z = FE.zscore(cr, FE.NUMERIC_FEATURES)
    top = RP.top_features(z, "tipo", FE.NUMERIC_FEATURES, 3)
    return top.select("tipo", "feature", _r("mean"), F.col("rank").cast("int").alias("rank"))


_ALERT_CTES = _DB_LOWD + f""",
arates AS (SELECT r.cluster, avg(CAST(l.label AS INT)) AS tasa FROM dres r JOIN lowd l ON r.id = l.id
           WHERE r.cluster <> '-1' GROUP BY r.cluster),
acores AS (SELECT r.id AS core_id, l.f, r.cluster, a.tasa FROM dres r JOIN lowd l ON r.id = l.id
           JOIN arates a ON r.cluster = a.cluster WHERE r.is_core),
anear AS (SELECT id, cluster, tasa, d2 FROM (
            SELECT n.id, c.cluster, c.tasa, {O.d2_sql('n.f', 'c.f')} AS d2,
                   row_number() OVER (PARTITION BY n.id ORDER BY {O.d2_sql('n.f', 'c.f')}, c.core_id) AS rn
            FROM lowd n JOIN acores c ON {O.d2_sql('n.f', 'c.f')} <= {LOWD_EPS} * {LOWD_EPS}) t WHERE rn = 1)"""
_LEVEL = "CASE WHEN a.tasa IS NULL THEN 'revisar' WHEN a.tasa > 0.5 THEN 'alto' WHEN a.tasa >= 0.1 THEN 'medio' ELSE 'bajo' END"


@register("risk_alerts", O.with_risk(f"""
SELECT l.id, a.cluster, round(a.tasa, 6) AS tasa, {_LEVEL} AS nivel,
       CASE {_LEVEL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in AL.ACTIONS.items())} END AS accion,
       round(sqrt(a.d2), 6) AS distance
FROM lowd l LEFT JOIN anear a ON l.id = a.id""", _ALERT_CTES))
def q_risk_alerts(spark, sf):
    d = lowd(spark, sf)
    model = AL.fit_alert_model(d, "id", "label", None, LOWD_EPS, LOWD_MIN)
    out = AL.risk_alerts(d, model, "id")
    return out.select("id", "cluster", _r("tasa"), "nivel", "accion", _r("distance"))


@register("read_split_layout", O.with_risk("SELECT * FROM customer_risk"))
def q_read_split_layout(spark, sf):
    cr = T.customer_risk(spark, sf)
    return read_split_layout(positives=cr.filter("es_moroso"), negatives=cr.filter("NOT es_moroso"))


@register("explained_variance")
def q_explained_variance(spark, sf):
    _, ratios, _ = TP.pca_project(lowd(spark, sf), 2)
    return RP.explained_variance(ratios)


@register("projected_centroids")
def q_projected_centroids(spark, sf):
    proj, _, _ = TP.pca_project(lowd(spark, sf), 2)
    return RP.projected_centroids(proj, "label")


METHODS = ["dbscan", "hierarchical", "kmeans", "mapper"]


def _four_methods(spark, sf):
    """Metrics of K-Means, DBSCAN, Ward (five clusters) and Mapper on one copy of the customers."""
    from riskweave.operators import hierarchy as H
    from riskweave.plans.queries_topology import mapper_members
    d = cut_lineage(lowd(spark, sf))
    km, _, _ = K.kmeans(d, "id", 10, n_init=10)
    db = K.dbscan(d, "id", LOWD_EPS, LOWD_MIN).select("id", "cluster")
    ward = H.ward_tree(d, "id").labels(5)
    nodes = mapper_members(d).select("id", "node_id")
    stacked = cut_lineage(RP.stack_labelings({"kmeans": km, "dbscan": db, "hierarchical": ward, "mapper": nodes}, {"dbscan": "-1"}))
    return d, cut_lineage(RP.predictive_metrics(stacked, d, "label")
                          .unionByName(RP.quality_metrics(stacked, d, ["dbscan", "hierarchical", "kmeans"])))


@register("method_comparison")
def q_method_comparison(spark, sf):
    return RP.method_comparison(_four_methods(spark, sf)[1], METHODS)


@register("executive_summary")
def q_executive_summary(spark, sf):
    d, metrics = _four_methods(spark, sf)
    return RP.executive_summary(RP.label_balance(d, "label"), metrics)


# The same tables for labelings that SQL can make: DBSCAN, the letter of the id, and a cover of
# the first feature by overlapping unit intervals.
def _fixed_methods(spark, sf):
    d = cut_lineage(lowd(spark, sf))
    x = F.col("features")[0]
    cover = d.select("id", F.explode(F.array(F.concat(F.lit("a"), F.floor(x)), F.concat(F.lit("b"), F.floor(x + 0.5)))).alias("node"))
    stacked = cut_lineage(RP.stack_labelings({
        "dbscan": K.dbscan(d, "id", LOWD_EPS, LOWD_MIN).select("id", "cluster"),
        "letter": d.select("id", F.substring("id", 1, 1)), "cover": cover}, {"dbscan": "-1"}))
    return d, RP.predictive_metrics(stacked, d, "label").unionByName(RP.quality_metrics(stacked, d, ["dbscan", "letter"]))


_FIXED_CTES = _DB_LOWD + f""",
st AS (
  SELECT 'dbscan' AS method, id, cluster AS grp FROM dres WHERE cluster <> '-1'
  UNION ALL SELECT 'letter', id, substr(id, 1, 1) FROM lowd
  UNION ALL SELECT 'cover', id, 'a' || CAST(CAST(floor(f[1]) AS BIGINT) AS VARCHAR) FROM lowd
  UNION ALL SELECT 'cover', id, 'b' || CAST(CAST(floor(f[1] + 0.5) AS BIGINT) AS VARCHAR) FROM lowd),
stl AS (SELECT method, st.id, grp, CAST(label AS INT) AS y, f FROM st JOIN lowd ON st.id = lowd.id),
hits AS (SELECT method, grp, avg(y) > 0.5 AS hit FROM stl GROUP BY method, grp),
per AS (SELECT method, id, max(hit::INT) AS hit, max(y) AS y, count(*) AS c FROM stl JOIN hits USING (method, grp) GROUP BY method, id),
tot AS (SELECT count(*) AS n, sum(label::INT) AS p FROM lowd),
cnt AS (SELECT method, sum(hit * y) AS tp, sum(hit) AS said, count(*) AS inside, count(*) FILTER (c > 1) AS shared FROM per GROUP BY method),
pr AS (SELECT *, CASE WHEN said > 0 THEN tp / said END AS prec, CASE WHEN p > 0 THEN tp / p END AS rec FROM cnt, tot),
pq AS (SELECT method, grp, f, id FROM stl WHERE method <> 'cover'),
pd AS (SELECT method, grp, p, avg(f[p]) AS m, count(*) AS n FROM pq, range(1, 7) r(p) GROUP BY method, grp, p),
pc AS (SELECT method, grp, list(m ORDER BY p) AS c, max(n) AS n FROM pd GROUP BY method, grp),
pg AS (SELECT method, list(m ORDER BY p) AS g FROM (SELECT method, p, avg(f[p]) AS m FROM pq, range(1, 7) r(p) GROUP BY method, p) GROUP BY method),
sw AS (SELECT method, sum({O.d2_sql('pq.f', 'pc.c')}) AS ssw, count(*) AS n FROM pq JOIN pc USING (method, grp) GROUP BY method),
sb AS (SELECT method, sum(n * {O.d2_sql('pc.c', 'pg.g')}) AS ssb, count(*) AS k FROM pc JOIN pg USING (method) GROUP BY method),
ss AS (SELECT method, grp, c, avg(sqrt({O.d2_sql('pq.f', 'pc.c')})) AS s FROM pq JOIN pc USING (method, grp) GROUP BY method, grp, c),
dbi AS (SELECT method, avg(r) AS v FROM (SELECT a.method, a.grp, max((a.s + b.s) / sqrt({O.d2_sql('a.c', 'b.c')})) AS r
        FROM ss a JOIN ss b ON a.method = b.method AND a.grp <> b.grp GROUP BY 1, 2) GROUP BY method),
sp AS (SELECT x.method, x.id, x.grp = y.grp AS same, y.grp, sum(sqrt({O.d2_sql('x.f', 'y.f')})) AS sm, count(*) AS c
       FROM pq x JOIN pq y ON x.method = y.method GROUP BY ALL),
sil AS (SELECT method, avg(CASE WHEN n_own <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS v FROM (
          SELECT method, id, max(c) FILTER (same) AS n_own, max(sm) FILTER (same) / nullif(max(c) FILTER (same) - 1, 0) AS a,
                 min(sm / c) FILTER (NOT same) AS b FROM sp GROUP BY method, id) GROUP BY method),
lm AS (
  SELECT method, unnest(['precision', 'recall', 'f1_score', 'n_groups', 'exclusive_groups', 'pct_overlap', 'pct_outliers']) AS metric,
         unnest([prec, rec, 2 * prec * rec / nullif(prec + rec, 0), (SELECT count(*) FROM hits h WHERE h.method = pr.method),
                 (shared = 0)::INT, 100 * shared / n, 100 * (n - inside) / n]::DOUBLE[]) AS value FROM pr
  UNION ALL SELECT method, 'silhouette', v FROM sil UNION ALL SELECT method, 'davies_bouldin', v FROM dbi
  UNION ALL SELECT method, 'calinski_harabasz', ssb / ssw * (n - k) / (k - 1) FROM sw JOIN sb USING (method))"""


@register("method_comparison_fixed", O.with_risk("""
SELECT metric, round(max(value) FILTER (method = 'dbscan'), 6) AS dbscan, round(max(value) FILTER (method = 'letter'), 6) AS letter,
       round(max(value) FILTER (method = 'cover'), 6) AS cover FROM lm GROUP BY metric""", _FIXED_CTES))
def q_method_comparison_fixed(spark, sf):
    names = ["dbscan", "letter", "cover"]
    return RP.method_comparison(_fixed_methods(spark, sf)[1], names).select("metric", *[_r(n) for n in names])


@register("executive_summary_fixed", O.with_risk("""
SELECT CAST(n AS BIGINT) AS n_total, CAST(p AS BIGINT) AS n_morosos, round(100.0 * p / n, 6) AS pct_morosos, best_method, best_f1
FROM tot, (SELECT arg_max(method, (value, method)) AS best_method, round(max(value), 6) AS best_f1 FROM lm
           WHERE metric = 'f1_score' AND value IS NOT NULL)""", _FIXED_CTES))
def q_executive_summary_fixed(spark, sf):
    d, metrics = _fixed_methods(spark, sf)          # the customers are built once
    out = RP.executive_summary(RP.label_balance(d, "label"), metrics)
    return out.select("n_total", "n_morosos", _r("pct_morosos"), "best_method", _r("best_f1"))
