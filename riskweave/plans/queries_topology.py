"""Registered queries: Mapper (raw-axis lens), graph measures, persistence (T, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import features as FE
from riskweave.operators import forest as FO
from riskweave.operators import neighbors as N
from riskweave.operators import topology as TP
from riskweave.plans import oracle as O
from riskweave.plans import queries_features as QF
from riskweave.plans.catalog import register
from riskweave.plans.queries_cluster import EMB_EPS, emb, lowd
from riskweave.session import cut_lineage

# Raw-axis lens: the first two z-scored columns (open balance, invoice count).
N_CUBES, OVERLAP, M_EPS, M_MIN = 10, 0.3, 0.5, 5

_LENS_CTES = (O.LOWD_CTE + ", lz AS (SELECT id, label, f, f[1] AS l0, f[2] AS l1 FROM lowd), "
              + O.cover_sql("lz", ["l0", "l1"], N_CUBES, OVERLAP)
              + ", mp AS (SELECT cov.cube AS g, lz.id, lz.f FROM cov JOIN lz ON cov.id = lz.id), "
              + O.dbscan_grouped_sql("mp", M_EPS, M_MIN).strip())
_NERVE = ("nerve AS (SELECT a.node_id AS src, b.node_id AS dst, CAST(count(*) AS BIGINT) AS shared "
          "FROM members a JOIN members b ON a.id = b.id AND a.node_id < b.node_id GROUP BY a.node_id, b.node_id)")
_NODES = ("nodes AS (SELECT m.node_id, CAST(count(*) AS BIGINT) AS size, avg(CAST(l.label AS INT)) AS tasa, "
          "avg(CAST(c.saldo_pendiente_total AS DOUBLE)) AS saldo "
          "FROM members m JOIN lowd l ON m.id = l.id JOIN customer_risk c ON c.cif_nif = m.id GROUP BY m.node_id)")


def _lens(spark, sf):
    d = cut_lineage(lowd(spark, sf))
    return d.select("id", "label", "features", F.col("features")[0].alias("l0"), F.col("features")[1].alias("l1"))


def _members(spark, sf, lens=None):
    return TP.mapper(_lens(spark, sf) if lens is None else lens, "id", ["l0", "l1"], N_CUBES, OVERLAP, M_EPS, M_MIN)


def _graph(spark, sf):
    """(members, nodes, edges), each written once; the customers are built once."""
    lens = _lens(spark, sf)
    mem = cut_lineage(_members(spark, sf, lens))
    nodes = cut_lineage(TP.node_rates(mem, lens.select("id", "label"), "id", "label"))
    return mem, nodes, cut_lineage(TP.nerve(mem, "id"))


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@register("cover", O.with_risk("SELECT id, cube FROM cov", _LENS_CTES))
def q_cover(spark, sf):
    return TP.cover(_lens(spark, sf), "id", ["l0", "l1"], N_CUBES, OVERLAP)


@register("mapper", O.with_risk("SELECT node_id, cube, id FROM members", _LENS_CTES))
def q_mapper(spark, sf):
    return _members(spark, sf)


@register("nerve", O.with_risk("SELECT * FROM nerve", _LENS_CTES + "," + _NERVE))
def q_nerve(spark, sf):
    return TP.nerve(_members(spark, sf), "id")


@register("node_rates", O.with_risk("SELECT node_id, size, round(tasa, 6) AS tasa FROM nodes",
                                    _LENS_CTES + "," + _NODES))
def q_node_rates(spark, sf):
    _, nodes, _ = _graph(spark, sf)
    return nodes.select("node_id", "size", _r("tasa"))


@register("edge_rates", O.with_risk(
    "SELECT e.src, e.dst, round((a.tasa + b.tasa) / 2, 6) AS tasa FROM nerve e JOIN nodes a ON e.src = a.node_id "
    "JOIN nodes b ON e.dst = b.node_id", _LENS_CTES + "," + _NERVE + "," + _NODES))
def q_edge_rates(spark, sf):
    _, nodes, edges = _graph(spark, sf)
    return TP.edge_rates(edges, nodes).select("src", "dst", _r("tasa"))


_GM_CTES = _LENS_CTES + "," + _NERVE + "," + _NODES + """,
und AS (SELECT src AS a, dst AS b FROM nerve UNION ALL SELECT dst, src FROM nerve),
nreach(v, r) AS (SELECT node_id, node_id FROM nodes
                 UNION SELECT und.b, nreach.r FROM nreach JOIN und ON nreach.v = und.a),
ncomp AS (SELECT v, min(r) AS c FROM nreach GROUP BY v),
nsz AS (SELECT c, count(*) AS sz FROM ncomp GROUP BY c),
niso AS (SELECT count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT src FROM nerve UNION SELECT dst FROM nerve))"""


@register("graph_metrics", O.with_risk("""
SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS n_nodos,
       CAST((SELECT count(*) FROM nerve) AS BIGINT) AS n_aristas,
       CAST((SELECT count(*) FROM nsz) AS BIGINT) AS n_componentes,
       CAST((SELECT n FROM niso) AS BIGINT) AS n_aislados,
       round((SELECT n FROM niso) / greatest((SELECT count(*) FROM nodes), 1), 6) AS pct_aislados,
       CAST(COALESCE((SELECT max(sz) FROM nsz), 0) AS BIGINT) AS comp_principal,
       round((SELECT avg(size) FROM nodes), 6) AS tam_medio,
       CAST((SELECT count(*) FROM nodes WHERE tasa > 0.5) AS BIGINT) AS n_mora_50,
       CAST((SELECT count(*) FROM nodes WHERE tasa > 0.8) AS BIGINT) AS n_mora_80,
       round(CASE WHEN (SELECT count(*) FROM nodes) > 1 THEN 2.0 * (SELECT count(*) FROM nerve) /
             ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)) ELSE 0.0 END, 6) AS densidad""",
    _GM_CTES))
def q_graph_metrics(spark, sf):
    _, nodes, edges = _graph(spark, sf)
    g = TP.graph_metrics(nodes, edges)
    return g.select("n_nodos", "n_aristas", "n_componentes", "n_aislados", _r("pct_aislados"),
                    "comp_principal", _r("tam_medio"), "n_mora_50", "n_mora_80", _r("densidad"))


@register("node_overlap", O.with_risk(
    "SELECT round(count(*) FILTER (WHERE k >= 2) * 1.0 / count(*), 6) AS pct_solapamiento "
    "FROM (SELECT id, count(*) AS k FROM members GROUP BY id) t", _LENS_CTES))
def q_node_overlap(spark, sf):
    return TP.node_overlap(_members(spark, sf), "id").select(_r("pct_solapamiento"))


@register("interpret_profile", O.with_risk("""
SELECT node_id, list_filter([
  CASE WHEN saldo > 5000 THEN 'debt_high' WHEN saldo > 1000 THEN 'debt_moderate' WHEN saldo > 0 THEN 'debt_minimal'
       WHEN saldo IS NOT NULL THEN 'debt_none' END,
  CASE WHEN tasa * 100 > 25 THEN 'rate_very_high' WHEN tasa * 100 > 15 THEN 'rate_high'
       WHEN tasa * 100 > 5 THEN 'rate_watch' WHEN tasa * 100 > 0 THEN 'rate_healthy' ELSE 'rate_zero' END],
  lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN tasa * 100 > 10 THEN 'red' WHEN tasa * 100 > 5 THEN 'orange' ELSE 'green' END AS colour
FROM nodes""", _LENS_CTES + "," + _NODES))
def q_interpret_profile(spark, sf):
    mem = _members(spark, sf)
    from riskweave.plans.testbed import customer_risk
    labels = lowd(spark, sf).select("id", "label")
    cr = customer_risk(spark, sf).select(F.col("cif_nif").alias("id"),
                                         F.col("saldo_pendiente_total").cast("double").alias("saldo"))
    prof = (N.wide_join(N.wide_join(mem, labels, "id"), cr, "id").groupBy("node_id")
               .agg(F.avg(F.col("label").cast("int").cast("double")).alias("tasa"), F.avg("saldo").alias("saldo")))
    rate = F.col("tasa") * 100
    return prof.select("node_id", TP.interpret_profile(asnef_debt="saldo", rate_pct=rate).alias("reasons"),
                       TP.risk_colour(rate).alias("colour"))


@register("risk_colour", O.with_risk(
    "SELECT node_id, CASE WHEN tasa * 100 > 10 THEN 'red' WHEN tasa * 100 > 5 THEN 'orange' ELSE 'green' END "
    "AS colour FROM nodes", _LENS_CTES + "," + _NODES))
def q_risk_colour(spark, sf):
    _, nodes, _ = _graph(spark, sf)
    return nodes.select("node_id", TP.risk_colour(F.col("tasa") * 100).alias("colour"))


# V1 is the median pairwise distance of a bounded sample (300 points, as the
# reference): the sample is the feature, so pairs are at most 300*299/2.
_DP_N, _DP_SEED = 300, 42


@register("distance_percentile", O.with_testbed(
    f"SELECT round(quantile_cont(sqrt({O.d2_sql('a.f', 'b.f')}), 0.5), 6) AS distance "
    "FROM smp a JOIN smp b ON a.id < b.id", O.EMB_CTE + f""",
smp AS (SELECT * FROM emb ORDER BY md5(CAST(id AS VARCHAR) || '|{_DP_SEED}'), id LIMIT {_DP_N})"""))
def q_distance_percentile(spark, sf):
    from riskweave.operators.dedupe import uniform_sample
    sample = uniform_sample(emb(spark, sf), "id", _DP_N, _DP_SEED)
    return TP.distance_percentile(sample, "id", 0.5).select(_r("distance"))


def _bars(spark, sf):
    """H0 of the embeddings up to the median distance of V1's sample."""
    from riskweave.operators.dedupe import uniform_sample
    e = cut_lineage(emb(spark, sf))
    thresh = TP.distance_percentile(uniform_sample(e, "id", _DP_N, _DP_SEED), "id", 0.5).first()["distance"]
    return FO.persistence_h0(e, "id", thresh)


@register("persistence_h0")
def q_persistence_h0(spark, sf):
    return _bars(spark, sf)


EULER_AT = [0.9, 1.0, 1.1, EMB_EPS]


@register("euler_curve", O.with_testbed(f"""
SELECT t AS threshold, (SELECT count(*) FROM emb) AS n_vertices, CAST(e AS BIGINT) AS n_edges, CAST(r AS BIGINT) AS n_triangles,
       CAST((SELECT count(*) FROM emb) - e + r AS BIGINT) AS euler
FROM (SELECT t, (SELECT count(*) FROM ep WHERE d <= t) AS e, (SELECT count(*) FROM tri WHERE d <= t) AS r
      FROM (SELECT unnest({EULER_AT}::DOUBLE[]) AS t))""", O.EMB_CTE + f""",
ep AS MATERIALIZED (SELECT a.id AS p, b.id AS q, sqrt({O.d2_sql('a.f', 'b.f')}) AS d FROM emb a JOIN emb b ON a.id < b.id
       WHERE {O.d2_sql('a.f', 'b.f')} <= {EMB_EPS} * {EMB_EPS}),
tri AS MATERIALIZED (SELECT greatest(x.d, y.d, z.d) AS d FROM ep x JOIN ep y ON x.q = y.p JOIN ep z ON z.p = x.p AND z.q = y.q)"""))
def q_euler_curve(spark, sf):
    e = cut_lineage(emb(spark, sf))
    return FO.euler_curve(e, N.eps_join(e, "id", EMB_EPS), EULER_AT)


@register("top_bars")
def q_top_bars(spark, sf):
    return TP.top_bars(_bars(spark, sf), 5)


@register("mapper_sensitivity")
def q_mapper_sensitivity(spark, sf):
    d = lowd(spark, sf)
    return TP.mapper_sensitivity(d, "id", d.select("id", "label"), "label")


_CTRL = ["saldo_pendiente_total", "n_facturas_totales", "n_facturas_vencidas"]
_CTRL_CTES = ("zc AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in _CTRL)
    + " FROM customer_risk), ctl AS (SELECT cif_nif AS id, [" + ", ".join(
    f"round((CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END), 6)"
    for c in _CTRL) + "] AS f FROM customer_risk, zc), "
    "lzc AS (SELECT id, f, f[1] AS l0, f[2] AS l1 FROM ctl), "
    + O.cover_sql("lzc", ["l0", "l1"], N_CUBES, OVERLAP)
    + ", mp AS (SELECT cov.cube AS g, lzc.id, lzc.f FROM cov JOIN lzc ON cov.id = lzc.id), "
    + O.dbscan_grouped_sql("mp", M_EPS, M_MIN).strip())


@register("mapper_without_label_features", O.with_risk("SELECT node_id, cube, id FROM members", _CTRL_CTES))
def q_mapper_control(spark, sf):
    """Mapper on the numeric features without the label-derived columns."""
    from riskweave.operators import features as FE
    from riskweave.plans.testbed import customer_risk
    from riskweave.session import cut_lineage
    keep = [c for c in FE.NUMERIC_FEATURES if c not in FE.LABEL_DERIVED]
    cr = cut_lineage(customer_risk(spark, sf).select("cif_nif", *keep))
    z = FE.zscore(cr, keep).withColumns({c: F.round(F.col(c), 6) for c in keep})
    z = FE.assemble(z, keep).select(F.col("cif_nif").alias("id"), "features")
    lens = z.select("id", "features", F.col("features")[0].alias("l0"), F.col("features")[1].alias("l1"))
    return TP.mapper(lens, "id", ["l0", "l1"], N_CUBES, OVERLAP, M_EPS, M_MIN)


# Mapper as the reference runs it: PCA lens of two components, 15 cubes an axis, 30 % overlap.
PCA_CUBES = 15


def mapper_members(d, **how):
    """Mapper members of (id, features) with the PCA lens, its values rounded to 6 places."""
    proj, _, _ = TP.pca_project(d.select("id", "features"), 2)
    lens = cut_lineage(proj.select("id", "features", F.round(F.col("pc")[0], 6).alias("l0"), F.round(F.col("pc")[1], 6).alias("l1")))
    return TP.mapper(lens, "id", ["l0", "l1"], PCA_CUBES, OVERLAP, M_EPS, M_MIN, **how)


def _pca_ctes(src: str) -> str:
    """Two principal axes in SQL: the covariance matrix squared (and scaled) forty times is the
    projector on its first axis; take that axis out and do the same for the second."""
    def axis(k, mat):
        return f"""
pw{k}(step, m) AS (SELECT 0, m FROM {mat} UNION ALL
  SELECT step + 1, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q)
         / list_sum(list_transform(m, lambda t: list_dot_product(t, t))))) FROM pw{k} WHERE step < 40),
dg{k} AS (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM pw{k} WHERE step = 40),
ax{k} AS (SELECT list_transform(m[list_position(d, list_max(d))], lambda v: v / sqrt(list_max(d))) AS v FROM dg{k})"""
    return f"""
ix AS (SELECT unnest(range(1, (SELECT max(len(f)) FROM {src}) + 1)) AS i),
cv AS (SELECT i, list(c ORDER BY j) AS r FROM (
         SELECT a.i AS i, b.i AS j, covar_samp(f[a.i], f[b.i]) AS c FROM {src}, ix a, ix b GROUP BY a.i, b.i) GROUP BY i),
c1 AS (SELECT list(r ORDER BY i) AS m FROM cv),{axis(1, 'c1')},
ev AS (SELECT list_sum(list_transform(range(1, len(m) + 1), lambda i: v[i] * list_dot_product(m[i], v))) AS l FROM c1, ax1),
c2 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m
       FROM c1, ax1, ev),{axis(2, 'c2')},
lzp AS (SELECT id, f, round(list_dot_product(f, ax1.v), 6) AS l0, round(list_dot_product(f, ax2.v), 6) AS l1 FROM {src}, ax1, ax2),
""" + O.cover_sql("lzp", ["l0", "l1"], PCA_CUBES, OVERLAP) + """
, mp AS (SELECT cov.cube AS g, lzp.id, lzp.f FROM cov JOIN lzp ON cov.id = lzp.id), """ + O.dbscan_grouped_sql("mp", M_EPS, M_MIN).strip()


@register("mapper_pca", O.with_risk("SELECT node_id, cube, id FROM members", O.LOWD_CTE + "," + _pca_ctes("lowd")))
def q_mapper_pca(spark, sf):
    return mapper_members(cut_lineage(lowd(spark, sf)))


def _preset_matrix(spark, sf, without_label: bool = False):
    """The 'mapper' preset, z-scored, rounded to 6 places, features in name order."""
    fs, names = FE.feature_set(QF.customers_clean(spark, sf), "mapper", exclude_label_features=without_label)
    z = QF._round(FE.zscore(QF._round(fs, names), names), names)
    return cut_lineage(FE.assemble(z, sorted(names)).select(F.col("cif_nif").alias("id"), "features"))


def _matrix_ctes(without_label: bool = False) -> str:
    keep = " WHERE feature NOT IN (" + ", ".join(f"'{c}'" for c in FE.LABEL_DERIVED) + ")" if without_label else ""
    return QF.MAPPER_CTES + f""",
fsm AS MATERIALIZED (SELECT * FROM ({QF.MAPPER_SQL}){keep}),
fsm_stats AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM fsm GROUP BY feature),
fmm AS MATERIALIZED (SELECT cif_nif AS id, list(round((value - m) / if(s = 0, 1.0, s), 6) ORDER BY feature) AS f
         FROM fsm JOIN fsm_stats USING (feature) GROUP BY cif_nif),""" + _pca_ctes("fmm")


@register("mapper_matrix", O.with_risk("SELECT node_id, cube, id FROM members", _matrix_ctes()))
def q_mapper_matrix(spark, sf):
    return mapper_members(_preset_matrix(spark, sf))


@register("mapper_matrix_control", O.with_risk("SELECT node_id, cube, id FROM members", _matrix_ctes(True)))
def q_mapper_matrix_control(spark, sf):
    """T8 on the preset: the same graph without the label-derived columns."""
    return mapper_members(_preset_matrix(spark, sf, True))
