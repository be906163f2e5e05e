"""Steps that must not grow with the rows of one key, one task or one vertex."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import blocks as B
from riskweave.operators import forest as FO
from riskweave.operators import joins as J
from riskweave.operators import neighbors as N


@pytest.fixture
def shuffled(spark):
    """Plain shuffled joins: nothing is broadcast and no partitions are put together."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("right_on", [None, "key_r"])
def test_rows_without_a_key_are_joined_in_many_tasks(shuffled, right_on):
    left = shuffled.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("key"))
    right = shuffled.createDataFrame([(0, "a"), (10, "b"), (10, "c"), (None, "d")], f"{right_on or 'key'} long, v string")
    out = J.left_join(left, right, "key", right_on)
    assert out.count() == 4001
    assert [tuple(r) for r in out.filter("v is not null").select("id", "v").orderBy("id", "v").collect()] == [(0, "a"), (10, "b"), (10, "c")]
    held = out.filter("key is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 1200       # 3600 in one partition before


def test_tables_of_one_key_are_joined_after_one_shuffle(shuffled):
    left = shuffled.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("key"))
    one = shuffled.createDataFrame([(1, "a"), (None, "n")], "key long, v string")
    two = shuffled.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "other long, w string")
    out = J.left_joins(left, [(one, None), (two, "other")], "key")
    assert out.columns == ["key", "id", "v", "other", "w"] and out.count() == 301
    got = out.filter("w is not null").select("key", "id", "v", "other", "w").orderBy("w").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a", 1, "b"), (1, 1, "a", 1, "c"), (2, 2, None, 2, "d")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3      # one a table


def test_edges_that_lie_together_are_contracted_in_place(spark, monkeypatch):
    chains = [(1000 * c + i, 1000 * c + i + 1) for c in range(20) for i in range(300)]
    edges = spark.createDataFrame(chains, "src long, dst long").repartition(4, F.floor(F.col("src") / 1000))
    rounds, real = [], N.both_directions
    monkeypatch.setattr(N, "both_directions", lambda *a, **k: rounds.append(1) or real(*a, **k))
    verts = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    got = {r["id"]: r["component"] for r in N.connected_components(verts, edges).collect()}
    assert got == {1000 * c + i: 1000 * c for c in range(20) for i in range(301)}
    assert len(rounds) == 1


@pytest.mark.parametrize("kind", ["long", "int", "string", "decimal(10,0)"])
def test_components_of_any_id_with_loops_repeats_and_nulls(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "SMALL_GRAPH", 3)
    rows = [(1, 2), (2, 1), (2, 3), (3, 3), (5, 4), (None, 4), (6, None), (7, 8), (8, 9), (9, 7), (9, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind)).repartition(3)
    verts = spark.range(1, 11).select(F.col("id").cast(kind))
    got = {int(r["id"]): int(r["component"]) for r in N.connected_components(verts, edges).collect()}
    least = 1
    assert got == {**dict.fromkeys([1, 2, 3, 7, 8, 9], least), 4: 4, 5: 4, 6: 6, 10: 10}


def test_pivots_send_few_rows_and_pick_the_same(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_PIVOTS", 50)
    df = spark.range(20000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features")).repartition(8)
    want = df.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(50).collect()
    asked, real = [], type(df).orderBy

    def order(self, *cols, **how):
        asked.append(self.count())
        return real(self, *cols, **how)

    monkeypatch.setattr(type(df), "orderBy", order)
    assert np.array_equal(B.pivots(df, "id", "features", 16), np.array([r["features"] for r in want]))
    assert asked and asked[-1] < 250                                     # all 20000 before
    alike = df.withColumn("id", F.lit(3))                                # every hash equal: none or all pass the filter
    assert len(B.pivots(alike, "id", "features", 16)) == 50
    assert B.pivots(df.filter("id < 0"), "id", "features", 16).size == 0


@pytest.mark.parametrize("cell", [1 << 20, 60, 7])
def test_triangles_without_wedges(spark, monkeypatch, cell):
    monkeypatch.setattr(FO, "WEDGES", 50)
    rng = np.random.default_rng(8)
    n, cuts = 40, [0.2, 0.5, 0.9]
    D = np.triu(rng.random((n, n)), 1)
    rows = [(f"v{i:02d}", f"v{j:02d}", float(D[i, j])) for i, j in itertools.combinations(range(n), 2)]
    rows += [r for r in rows if r[0] == "v03"]                           # repeated edges count as often as they come
    many = np.triu(np.ones((n, n), int), 1)
    many[3, 4:] = 2
    pairs = spark.createDataFrame(rows, "src string, dst string, dist double").repartition(3)
    verts = spark.createDataFrame([(f"v{i:02d}",) for i in range(n)], "id string")
    got = {r.threshold: (r.n_vertices, r.n_edges, r.n_triangles) for r in FO.euler_curve(verts, pairs, cuts, cell_arcs=cell).collect()}
    for t in cuts:
        m = many * (D <= t)
        tri = sum(int(m[i, j] * m[i, k] * m[j, k]) for i, j, k in itertools.combinations(range(n), 3))
        assert got[t] == (n, int(m.sum()), tri)


def test_an_edge_goes_to_one_cell_per_colour(spark):
    arcs = spark.createDataFrame([(i, j, 0) for i, j in itertools.combinations(range(60), 2)], "u long, v long, k int")
    dealt = FO._cells(arcs, 5, 1)
    assert dealt.count() == 5 * arcs.count()                             # the wedges are 58 / 2 * 2/3 times the edges
    assert dealt.distinct().count() == dealt.count()
    assert dealt.select("cell").distinct().count() == 5 * 6 * 7 // 6


@pytest.mark.parametrize("cell", [1 << 20, 3])
def test_repeated_ends_of_a_wedge_close_nothing(spark, cell):
    # two edges to one vertex are no wedge, although that vertex has a loop
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (2, 2, 0.0), (2, 3, 0.5), (1, 3, 0.5)], "src long, dst long, dist double")
    for rows, tri in ((pairs.filter("src = 1 OR src = dst"), 0), (pairs.filter("src <> dst"), 2)):
        assert FO.euler_curve(spark.range(1, 4), rows, [1.0], cell_arcs=cell).first().n_triangles == tri


def test_only_shared_vectors_are_copied_to_their_rows(shuffled, monkeypatch):
    rows = [(i, 0, [float(i), 1.0]) for i in range(200)] + [(1000 + i, 0, [5.0, 1.0]) for i in range(30)]
    rows += [(2000, 1, [5.0, 1.0]), (2001, 1, [-0.0, 0.0]), (2002, 1, [0.0, 0.0]), (3, 1, [float("nan"), 0.0]), (4, 1, None), (None, 1, [7.0, 7.0])]
    df = shuffled.createDataFrame(rows, "id long, g int, features array<double>")
    copied, real = [], N.spread_join
    monkeypatch.setattr(N, "spread_join", lambda left, one, *a, **k: copied.append(one.count()) or real(left, one, *a, **k))
    points, members = N.collapse(df, "id", "features", ["g"])
    assert copied == [2] and points.agg(F.sum("w")).first()[0] == 236            # 205 before
    got = {(r.g, r.id): r.uid for r in members.collect()}
    want = {(0, i): i for i in range(200)} | {(0, 1000 + i): 5 for i in range(30)}
    assert got == want | {(1, 2000): 2000, (1, 2001): 2001, (1, 2002): 2001, (1, 3): 3, (1, None): None}
    assert members.count() == 235 and members.select("pid").distinct().count() == 204


def test_many_edges_of_few_vertices_leave_few_rows(spark, monkeypatch):
    """12,000 edges of 300 vertices in one partition, in runs of 1000: one star a partition, not one a run."""
    monkeypatch.setattr(N, "SMALL_GRAPH", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        i = F.col("id")
        edges = spark.range(0, 12000, 1, 1).select((3 * F.pmod(F.xxhash64(i), F.lit(100)) + i % 3).alias("a"),
                                                   (3 * F.pmod(F.xxhash64(i, F.lit(1)), F.lit(100)) + i % 3).alias("b"))
        left = N._local_stars(edges).collect()
        assert len(left) == 297                                              # 3564 before
        got = {r["id"]: r["component"] for r in N.connected_components(spark.range(301), edges, src="a", dst="b").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {v: v % 3 if v < 300 else v for v in range(301)}


def _rating_tables(spark):
    """Small rating tables with missing links, repeated evaluations, ties and null keys."""
    from datetime import date
    def frame(rows, cols):
        return spark.createDataFrame(rows, cols)
    day = [date(2024, m, 1) for m in range(1, 13)]
    ev = [(i % 45 if i % 11 else None, day[i % 12], i % 4 if i % 5 else None) for i in range(60)]
    req = [(10 * e + (k if e % 7 else 3), e if e % 10 else None, e % 6 if e % 4 else None, (e + k) % 5 if k else None, "AB"[k % 2], "z" * k,
            "TRUE" if (e + k) % 3 else "FALSE", None if k < 3 else 1, k, 0.5) for e in range(50) for k in range(4)]
    pt = ["capital_realizado", "acoes_propias", "outros_inst_cap_propio", "premios_emissao", "reservas_legais", "outras_reservas",
          "result_transitados", "resultado_liquido", "dividendos_antecipados"]
    number = ", ".join(f"{c} double" for c in pt)
    return {
        "evaluation": frame(ev, "id_evaluacion long, fecha_creacion date, id_estado_moroso int"),
        "request": frame(req, "id_rating_request long, id_evaluacion long, id_cliente long, rating_id long, estado string, estado_detalle string, "
                              "last_request string, id_input_custom_data long, grade int, pd double"),
        "client": frame([(i, f"N{i}", "z", "PERSON") for i in (0, 1, 1, 2, 4)] + [(None, "x", "x", "x")],
                        "id_cliente long, cif_nif string, zona_geografica string, tipo_persona string"),
        "model_response": frame([(0, 0.1), (1, 0.2), (2, 0.3), (None, 0.9)], "rating_id long, pd_new double"),
        "limits_neg": frame([(e if e % 9 else None, e % 3, "AB"[k % 2], float(e), float(k), 0.1) for e in range(0, 44, 2) for k in range(3)],
                            "id_evaluacion long, id_tramo int, id_negocio string, volumen double, volumen_maximo double, precio double"),
        "limits_ge": frame([(e, 1.5, 2.0) for e in (1, 2, 2, 3, None)], "id_evaluacion long, limite_total_concedido double, limite_disponible_ge double"),
        "estado_moroso": frame([(0, True, False, 1.0, True), (2, False, True, 2.0, False)],
                               "id_estado_moroso int, concurso boolean, burofax boolean, deuda_asnef double, asnef boolean"),
        "eeff": frame([(10 * e + s if s < 3 else None, e if e % 8 else None, f"c{s}", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, day[s], day[s], day[s]) for e in range(40) for s in range(1, 4)],
                      "id_eeff long, id_evaluacion long, codigo_cnae string, gastos_financieros double, ing_explotacion double, result_antes_imp double, "
                      "importe_neto double, total_pasivo double, fondos_propios double, fecha_balance date, fecha_constitucion date, fecha_contratacion date"),
        "eeff_pt": frame([(100 * e + s, 10 * e + 2 if e % 6 else None, 1.0 * e, day[s], 2.0, day[s], 3.0, *[float(s + j) for j in range(9)], 1.0, 2.0, 3.0, 4.0)
                          for e in range(0, 40, 3) for s in range(2)],
                         f"id_eeff_pt long, id_eeff long, result_antes_imp_pt double, fecha_balance_pt date, total_pasivo_pt double, fecha_constitucion_pt date, "
                         f"importe_neto_pt double, {number}, vendas_e_serv_prestados double, outros_rendimentos double, juros_e_rend_obtidos double, juros_e_gastos_suport double"),
        "risk": frame([(c if c != 3 else None, day[m], 1.0 * m, 2.0, 3.0, 4.0, float(k)) for c in range(6) for m in (1, 2) for k in range(2)],
                      "id_cliente long, fecha_creacion date, riesgo_power double, riesgo_gas double, riesgo_power_falcon double, riesgo_eficiencia double, volumen double"),
        "offers": frame([(r, f"o{k}") for r in (0, 1, None) for k in range(3)], "rating_id_crm_falcon long, cups string")}


@pytest.mark.parametrize("with_offers", [True, False])
def test_rating_features_are_shuffled_before_they_grow_wide(shuffled, with_offers):
    """The same rows as plain joins in the order of the warehouse query; no shuffle holds columns of two fan-outs."""
    from riskweave.functions.exprs import pt_financials
    from riskweave.operators import rating as RT
    from riskweave.operators.dedupe import argmax_rejoin, latest_per_key_in
    t = _rating_tables(shuffled)
    out = RT.rating_features(t, with_offers)
    risk = latest_per_key_in(t["risk"], "id_cliente", "fecha_creacion").toDF(
        "id_cliente_riesgo_vivo", "_d", "riesgo_vivo_power", "riesgo_vivo_gas", "riesgo_vivo_power_falcon", "riesgo_vivo_eficiencia", "volumen_riesgo")
    pt = pt_financials(argmax_rejoin(t["eeff_pt"], "id_eeff", "id_eeff_pt"))
    want = (t["evaluation"].withColumn("ano_mes_creacion", F.left(F.col("fecha_creacion").cast("string"), F.lit(7)))
            .join(RT.latest_requests(t["request"]), "id_evaluacion", "left")
            .join(RT.group_max(t["limits_neg"], ["id_evaluacion", "id_tramo", "id_negocio"], ["volumen", "volumen_maximo", "precio"]), "id_evaluacion", "left")
            .join(t["limits_ge"], "id_evaluacion", "left").join(t["estado_moroso"], "id_estado_moroso", "left")
            .join(argmax_rejoin(t["eeff"], "id_evaluacion", "id_eeff"), "id_evaluacion", "left")
            .join(pt, "id_eeff", "left").join(t["client"], "id_cliente", "left")
            .join(risk, F.col("id_cliente") == F.col("id_cliente_riesgo_vivo"), "left").join(t["model_response"], "rating_id", "left"))
    if with_offers:
        want = want.join(t["offers"].withColumnRenamed("rating_id_crm_falcon", "rating_id"), "rating_id", "left")
    rows = lambda df: sorted(map(str, df.select(*RT.RATING_COLUMNS).collect()))
    assert rows(out) == rows(want)
    full = ("pd_new", "cif_nif", "volumen_maximo", "limite_disponible_ge", "concurso", "fondos_propios", "fondos_propios_pt", "riesgo_vivo_gas")
    assert min(out.agg(*[F.count(c) for c in full]).first()) > 0
    plan = out._jdf.queryExecution().executedPlan()
    wide, todo = 0, [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Exchange" in node.nodeName():
            names = {node.output().apply(i).name() for i in range(node.output().size())}
            wide = max(wide, len(names & set(RT.RATING_COLUMNS)))
    assert wide < 25                                                     # 48 before
