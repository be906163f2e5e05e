"""Driver contract and a sample of oracle comparisons at sf0.001."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v != 0 else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 15


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", ["customer_risk", "unified_invoices", "customer_risk_clean", "feature_set",
                                  "dbscan", "mapper", "rating_features", "anonymise", "payments",
                                  "risk_alerts", "silhouette"])
def test_oracle_sample(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    a = _canon(df.columns, [tuple(r) for r in df.collect()])
    b = _canon([d[0] for d in cur.description], cur.fetchall())
    assert a == b


def test_rating_table_has_its_49_columns():
    from riskweave.operators.rating import RATING_COLUMNS
    want = """
    id_evaluacion fecha_creacion ano_mes_creacion rating_id estado estado_detalle id_cliente last_request
    grade_old pd_old pd_new cif_nif zona_geografica tipo_persona volumen id_tramo id_negocio volumen_maximo
    precio limite_total_concedido limite_disponible_ge concurso burofax deuda_asnef asnef gastos_financieros
    ing_explotacion result_antes_imp importe_neto total_pasivo fondos_propios fecha_balance fecha_constitucion
    fecha_contratacion codigo_cnae result_antes_imp_pt fecha_balance_pt total_pasivo_pt fondos_propios_pt
    fecha_constitucion_pt ing_explotacion_pt importe_neto_pt gastos_financieros_pt id_cliente_riesgo_vivo
    riesgo_vivo_power riesgo_vivo_gas volumen_riesgo riesgo_vivo_power_falcon riesgo_vivo_eficiencia
    """.split()
    assert len(want) == 49 and list(RATING_COLUMNS) == want
