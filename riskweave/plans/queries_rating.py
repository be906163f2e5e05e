"""Registered queries: rating features and payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.exprs import pt_financials
from riskweave.operators import rating as RT
from riskweave.operators.dedupe import argmax_rejoin, latest_per_key_in
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register


def _rq(body):
    return O.with_testbed(body, O.RATING_CTES)


@register("rating_features", _rq("SELECT * FROM rating_features"))
def q_rating_features(spark, sf):
    return RT.rating_features(T.rating_schema(spark, sf))


@register("latest_request", _rq("SELECT * FROM r_latest_req"))
def q_latest_request(spark, sf):
    return RT.latest_requests(T.rating_schema(spark, sf)["request"])


@register("latest_per_key", _rq("SELECT id_cliente, riesgo_power, riesgo_gas, volumen_riesgo FROM r_risk_last"))
def q_latest_per_key(spark, sf):
    risk = T.rating_schema(spark, sf)["risk"]
    return latest_per_key_in(risk, "id_cliente", "fecha_creacion").select(
        "id_cliente", "riesgo_power", "riesgo_gas", F.col("volumen").alias("volumen_riesgo"))


@register("argmax_rejoin", _rq("SELECT * FROM r_eeff_last"))
def q_argmax_rejoin(spark, sf):
    return argmax_rejoin(T.rating_schema(spark, sf)["eeff"], "id_evaluacion", "id_eeff")


@register("limits_max", _rq("SELECT * FROM r_limmax"))
def q_limits_max(spark, sf):
    return RT.group_max(T.rating_schema(spark, sf)["limits_neg"], ["id_evaluacion", "id_tramo", "id_negocio"],
                        ["volumen", "volumen_maximo", "precio"])


@register("formalised_flag", _rq("SELECT oferta, entorno, estado_crm_falcon, estado_formalizado FROM q_lines"))
def q_formalised_flag(spark, sf):
    crm, fal = T.quote_sources(spark, sf)
    a = RT.offers_per_quote(crm, "estado", ["31"], "CRM")
    b = RT.offers_per_quote(fal, "estado", ["05", "07", "04"], "FALCON")
    return a.unionByName(b).select("oferta", "entorno", "estado_crm_falcon", "estado_formalizado")


@register("offer_counts", _rq("SELECT * FROM r_offers"))
def q_offer_counts(spark, sf):
    crm, fal = T.quote_sources(spark, sf)
    return RT.offers(crm, fal)


@register("pt_financials", _rq("SELECT * FROM r_pt_last"))
def q_pt_financials(spark, sf):
    pt = argmax_rejoin(T.rating_schema(spark, sf)["eeff_pt"], "id_eeff", "id_eeff_pt")
    return pt_financials(pt).select(
        "id_eeff", "result_antes_imp_pt", "fecha_balance_pt", "total_pasivo_pt", "fondos_propios_pt",
        "fecha_constitucion_pt", "ing_explotacion_pt", "importe_neto_pt", "gastos_financieros_pt")


@register("payments", O.with_testbed(O.PAYMENTS_SQL))
def q_payments(spark, sf):
    t = T.payment_tables(spark, sf)
    return RT.payments(t["entries"], t["customers"], t["invoices"], t["memos"], t["ids"])


@register("filter_in_list", O.with_testbed(
    "SELECT no_, vat AS vat_registration_no_ FROM tb_customers WHERE c_nationkey IN (1, 3, 5, 7)"))
def q_filter_in_list(spark, sf):
    c = T.customers(spark, sf)
    return RT.filter_in_list(c, "c_nationkey", [1, 3, 5, 7]).select("no_", "vat_registration_no_")
