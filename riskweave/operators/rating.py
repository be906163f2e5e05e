"""Rating-feature table and payments extract.

Q5 is a chain of left joins from the evaluation table to pre-aggregated
sides (latest request, per-business limits, latest statements), then the
optional offers side and the latest live-risk rows (all ties kept). Every
side is reduced to its join key's grain before the join, so only the fan
outs the warehouse query itself has (limits per tranche/business, offers,
live-risk ties) multiply rows. A table whose key another side brings is
joined to that side first, so evaluations are shuffled once, before they
grow wide and before anything multiplies them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.dedupe import argmax_rejoin, latest_per_key_in, latest_request
from riskweave.operators.ledger import union_all
from riskweave.operators.joins import keyed, left_join, left_joins
from riskweave.operators.neighbors import wide_join


# A4 --------------------------------------------------------------------------------
def group_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """MAX of each measure per key (limits per evaluation, tranche, business)."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


# A5 --------------------------------------------------------------------------------
def formalised_flag(state: Column, formalised_values: Sequence[str]) -> Column:
    """MIN(CASE WHEN state IN (...) THEN 'Formalizado' ELSE 'No_Formalizado')
    as an aggregate: 'Formalizado' sorts first, so it means "any formalised"."""
    return F.min(F.when(state.isin(list(formalised_values)), F.lit("Formalizado"))
                 .otherwise(F.lit("No_Formalizado")))


# A6 --------------------------------------------------------------------------------
OFFER_KEYS = ["oferta", "fecha_oferta", "rating_id_crm_falcon", "cups", "contrato", "id_cliente_falcon_crm",
              "ciudad_oferta", "codigo_postal_oferta"]


def offers_per_quote(quotes: DataFrame, state_col: str, formalised_values: Sequence[str],
                     entorno: str) -> DataFrame:
    """First level: one row per quote line with MAX(state) and the formalised flag."""
    return (quotes.groupBy(*OFFER_KEYS)
                  .agg(F.max(state_col).alias("estado_crm_falcon"),
                       formalised_flag(F.col(state_col), formalised_values).alias("estado_formalizado"))
                  .withColumn("entorno", F.lit(entorno)).withColumn("base", F.lit("OFERTA")))


def offer_counts(per_quote: DataFrame) -> DataFrame:
    """Second level: COUNT(cups), COUNT(contrato) (non-null) per customer,
    rating id, offer day, state, flag, environment, base, city; then DISTINCT."""
    keys = ["id_cliente_falcon_crm", "rating_id_crm_falcon", F.left(F.col("fecha_oferta").cast("string"), F.lit(10))
            .alias("fecha_oferta"), "estado_crm_falcon", "estado_formalizado", "entorno", "base", "ciudad_oferta"]
    g = per_quote.groupBy(*keys).agg(F.count("cups").alias("cups"), F.count("contrato").alias("contrato"))
    return g.select("id_cliente_falcon_crm", "rating_id_crm_falcon", "fecha_oferta", "cups", "contrato",
                    "estado_crm_falcon", "estado_formalizado", "ciudad_oferta").distinct()


def offers(crm_quotes: DataFrame, falcon_quotes: DataFrame) -> DataFrame:
    """U1 of the two offer sources *by name* (the warehouse query's positional
    union swapped document number and supply point), then A6."""
    a = offers_per_quote(crm_quotes, "estado", ["31"], "CRM")
    b = offers_per_quote(falcon_quotes, "estado", ["05", "07", "04"], "FALCON")
    return offer_counts(union_all([a, b]))


# Q5 --------------------------------------------------------------------------------
def latest_requests(requests: DataFrame) -> DataFrame:
    """J6 + the grouped MIN/MAX of the rating query: per evaluation, the
    request with the highest id over *all* its requests, kept only if it is
    the last request and has no custom input."""
    keep = (F.col("last_request") == "TRUE") & F.col("id_input_custom_data").isNull()
    top = latest_request(requests, "id_evaluacion", "id_rating_request", keep)
    return top.groupBy("id_evaluacion", "id_cliente", "id_input_custom_data", "last_request", "estado",
                       F.col("grade").alias("grade_old"), F.col("pd").alias("pd_old")).agg(
        F.min("rating_id").alias("rating_id"), F.min("estado_detalle").alias("estado_detalle"),
        F.max("id_rating_request").alias("max_id_rating_request"))


def rating_features(t: dict[str, DataFrame], with_offers: bool = True) -> DataFrame:
    """Q5 on a dict of tables: evaluation, request, client, model_response,
    limits_neg, limits_ge, estado_moroso, eeff, eeff_pt, risk (+ offers)."""
    from riskweave.functions.exprs import pt_financials
    ev = t["evaluation"]
    req = latest_requests(t["request"])
    # dealt by the evaluation alone, so that they need not be dealt again to be joined
    lim = group_max(keyed(t["limits_neg"], "id_evaluacion").repartition("id_evaluacion", "_share"),
                    ["id_evaluacion", "_share", "id_tramo", "id_negocio"], ["volumen", "volumen_maximo", "precio"])
    statements = keyed(t["eeff"], "id_evaluacion")
    eeff = argmax_rejoin(statements, ["id_evaluacion", "_share"], "id_eeff")
    own = argmax_rejoin(statements.select("id_evaluacion", "_share", "id_eeff"), ["id_evaluacion", "_share"], "id_eeff").drop("_share")
    pt = pt_financials(argmax_rejoin(t["eeff_pt"], "id_eeff", "id_eeff_pt")).select(
        "id_eeff", "result_antes_imp_pt", "fecha_balance_pt", "total_pasivo_pt", "fondos_propios_pt",
        "fecha_constitucion_pt", "ing_explotacion_pt", "importe_neto_pt", "gastos_financieros_pt")
    r = ev.select("id_evaluacion", "fecha_creacion", "id_estado_moroso")
    risk = latest_per_key_in(t["risk"], "id_cliente", "fecha_creacion").select(
        F.col("id_cliente").alias("id_cliente_riesgo_vivo"), F.col("riesgo_power").alias("riesgo_vivo_power"),
        F.col("riesgo_gas").alias("riesgo_vivo_gas"), F.col("volumen").alias("volumen_riesgo"),
        F.col("riesgo_power_falcon").alias("riesgo_vivo_power_falcon"),
        F.col("riesgo_eficiencia").alias("riesgo_vivo_eficiencia"))
    # many rows lack some link of the chain: rows without a key are spread, not joined in one task.
    # (a left join b) left join c on a key of b is a left join (b left join c): what hangs on the rating id, the
    # client or the statement is joined to the narrow side that has it (an evaluation has one statement at most)
    pt = wide_join(own, pt, "id_eeff").drop("id_eeff")
    rated = [(t["model_response"], None)]
    if with_offers and "offers" in t:
        # no column of an offer is kept: it multiplies rows, at the very end
        rated.append((t["offers"].groupBy(F.col("rating_id_crm_falcon").alias("rating_id")).agg(F.count(F.lit(1)).cast("int").alias("_offers")), None))
    req = left_joins(req, rated, "rating_id")
    req = left_joins(req, [(t["client"], None), (risk, "id_cliente_riesgo_vivo")], "id_cliente")
    r = left_join(r, t["estado_moroso"], "id_estado_moroso")
    r = left_joins(r, [(req, None), (t["limits_ge"], None), (eeff, None), (pt, None), (lim, None)], "id_evaluacion")
    r = r.withColumn("ano_mes_creacion", F.left(F.col("fecha_creacion").cast("string"), F.lit(7)))
    if len(rated) > 1:
        r = r.withColumn("_offer", F.explode(F.array_repeat(F.lit(0), F.coalesce("_offers", F.lit(1)))))
    return r.select(*RATING_COLUMNS)


# The 49 columns of the rating table.
RATING_COLUMNS = [
    "id_evaluacion", "fecha_creacion", "ano_mes_creacion", "rating_id", "estado", "estado_detalle", "id_cliente",
    "last_request", "grade_old", "pd_old", "pd_new", "cif_nif", "zona_geografica", "tipo_persona", "volumen",
    "id_tramo", "id_negocio", "volumen_maximo", "precio", "limite_total_concedido", "limite_disponible_ge",
    "concurso", "burofax", "deuda_asnef", "asnef", "gastos_financieros", "ing_explotacion", "result_antes_imp",
    "importe_neto", "total_pasivo", "fondos_propios", "fecha_balance", "fecha_constitucion", "fecha_contratacion",
    "codigo_cnae", "result_antes_imp_pt", "fecha_balance_pt", "total_pasivo_pt", "fondos_propios_pt",
    "fecha_constitucion_pt", "ing_explotacion_pt", "importe_neto_pt", "gastos_financieros_pt",
    "id_cliente_riesgo_vivo", "riesgo_vivo_power", "riesgo_vivo_gas", "volumen_riesgo",
    "riesgo_vivo_power_falcon", "riesgo_vivo_eficiencia",
]


# S7 / J9 / Q6 ------------------------------------------------------------------------
def filter_in_list(df: DataFrame, col: str, values, max_literal: int = 1000) -> DataFrame:
    """Keep rows whose ``col`` is in ``values``.

    A short Python list becomes an ``IN`` predicate (pushed to the scan); a
    long list - or a DataFrame of values - becomes a semi-join, so no list
    is ever spliced into SQL text.
    """
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(v, col, "left_semi")
    values = list(values)
    if len(values) <= max_literal:
        return df.filter(F.col(col).isin(values))
    v = df.sparkSession.createDataFrame([(x,) for x in values], [col])
    return df.join(v, col, "left_semi")


def payments(entries: DataFrame, customers: DataFrame, invoice_headers: DataFrame, memo_headers: DataFrame,
             ids) -> DataFrame:
    """Q6: ledger entries with invoice/credit-memo headers (UNION distinct),
    restricted to a list of tax ids (the IN filter makes the outer join inner),
    DISTINCT rows, non-zero remaining amount."""
    hdr = invoice_headers.unionByName(memo_headers).distinct()
    j = (entries.join(customers, entries["customer_no"] == customers["no_"])
                .join(hdr, entries["document_no"] == hdr["factura"], "left"))
    j = filter_in_list(j, "nif", ids)
    out = j.select(F.coalesce(F.col("vat_registration_no_"), F.col("nif")).alias("cif_nif"),
                   F.left(F.col("due_date").cast("string"), F.lit(10)).alias("due_date"),
                   F.left(F.col("hdr_posting_date").cast("string"), F.lit(10)).alias("posting_date"),
                   F.col("remaining_amount").cast("decimal(16,2)").alias("remaining_amount")).distinct()
    return out.filter(F.col("remaining_amount") != 0)
