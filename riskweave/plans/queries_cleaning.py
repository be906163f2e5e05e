"""Registered queries: cleaning (C1-C3) and the cleaned customer table."""

from __future__ import annotations

from riskweave.operators import cleaning as C
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register


@register("normalise_category", O.with_testbed(
    f"SELECT cif_nif, {O.clean_province_sql('provincia')} AS provincia FROM tb_master"))
def q_normalise_category(spark, sf):
    return C.normalise_category(T.master(spark, sf).select("cif_nif", "provincia"), "provincia")


@register("correct_country", O.with_testbed(
    f"SELECT cif_nif, provincia, {O.portugal_sql('provincia', 'pais')} AS pais FROM tb_master"))
def q_correct_country(spark, sf):
    return C.correct_country(T.master(spark, sf).select("cif_nif", "provincia", "pais"))


@register("map_code_prefix", O.with_risk(
    f"SELECT cif_nif, {O.cnae_sector_sql('cnae')} AS cnae FROM customer_risk"))
def q_map_code_prefix(spark, sf):
    return C.map_code_prefix(T.customer_risk(spark, sf).select("cif_nif", "cnae"), "cnae")


@register("customer_risk_clean", O.with_risk(
    "SELECT * REPLACE ("
    f"{O.cnae_sector_sql('cnae')} AS cnae, {O.clean_province_sql('provincia')} AS provincia, "
    f"{O.portugal_sql('provincia', 'pais')} AS pais) FROM customer_risk"))
def q_customer_risk_clean(spark, sf):
    return C.clean_customer_table(T.customer_risk(spark, sf))
