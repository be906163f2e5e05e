"""Registered queries: ledger unification and the flagship (Q1-Q4, A1-A3, W, U, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import ledger as L
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register


@register("customer_risk", O.with_risk("SELECT * FROM customer_risk"))
def q_customer_risk(spark, sf):
    return T.customer_risk(spark, sf)


@register("customer_master", O.with_testbed("SELECT * FROM tb_master"))
def q_customer_master(spark, sf):
    return T.master(spark, sf)


@register("unified_invoices", O.with_testbed("SELECT * FROM tb_invoices"))
def q_unified_invoices(spark, sf):
    return T.invoices(spark, sf)


@register("delinquent_invoices", O.with_risk("""
SELECT DISTINCT cif_nif, numero_factura, fecha_vencimiento, saldo_pendiente, dias_vencido, mes_ano_emision
FROM inv_marks WHERE late60 OR late90"""))
def q_delinquent_invoices(spark, sf):
    return L.delinquent_invoices(T.invoices(spark, sf))


@register("invoice_counts", O.with_risk("""
SELECT cif_nif, n_all AS n_facturas_totales, n_open AS n_facturas_vencidas, n_late AS n_facturas_morosas
FROM inv_sums"""))
def q_invoice_counts(spark, sf):
    return L.invoice_counts(T.invoices(spark, sf))


@register("open_balance", O.with_risk(
    "SELECT cif_nif, CAST(owed AS DECIMAL(26,2)) AS saldo_pendiente_total FROM inv_sums WHERE owed IS NOT NULL"))
def q_open_balance(spark, sf):
    return L.open_balance(T.invoices(spark, sf))


@register("max_days_late", O.with_risk(
    "SELECT cif_nif, worst AS dias_mora_maximo FROM inv_sums WHERE worst IS NOT NULL"))
def q_max_days_late(spark, sf):
    return L.max_days_late(T.invoices(spark, sf))


@register("union_distinct", O.with_risk("SELECT cif_nif FROM inv_sums WHERE any60 OR any90"))
def q_union_distinct(spark, sf):
    inv = T.invoices(spark, sf)
    crit = L.Criteria()
    return L.union_distinct([inv.filter(crit.crit1()).select("cif_nif"),
                             inv.filter(crit.crit2()).select("cif_nif")])


@register("latest_by", O.with_testbed("SELECT * FROM tb_crm"))
def q_latest_by(spark, sf):
    return T.crm(spark, sf)


@register("latest_attributes", O.with_testbed("SELECT * FROM tb_rating"))
def q_latest_attributes(spark, sf):
    return T.rating(spark, sf)


@register("snowflake_join", O.with_testbed("""
SELECT cif_nif_raw, tipo_persona, id_rating_request, id_evaluacion, fecha_evaluacion, codigo_cnae,
       fecha_constitucion FROM tb_rating_chain"""))
def q_snowflake_join(spark, sf):
    return T.rating_chain(T.rating_tables(spark, sf)).select(
        "cif_nif_raw", "tipo_persona", "id_rating_request", "id_evaluacion", "fecha_evaluacion",
        "codigo_cnae", "fecha_constitucion")


@register("lookup_join", O.with_testbed("""
SELECT c.vat AS document_number, CAST(e.user_id % 25 AS INTEGER) AS sector_id, n.n_name AS sector_name,
       e.event_id
FROM events e JOIN tb_customers c ON e.user_id = c.no_
LEFT JOIN nation n ON n.n_nationkey = CAST(e.user_id % 25 AS INTEGER)"""))
def q_lookup_join(spark, sf):
    return T.crm_accounts(spark, sf).select("document_number", "sector_id", "sector_name", "event_id")


# W1 on the natural duplicate key of lineitem: (l_orderkey, l_linenumber) is not
# unique; keep returned lines first (R, A, N), then a total order on the rest.
_LI_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_linestatus"]


@register("dedupe_by_priority", """
SELECT * EXCLUDE (rn, prio) FROM (
  SELECT *, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS prio,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
           CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END,
           l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) AS rn
  FROM lineitem) t WHERE rn = 1""")
def q_dedupe_by_priority(spark, sf):
    from riskweave.operators.dedupe import dedupe_by_priority
    li = T.table(spark, sf, "lineitem")
    rf = F.col("l_returnflag")
    prio = F.when(rf == "R", 1).when(rf == "A", 2).otherwise(3)
    return dedupe_by_priority(li, ["l_orderkey", "l_linenumber"], [prio, *_LI_ORDER])


@register("order_customers", O.with_risk(
    "SELECT * FROM customer_risk ORDER BY es_moroso DESC, dias_mora_maximo DESC, cif_nif"))
def q_order_customers(spark, sf):
    return L.order_customers(T.customer_risk(spark, sf))


@register("flag_by_presence", O.with_risk("""
SELECT cif_nif, cif_nif IN (SELECT cif_nif FROM inv_marks WHERE late60) AS es_moroso_60d FROM tb_master"""))
def q_flag_by_presence(spark, sf):
    inv = T.invoices(spark, sf)
    return L.flag_by_presence(T.master(spark, sf).select("cif_nif"),
                              inv.filter(L.Criteria().crit1()), "cif_nif", "es_moroso_60d")


@register("ledger_join", O.with_testbed("""
SELECT e.customer_no, e.document_no, e.fuente, c.vat AS vat_registration_no_
FROM tb_entries e JOIN tb_customers c ON e.customer_no = c.no_"""))
def q_ledger_join(spark, sf):
    c = T.customers(spark, sf).select("no_", "vat_registration_no_")
    return L.ledger_join(T.ledger_entries(spark, sf), c).select(
        "customer_no", "document_no", "fuente", "vat_registration_no_")
