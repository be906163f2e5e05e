"""Registered queries: scalar rules, filters, sampling and small reports (P, R, O4, U1, F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import exprs as X
from riskweave.operators import dedupe as D
from riskweave.operators import features as FE
from riskweave.operators import ledger as L
from riskweave.operators import topology as TP
from riskweave.plans import oracle as O
from riskweave.plans import queries_topology as QT
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register

_NID = "trim(upper(vat))"
_IDS_SQL = f"FROM tb_customers WHERE vat IS NOT NULL AND trim(vat) <> ''"


def _ids(spark, sf):
    c = T.customers(spark, sf)
    return c.filter(X.valid_id("vat_registration_no_")).select(
        "no_", X.normalise_id("vat_registration_no_").alias("cif_nif"), "c_mktsegment")


@register("country_from_tax_id", O.with_testbed(
    f"SELECT no_, {O._country(_NID, 'ESP')} AS pais_prefix, "
    f"CASE WHEN regexp_full_match({_NID}, '[A-Z]{{2}}[0-9]') THEN left({_NID}, 2) ELSE 'ESP' END AS pais_whole "
    + _IDS_SQL))
def q_country_from_tax_id(spark, sf):
    d = _ids(spark, sf)
    return d.select("no_", X.country_from_tax_id("cif_nif", "ESP").alias("pais_prefix"),
                    X.country_from_tax_id("cif_nif", "ESP", "whole").alias("pais_whole"))


@register("person_type", O.with_testbed(
    f"SELECT no_, CASE WHEN regexp_full_match({_NID}, '[0-9]{{8}}[A-Z]') THEN 'Persona' "
    f"WHEN regexp_full_match({_NID}, '[XYZ][0-9]{{7}}[A-Z]') THEN 'Persona' "
    f"WHEN regexp_full_match({_NID}, '[0-9]{{9}}') THEN 'Persona' ELSE 'Empresa' END AS tipo " + _IDS_SQL))
def q_person_type(spark, sf):
    return _ids(spark, sf).select("no_", X.person_type_from_id("cif_nif").alias("tipo"))


_KNOWN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Persona' WHEN 'AUTOMOBILE' THEN 'Empresa' END"


@register("company_only", O.with_testbed(
    f"SELECT no_, CASE WHEN t = 'Empresa' THEN sector WHEN t = 'Persona' THEN NULL "
    f"WHEN regexp_full_match(id, '[0-9]{{8}}[A-Z]') OR regexp_full_match(id, '[XYZ][0-9]{{7}}[A-Z]') "
    f"OR regexp_full_match(id, '[0-9]{{9}}') THEN NULL WHEN regexp_full_match(id, '[A-W][0-9]{{8}}') THEN sector "
    f"ELSE NULL END AS cnae, CASE WHEN t = 'Empresa' THEN sector WHEN t IS NULL AND "
    f"regexp_full_match(id, '[A-W][0-9]{{8}}') THEN sector ELSE NULL END AS sector_by_null_type "
    f"FROM (SELECT no_, {_NID} AS id, {_KNOWN} AS t, CAST(no_ % 90 + 10 AS VARCHAR) || '11' AS sector "
    + _IDS_SQL + ") s"))
def q_company_only(spark, sf):
    d = _ids(spark, sf)
    seg = F.col("c_mktsegment")
    t = F.when(seg == "BUILDING", "Persona").when(seg == "AUTOMOBILE", "Empresa")
    sector = F.concat((F.col("no_") % 90 + 10).cast("string"), F.lit("11"))
    return d.select("no_", X.company_only(sector, t, "cif_nif").alias("cnae"),
                    X.company_only_by_null_type(sector, t, "cif_nif").alias("sector_by_null_type"))


def _bday_sql(d, n):
    wd = f"(isodow({d}) - 1)"
    we = f"({wd} >= 5)"
    base = f"(CASE WHEN {we} THEN {d} - CAST({wd} - 4 AS INTEGER) ELSE {d} END)"
    steps = f"(CASE WHEN {we} THEN {n - 1} ELSE {n} END)"
    bwd = f"(CASE WHEN {we} THEN 4 ELSE {wd} END)"
    weeks = f"CAST(floor({steps} / 5) AS INTEGER)"
    rem = f"({steps} - {weeks} * 5)"
    return f"{base} - CAST({weeks} * 7 + {rem} + CASE WHEN {rem} > {bwd} THEN 2 ELSE 0 END AS INTEGER)"


@register("business_day_before", O.with_testbed(
    "SELECT o_orderkey, " + ", ".join(f"{_bday_sql('CAST(o_orderdate AS DATE)', n)} AS bday_{n}" for n in (1, 3, 7))
    + ", CAST(o_orderdate AS DATE) - 1 AS day_1 FROM orders"))
def q_business_day_before(spark, sf):
    o = T.table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", *[X.business_day_before(d, n).alias(f"bday_{n}") for n in (1, 3, 7)],
                    X.day_before(d, 1).alias("day_1"))


@register("overdue_invoices", O.with_testbed(
    "SELECT * FROM tb_invoices WHERE saldo_pendiente > 0 AND dias_vencido > 60"))
def q_overdue_invoices(spark, sf):
    return L.overdue_invoices(T.invoices(spark, sf), 60)


@register("union_all", O.with_testbed("SELECT * FROM tb_entries"))
def q_union_all(spark, sf):
    return T.ledger_entries(spark, sf)


@register("plain_dates", O.with_risk(
    "SELECT cif_nif, CAST(year(fecha_creacion) AS DOUBLE) AS fecha_anio, CAST(month(fecha_creacion) AS DOUBLE) "
    "AS fecha_mes, CAST(dayofyear(fecha_creacion) AS DOUBLE) AS fecha_dia_anio FROM customer_risk"))
def q_plain_dates(spark, sf):
    df, names = FE.plain_date_features(T.customer_risk(spark, sf).select("cif_nif", "fecha_creacion"),
                                       "fecha_creacion")
    return df.select("cif_nif", *names)


_SAMPLE_N, _SEED = 200, 42


def _md5(col):
    return f"md5(CAST({col} AS VARCHAR) || '|{_SEED}')"


@register("stratified_sample", O.with_risk(f"""
SELECT cif_nif, es_moroso FROM (
  SELECT cif_nif, es_moroso, row_number() OVER (PARTITION BY es_moroso ORDER BY {_md5('cif_nif')}, cif_nif) AS rk
  FROM customer_risk) t, q
WHERE rk <= CASE WHEN es_moroso THEN qpos ELSE qneg END""", """
q0 AS (SELECT count(*) AS n, sum(CAST(es_moroso AS INT)) AS pos FROM customer_risk),
q AS (SELECT least(pos, CAST(floor(200 * pos / n + 0.5) AS BIGINT)) AS qpos,
             least(n - pos, 200 - least(pos, CAST(floor(200 * pos / n + 0.5) AS BIGINT))) AS qneg FROM q0)"""))
def q_stratified_sample(spark, sf):
    return D.stratified_sample(T.customer_risk(spark, sf).select("cif_nif", "es_moroso"), "cif_nif", "es_moroso",
                               _SAMPLE_N, _SEED)


@register("uniform_sample", O.with_risk(
    f"SELECT cif_nif FROM customer_risk ORDER BY {_md5('cif_nif')}, cif_nif LIMIT {_SAMPLE_N}"))
def q_uniform_sample(spark, sf):
    return D.uniform_sample(T.customer_risk(spark, sf).select("cif_nif"), "cif_nif", _SAMPLE_N, _SEED)


@register("top_nodes", O.with_risk(
    "SELECT node_id, size, round(tasa, 6) AS tasa FROM nodes ORDER BY tasa DESC, size DESC, node_id LIMIT 10",
    QT._LENS_CTES + "," + QT._NODES))
def q_top_nodes(spark, sf):
    _, nodes, _ = QT._graph(spark, sf)
    return TP.top_nodes(nodes).select("node_id", "size", F.round("tasa", 6).alias("tasa"))
