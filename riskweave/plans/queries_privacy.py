"""Registered queries: pseudonymisation and its validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import privacy as P
from riskweave.operators.ledger import id_overlap
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register

# Test-only secrets: real callers pass their own and never log them.
SALT, FACTOR, DAYS = "rw-test-salt", 1.137, 45


def _cr(spark, sf):
    return T.customer_risk(spark, sf)


@register("province_code", O.with_testbed(
    f"SELECT no_, vat, {O.province_code_sql('vat')} AS code FROM tb_customers"))
def q_province_code(spark, sf):
    c = T.customers(spark, sf)
    return c.select("no_", F.col("vat_registration_no_").alias("vat"), P.province_code("vat_registration_no_").alias("code"))


@register("synthetic_id", O.with_testbed(
    f"SELECT no_, {O.synthetic_id_sql('vat', SALT)} AS synthetic FROM tb_customers"))
def q_synthetic_id(spark, sf):
    c = T.customers(spark, sf)
    return c.select("no_", P.synthetic_id("vat_registration_no_", SALT).alias("synthetic"))


@register("id_mapping", O.with_risk("SELECT original, synthetic FROM idm", O.id_mapping_cte("customer_risk", "cif_nif", SALT)))
def q_id_mapping(spark, sf):
    return P.id_mapping(_cr(spark, sf), "cif_nif", SALT)


@register("perturb", O.with_risk(
    "SELECT cif_nif, CAST(round(saldo_pendiente_total * CAST(1.137 AS DECIMAL(10,6)), 2) AS DECIMAL(26,2)) "
    "AS saldo_pendiente_total FROM customer_risk"))
def q_perturb(spark, sf):
    out, _ = P.perturb(_cr(spark, sf).select("cif_nif", "saldo_pendiente_total"), FACTOR)
    return out


@register("shift_dates", O.with_risk(
    f"SELECT cif_nif, TRY_CAST(CAST(fecha_creacion AS VARCHAR) AS DATE) + {DAYS} AS fecha_creacion FROM customer_risk"))
def q_shift_dates(spark, sf):
    out, _ = P.shift_dates(_cr(spark, sf).select("cif_nif", "fecha_creacion"), DAYS)
    return out


_ANON_SQL = ("SELECT m.synthetic AS cif_nif, c.* EXCLUDE (cif_nif, saldo_pendiente_total, fecha_creacion), "
             "CAST(round(c.saldo_pendiente_total * CAST(1.137 AS DECIMAL(10,6)), 2) AS DECIMAL(26,2)) "
             f"AS saldo_pendiente_total, TRY_CAST(CAST(c.fecha_creacion AS VARCHAR) AS DATE) + {DAYS} AS fecha_creacion "
             "FROM customer_risk c LEFT JOIN idm m ON c.cif_nif = m.original")


@register("anonymise", O.with_risk(_ANON_SQL, O.id_mapping_cte("customer_risk", "cif_nif", SALT)))
def q_anonymise(spark, sf):
    out, _ = P.anonymise(_cr(spark, sf), "cif_nif", SALT, FACTOR, DAYS)
    return out


@register("province_preserved", O.with_risk(f"""
SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (WHERE
  (CASE WHEN {O.province_code_sql('original')} = '' THEN '99' ELSE {O.province_code_sql('original')} END) =
  (CASE WHEN regexp_matches({O._cid('original')}, '^\\p{{L}}') AND substring({O._cid('original')}, 1, 1)
             NOT IN ('X', 'Y', 'Z') THEN substring(synthetic, 2, 2) ELSE substring(synthetic, 1, 2) END)) AS BIGINT)
  AS n_preserved
FROM idm WHERE {O._cid('original')} <> ''""", O.id_mapping_cte("customer_risk", "cif_nif", SALT)))
def q_province_preserved(spark, sf):
    return P.province_preserved(P.id_mapping(_cr(spark, sf), "cif_nif", SALT))


@register("distinct_ids_equal", O.with_risk(
    "SELECT count(DISTINCT cif_nif) AS before, count(DISTINCT synthetic) AS after, "
    "count(DISTINCT cif_nif) = count(DISTINCT synthetic) AS equal "
    "FROM customer_risk c LEFT JOIN idm m ON c.cif_nif = m.original",
    O.id_mapping_cte("customer_risk", "cif_nif", SALT)))
def q_distinct_ids_equal(spark, sf):
    cr = _cr(spark, sf).select("cif_nif")
    return P.distinct_ids_equal(cr, P.pseudonymise(cr, P.id_mapping(cr, "cif_nif", SALT), "cif_nif"), "cif_nif")


@register("id_overlap", O.with_risk(
    "SELECT cif_nif FROM customer_risk INTERSECT SELECT synthetic FROM idm",
    O.id_mapping_cte("customer_risk", "cif_nif", SALT)))
def q_id_overlap(spark, sf):
    cr = _cr(spark, sf)
    mp = P.id_mapping(cr, "cif_nif", SALT).select(F.col("synthetic").alias("cif_nif"))
    return id_overlap(cr, mp, "cif_nif")


def _dist_sql(name, col, tol=0, tol_total=0):
    return (f"SELECT '{name}' AS \"check\", COALESCE(max(d), 0) <= {tol} AND COALESCE(sum(d), 0) <= {tol_total} AS ok, "
            f"printf('max diff %d, total %d', CAST(COALESCE(max(d), 0) AS BIGINT), CAST(COALESCE(sum(d), 0) AS BIGINT)) "
            f"AS detail FROM (SELECT abs(COALESCE(a.n, 0) - COALESCE(b.n, 0)) AS d FROM "
            f"(SELECT {col} AS k, count(*) AS n FROM orig GROUP BY {col}) a FULL OUTER JOIN "
            f"(SELECT {col} AS k, count(*) AS n FROM anon GROUP BY {col}) b ON a.k IS NOT DISTINCT FROM b.k) t")


_VALIDATE_SQL = " UNION ALL ".join([
    "SELECT 'distinct_ids' AS \"check\", a = b AS ok, printf('%d vs %d', a, b) AS detail FROM "
    "(SELECT (SELECT count(DISTINCT cif_nif) FROM orig) AS a, (SELECT count(DISTINCT cif_nif) FROM anon) AS b) t",
    "SELECT 'row_count', a = b, printf('%d vs %d', a, b) FROM "
    "(SELECT (SELECT count(*) FROM orig) AS a, (SELECT count(*) FROM anon) AS b) t",
    _dist_sql("label_distribution", "es_moroso"),
    _dist_sql("province_distribution", "provincia", 5, 10),
    "SELECT 'column_sets', true, 'removed 0, added 0'",
    "SELECT 'no_common_ids', n = 0, printf('%d common', n) FROM "
    "(SELECT count(*) AS n FROM (SELECT cif_nif FROM orig INTERSECT SELECT cif_nif FROM anon) i) t",
    _dist_sql("person_type_distribution", "tipo"),
])
_VALIDATE_CTES = (O.clean_cte() + "," + O.id_mapping_cte("crc", "cif_nif", SALT)
                  + ", orig AS (SELECT * FROM crc), anon AS (SELECT m.synthetic AS cif_nif, c.es_moroso, "
                    "c.provincia, c.tipo FROM crc c LEFT JOIN idm m ON c.cif_nif = m.original)")


@register("validate_anonymisation", O.with_risk(_VALIDATE_SQL, _VALIDATE_CTES))
def q_validate(spark, sf):
    from riskweave.operators.cleaning import clean_customer_table
    cr = clean_customer_table(_cr(spark, sf))
    anon, _ = P.anonymise(cr, "cif_nif", SALT, FACTOR, DAYS)
    return P.validate_anonymisation(cr, anon, "cif_nif", "es_moroso")


@register("check_feature_matrix")
def q_check_feature_matrix(spark, sf):
    from riskweave.operators import features as FE
    from riskweave.operators.cleaning import clean_customer_table
    m, names = FE.matrix(clean_customer_table(_cr(spark, sf)), "homology")
    return P.check_feature_matrix(m, len(names))
