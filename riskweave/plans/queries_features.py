"""Registered queries: feature engineering (F1-F12, A11, A12) on the cleaned customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import cleaning as C
from riskweave.operators import features as FE
from riskweave.plans import oracle as O
from riskweave.plans import testbed as T
from riskweave.plans.catalog import register

R = 6  # derived doubles are rounded to 6 places in both engines


def customers_clean(spark, sf):
    """The cleaned customer table, materialised once: the feature queries make
    two passes over it (statistics or category choice, then the output)."""
    from riskweave.session import cut_lineage
    return cut_lineage(C.clean_customer_table(T.customer_risk(spark, sf)))


def _round(df, cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), R) for c in cols})


def _long(df, id_col, names):
    return (df.unpivot([id_col], names, "feature", "value")
              .withColumn("value", F.round(F.col("value"), R)))


def _rsql(expr):
    return f"round(CAST({expr} AS DOUBLE), {R})"


_CYC = O.cyclic_sql()


@register("cyclic_dates", O.with_risk(
    "SELECT cif_nif, " + ", ".join(f"{_rsql(e)} AS {k}" for k, e in _CYC.items()) + " FROM crc", O.clean_cte()))
def q_cyclic_dates(spark, sf):
    df, names = FE.cyclic_date_features(customers_clean(spark, sf).select("cif_nif", "fecha_creacion"),
                                        "fecha_creacion")
    return _round(df.select("cif_nif", *names), names)


@register("one_hot_top_n", O.with_risk(
    O.one_hot_long_sql("top_prov", "provincia", "prov", "Otras"),
    O.clean_cte() + "," + O.top_ctes("top_prov", "provincia", 10)))
def q_one_hot_top_n(spark, sf):
    df = customers_clean(spark, sf).select("cif_nif", "provincia")
    out, names = FE.one_hot_top_n(df, "provincia", 10, "prov", "Otras")
    return _long(out.select("cif_nif", *names), "cif_nif", names)


@register("one_hot_min_share", O.with_risk(
    O.one_hot_long_sql("top_cnae", "cnae", "cnae", "Otras"),
    O.clean_cte() + "," + O.top_ctes("top_cnae", "cnae", None, min_share=0.01)))
def q_one_hot_min_share(spark, sf):
    df = customers_clean(spark, sf).select("cif_nif", "cnae")
    out, names = FE.one_hot_min_share(df, "cnae", "cnae", 0.01, "Otras")
    return _long(out.select("cif_nif", *names), "cif_nif", names)


@register("one_hot_all", O.with_risk(
    O.one_hot_long_sql("all_tipo", "tipo", "tipo", None),
    O.clean_cte() + ", all_tipo AS (SELECT DISTINCT tipo AS v FROM crc WHERE tipo IS NOT NULL)"))
def q_one_hot_all(spark, sf):
    df = customers_clean(spark, sf).select("cif_nif", "tipo")
    out, names = FE.one_hot_all(df, "tipo", "tipo")
    return _long(out.select("cif_nif", *names), "cif_nif", names)


_IMP_COLS = O.NUMERIC6 + list(_CYC)
_IMP_SRC = ("imp_src AS (SELECT cif_nif, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in O.NUMERIC6) + ", "
            + ", ".join(f"{e} AS {k}" for k, e in _CYC.items()) + " FROM crc)")


@register("impute", O.with_risk(
    "SELECT cif_nif, " + ", ".join(
        f"{_rsql(f'COALESCE({c}, (SELECT median({c}) FROM imp_src))')} AS {c}" for c in _IMP_COLS)
    + " FROM imp_src", O.clean_cte() + "," + _IMP_SRC))
def q_impute(spark, sf):
    df = customers_clean(spark, sf)
    df, temporal = FE.cyclic_date_features(df.select("cif_nif", *FE.NUMERIC_FEATURES, "fecha_creacion"),
                                           "fecha_creacion")
    out = FE.impute(df, FE.NUMERIC_FEATURES + temporal)
    return _round(out.select("cif_nif", *_IMP_COLS), _IMP_COLS)


@register("impute_with_indicator", O.with_risk(
    "SELECT cif_nif, CAST(fecha_anio IS NOT NULL AS DOUBLE) AS fecha_anio_disponible, "
    "round(COALESCE(fecha_anio, (SELECT median(fecha_anio) FROM imp_src)), 6) AS fecha_anio FROM imp_src",
    O.clean_cte() + "," + _IMP_SRC))
def q_impute_with_indicator(spark, sf):
    df, _ = FE.cyclic_date_features(customers_clean(spark, sf).select("cif_nif", "fecha_creacion"),
                                    "fecha_creacion")
    out, flags = FE.impute_with_indicator(df.select("cif_nif", "fecha_anio"), ["fecha_anio"])
    return _round(out.select("cif_nif", "fecha_anio_disponible", "fecha_anio"), ["fecha_anio"])


_Z_STATS = ("zs AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in O.NUMERIC6)
    + " FROM crc)")


def _z_sql(c):
    return f"(CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END)"


@register("zscore", O.with_risk(
    "SELECT cif_nif, " + ", ".join(f"round({_z_sql(c)}, 6) AS {c}" for c in O.NUMERIC6) + " FROM crc, zs",
    O.clean_cte() + "," + _Z_STATS))
def q_zscore(spark, sf):
    df = customers_clean(spark, sf).select("cif_nif", *FE.NUMERIC_FEATURES)
    return _round(FE.zscore(df, FE.NUMERIC_FEATURES), FE.NUMERIC_FEATURES)


@register("l2_norm", O.with_risk(
    "SELECT cif_nif, round(sqrt(" + " + ".join(f"({_z_sql(c)}) * ({_z_sql(c)})" for c in O.NUMERIC6)
    + "), 6) AS norm FROM crc, zs", O.clean_cte() + "," + _Z_STATS))
def q_l2_norm(spark, sf):
    df = customers_clean(spark, sf).select("cif_nif", *FE.NUMERIC_FEATURES)
    z = FE.assemble(FE.zscore(df, FE.NUMERIC_FEATURES), FE.NUMERIC_FEATURES)
    return z.select("cif_nif", F.round(FE.l2_norm("features"), R).alias("norm"))


@register("value_counts", O.with_risk(
    "SELECT provincia AS value, CAST(count(*) AS BIGINT) AS n FROM crc WHERE provincia IS NOT NULL "
    "GROUP BY provincia ORDER BY n DESC, value", O.clean_cte()))
def q_value_counts(spark, sf):
    from riskweave.operators.quality import value_counts
    return value_counts(customers_clean(spark, sf), "provincia")


@register("column_median", O.with_risk(
    "SELECT " + ", ".join(f"round(median(CAST({c} AS DOUBLE)), 6) AS {c}" for c in O.NUMERIC6) + " FROM crc",
    O.clean_cte()))
def q_column_median(spark, sf):
    med = FE.column_medians(customers_clean(spark, sf), FE.NUMERIC_FEATURES)
    return spark.range(1).select(*[F.round(F.lit(med[c]).cast("double"), R).alias(c) for c in FE.NUMERIC_FEATURES])


# the presets in long form (imputed, unscaled).
_PLAIN = {"fecha_anio": "CAST(year(fecha_creacion) AS DOUBLE)", "fecha_mes": "CAST(month(fecha_creacion) AS DOUBLE)",
          "fecha_dia_anio": "CAST(dayofyear(fecha_creacion) AS DOUBLE)"}
_PLAIN_SRC = ("plain_src AS (SELECT cif_nif, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in O.NUMERIC6) + ", "
              + ", ".join(f"{e} AS {k}" for k, e in _PLAIN.items()) + " FROM crc)")


def _filled(src: str, cols) -> list[str]:
    return [f"SELECT cif_nif, '{c}' AS feature, {_rsql(f'COALESCE({c}, (SELECT median({c}) FROM {src}))')} AS value "
            f"FROM {src}" for c in cols]


def _all_values(name: str, col: str) -> str:
    return f"{name} AS (SELECT DISTINCT {col} AS v FROM crc WHERE {col} IS NOT NULL)"


_PROV, _CNAE = O.top_ctes("t_prov", "provincia", 10), O.top_ctes("t_cnae", "cnae", 5)
_PROV_ROWS = O.one_hot_long_sql("t_prov", "provincia", "prov", "Otras")
_CNAE_ROWS = O.one_hot_long_sql("t_cnae", "cnae", "cnae", "Otros")
_TIPO_ROWS = O.one_hot_long_sql("t_tipo", "tipo", "tipo", None)

_FS_CTES = ",".join([O.clean_cte(), _PROV, _CNAE, O.top_ctes("t_pais", "pais", 3), _all_values("t_tipo", "tipo"), _IMP_SRC])
_FS_SQL = " UNION ALL ".join(_filled("imp_src", _IMP_COLS) + [
    _PROV_ROWS, _CNAE_ROWS, _TIPO_ROWS, O.one_hot_long_sql("t_pais", "pais", "pais", "Otros")])


def _preset(spark, sf, variant):
    fs, names = FE.feature_set(customers_clean(spark, sf), variant)
    return _long(fs.select("cif_nif", *names), "cif_nif", names)


@register("feature_set", O.with_risk(_FS_SQL, _FS_CTES))
def q_feature_set(spark, sf):
    return _preset(spark, sf, "cluster")


MAPPER_SQL = " UNION ALL ".join(_filled("imp_src", _IMP_COLS) + [_PROV_ROWS, _CNAE_ROWS])
MAPPER_CTES = ",".join([O.clean_cte(), _PROV, _CNAE, _IMP_SRC])


@register("feature_set_mapper", O.with_risk(MAPPER_SQL, MAPPER_CTES))
def q_feature_set_mapper(spark, sf):
    return _preset(spark, sf, "mapper")


@register("feature_set_numeric", O.with_risk(
    " UNION ALL ".join(_filled("plain_src", O.NUMERIC6)), O.clean_cte() + "," + _PLAIN_SRC))
def q_feature_set_numeric(spark, sf):
    return _preset(spark, sf, "numeric")


@register("feature_set_homology", O.with_risk(
    " UNION ALL ".join(_filled("plain_src", [*O.NUMERIC6, *_PLAIN]) + [
        _PROV_ROWS, O.one_hot_long_sql("t_pais", "pais", "pais", None), _TIPO_ROWS,
        O.one_hot_long_sql("t_cnae", "cnae", "cnae", "Otras")]),
    ",".join([O.clean_cte(), _PROV, _all_values("t_pais", "pais"), _all_values("t_tipo", "tipo"),
              O.top_ctes("t_cnae", "cnae", None, min_share=0.01), _PLAIN_SRC])))
def q_feature_set_homology(spark, sf):
    return _preset(spark, sf, "homology")


# The clustering matrix (z-scored, rounded to 6 places, features in name order) through DBSCAN.
MATRIX_EPS, MATRIX_MIN = 2.0, 10
_MATRIX_CTES = _FS_CTES + f""",
fs AS MATERIALIZED ({_FS_SQL}),
fs_stats AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM fs GROUP BY feature),
fmat AS MATERIALIZED (SELECT cif_nif AS id, list(round((value - m) / if(s = 0, 1.0, s), 6) ORDER BY feature) AS f
         FROM fs JOIN fs_stats USING (feature) GROUP BY cif_nif)"""


@register("dbscan_matrix", O.with_risk(
    "SELECT * FROM dres", _MATRIX_CTES + "," + O.dbscan_sql("fmat", MATRIX_EPS, MATRIX_MIN, "'-1'")))
def q_dbscan_matrix(spark, sf):
    from riskweave.operators.cluster import dbscan
    fs, names = FE.feature_set(customers_clean(spark, sf), "cluster")
    z = _round(FE.zscore(_round(fs, names), names), names)
    return dbscan(FE.assemble(z, sorted(names)).select(F.col("cif_nif").alias("id"), "features"),
                  "id", MATRIX_EPS, MATRIX_MIN)
