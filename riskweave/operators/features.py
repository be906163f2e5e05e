"""Feature engineering.

A feature matrix is a DataFrame with an id column, the label, one double
column per feature (ordered names list returned alongside) and, after
:func:`assemble`, a ``features`` array<double> column used by the
distance-based operators. Conversion to MLlib vectors happens only at
MLlib's door (PCA, KMeans).

Category choices (top-n, min share) are decided by one small aggregate whose
result - at most n names - is brought to the driver once; every per-row
computation stays a native column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_FEATURES = ["saldo_pendiente_total", "n_facturas_totales", "n_facturas_vencidas",
                    "n_facturas_morosas", "proporcion_facturas_morosas", "dias_mora_maximo"]
# Label-derived columns (excluded for a non-tautological Mapper control run).
LABEL_DERIVED = ["n_facturas_morosas", "proporcion_facturas_morosas", "dias_mora_maximo"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F1 / F2 ---------------------------------------------------------------------
def cyclic_date_features(df: DataFrame, date_col: str, prefix: str = "fecha") -> tuple[DataFrame, list[str]]:
    """Year plus sin/cos of 2*pi*month/12 and 2*pi*dayofyear/365."""
    d = F.try_to_date(_c(date_col).cast("string"))
    two_pi = 2 * math.pi
    cols = {
        f"{prefix}_anio": F.year(d).cast("double"),
        "mes_sin": F.sin(F.lit(two_pi) * F.month(d) / 12),
        "mes_cos": F.cos(F.lit(two_pi) * F.month(d) / 12),
        "dia_sin": F.sin(F.lit(two_pi) * F.dayofyear(d) / 365),
        "dia_cos": F.cos(F.lit(two_pi) * F.dayofyear(d) / 365),
    }
    return df.withColumns(cols), list(cols)


def plain_date_features(df: DataFrame, date_col: str, prefix: str = "fecha") -> tuple[DataFrame, list[str]]:
    """Year, month, day of year; unparsable dates -> null (imputed later)."""
    d = F.try_to_date(_c(date_col).cast("string"))
    cols = {f"{prefix}_anio": F.year(d).cast("double"), f"{prefix}_mes": F.month(d).cast("double"),
            f"{prefix}_dia_anio": F.dayofyear(d).cast("double")}
    return df.withColumns(cols), list(cols)


# A12-based category choice ------------------------------------------------------
def top_values(df: DataFrame, col: str, n: int | None = None, min_count: int | None = None) -> list:
    """Most frequent non-null values, count desc then value asc (ties broken
    by value, the reference's order was arbitrary). Partial aggregate; at most
    n rows reach the driver."""
    vc = df.filter(_c(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    if min_count is not None:
        vc = vc.filter(F.col("_n") >= min_count)
    vc = vc.orderBy(F.col("_n").desc(), F.col(col).asc())
    rows = vc.limit(n).collect() if n is not None else vc.collect()
    return [r[0] for r in rows]


def feature_name(prefix: str, value) -> str:
    return f"{prefix}_{value}".replace(" ", "_")


def _indicators(df, col, values, prefix, other) -> tuple[DataFrame, list[str]]:
    cols = {}
    for v in values:
        cols[feature_name(prefix, v)] = F.coalesce((_c(col) == F.lit(v)).cast("double"), F.lit(0.0))
    if other is not None:
        # null is "other": NOT IN over null would give null, so coalesce to 1
        cols[f"{prefix}_{other}"] = F.coalesce((~_c(col).isin(list(values))).cast("double"), F.lit(1.0)) \
            if values else F.lit(1.0)
    return df.withColumns(cols), list(cols)


# F3 / F4 / F5 -------------------------------------------------------------------
def one_hot_top_n(df: DataFrame, col: str, n: int, prefix: str, other: str = "Otros"):
    return _indicators(df, col, top_values(df, col, n), prefix, other)


def one_hot_all(df: DataFrame, col: str, prefix: str):
    """Every non-null category (sorted by value), no 'other' column.

    The output has one column per value, so the list of values is the schema
    and reaches the driver whole; for columns of many values take
    :func:`one_hot_top_n` or :func:`one_hot_min_share`.
    """
    vals = [r[0] for r in df.filter(_c(col).isNotNull()).select(col).distinct().orderBy(col).collect()]
    return _indicators(df, col, vals, prefix, None)


def one_hot_min_share(df: DataFrame, col: str, prefix: str, share: float = 0.01, other: str = "Otras"):
    """Categories with count >= int(share * n) plus 'other' (at most 1/share
    categories can pass; where the threshold rounds to 0 the table itself has
    fewer than 1/share rows)."""
    n = df.count()
    return _indicators(df, col, top_values(df, col, None, int(share * n)), prefix, other)


# A11 / F6 / F7 -------------------------------------------------------------------
def column_medians(df: DataFrame, cols: Sequence[str], approx: int | None = None) -> dict[str, float | None]:
    """Medians (linear interpolation, as numpy/pandas) of all columns in one pass over their
    distinct values; exact, or a sketch of accuracy ``approx``. One number per column comes back."""
    from riskweave.operators.ranks import quantiles
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    found = {r["variable"]: r["q"][0] for r in quantiles(long, ["variable"], "value", [0.5], approx).collect()}
    return {c: found.get(c) for c in cols}


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Median for numeric columns, 0 for indicator columns."""
    med = column_medians(df, list(numeric))
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c] if med[c] is not None else 0.0))
             for c in numeric}
    fills.update({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in categorical})
    return df.withColumns(fills)


def impute_with_indicator(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``{col}_disponible`` (1 if present) then median fill."""
    flags = {f"{c}_disponible": F.col(c).isNotNull().cast("double") for c in cols}
    return impute(df.withColumns(flags), cols), list(flags)


# F8 / F9 / F12 -------------------------------------------------------------------
def zscore_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (one aggregate, 2*d scalars)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in cols}


def zscore(df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> DataFrame:
    """(x - mean) / std with the *population* std and std == 0 -> 1.

    Spark's StandardScaler uses the sample std, which would shift every
    distance threshold; hence our own.
    """
    stats = stats or zscore_stats(df, cols)
    out = {}
    for c in cols:
        m, s = stats[c]
        out[c] = (F.col(c).cast("double") - F.lit(m)) / F.lit(s if s not in (0, None) else 1.0)
    return df.withColumns(out)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def l2_norm(vec="features") -> Column:
    return F.sqrt(F.aggregate(_c(vec), F.lit(0.0), lambda acc, x: acc + x * x))


# F10 ---------------------------------------------------------------------------
def feature_set(df: DataFrame, variant: str = "cluster", id_col: str = "cif_nif",
                label_col: str = "es_moroso", exclude_label_features: bool = False
                ) -> tuple[DataFrame, list[str]]:
    """Presets of the reference's four feature builders.

    cluster : 6 numeric + 5 cyclic date + top-10 province (+Otras) + top-5
              sector (+Otros) + every type + top-3 country (+Otros)
    mapper  : numeric (optionally without label-derived ones) + 5 cyclic date
              + top-10 province (+Otras) + top-5 sector (+Otros)
    homology: 6 numeric + 3 plain date + top-10 province (+Otras) + every
              country + every type + sectors >= 1 % (+Otras)
    numeric : every numeric column except id and label
    Returns (id, label, features...) unscaled but imputed, and the names.
    """
    if variant == "numeric":
        skip = {id_col, label_col}
        names = [f.name for f in df.schema.fields
                 if f.name not in skip and f.dataType.typeName() in
                 ("double", "float", "integer", "long", "short", "decimal")]
        return impute(df.select(id_col, label_col, *names), names), names
    numeric = [c for c in NUMERIC_FEATURES if c in df.columns]
    if variant == "mapper" and exclude_label_features:
        numeric = [c for c in numeric if c not in LABEL_DERIVED]
    base = df.select(id_col, label_col, *numeric, "fecha_creacion", "provincia", "cnae", "tipo", "pais")
    # several small actions follow (top-n per category, medians): materialise
    # the input once instead of recomputing its whole lineage for each
    from riskweave.session import cut_lineage
    base = cut_lineage(base)
    if variant in ("cluster", "mapper"):
        base, temporal = cyclic_date_features(base, "fecha_creacion")
    elif variant == "homology":
        base, temporal = plain_date_features(base, "fecha_creacion")
    else:
        raise ValueError(f"unknown variant {variant}")
    base, prov = one_hot_top_n(base, "provincia", 10, "prov", "Otras")
    cats = list(prov)
    if variant in ("cluster", "mapper"):
        base, cn = one_hot_top_n(base, "cnae", 5, "cnae", "Otros")
        cats += cn
    if variant == "cluster":
        base, tp = one_hot_all(base, "tipo", "tipo")
        base, pa = one_hot_top_n(base, "pais", 3, "pais", "Otros")
        cats += tp + pa
    if variant == "homology":
        base, pa = one_hot_all(base, "pais", "pais")
        base, tp = one_hot_all(base, "tipo", "tipo")
        base, cn = one_hot_min_share(base, "cnae", "cnae", 0.01, "Otras")
        cats += pa + tp + cn
    names = numeric + temporal + cats
    names = list(dict.fromkeys(names))  # a category may collide with a fixed name
    out = base.select(id_col, label_col, *[F.col(c).cast("double").alias(c) for c in names])
    return impute(out, numeric + temporal, cats), names


def safe_name(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def matrix(df: DataFrame, variant: str = "cluster", id_col: str = "cif_nif", label_col: str = "es_moroso",
           exclude_label_features: bool = False, scale: bool = True) -> tuple[DataFrame, list[str]]:
    """feature_set -> z-score -> assemble: (id, label, features array) and names."""
    fs, names = feature_set(df, variant, id_col, label_col, exclude_label_features)
    if scale:
        fs = zscore(fs, names)
    return assemble(fs, names).select(id_col, label_col, "features"), names
