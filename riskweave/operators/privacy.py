"""Pseudonymisation, perturbation, date shifting and their validation.

Everything is a native column expression (``sha2``, ``regexp_extract``);
the mapping is a distributed ``distinct`` + window. The salt, factor and
offset are required arguments supplied by the caller and never logged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.exprs import INTERNAL_ID_COLUMNS, drop_columns_if_present

# Money columns scaled by the common factor (when present).
MONEY_COLUMNS = [
    "volumen", "volumen_maximo", "precio", "deuda_asnef",
    "ing_explotacion", "result_antes_imp", "importe_neto",
    "total_pasivo", "fondos_propios", "limite_total_concedido",
    "limite_disponible_ge", "riesgo_vivo_power", "riesgo_vivo_gas",
    "riesgo_vivo_power_falcon", "volumen_riesgo", "gastos_financieros",
    "remaining_amount", "saldo_pendiente_total",
]
# Date columns moved by the common offset (when present).
DATE_COLUMNS = [
    "fecha_creacion", "fecha_balance", "fecha_constitucion",
    "fecha_contratacion", "due_date", "posting_date", "ano_mes_creacion",
]

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_id(x) -> Column:
    return F.upper(F.regexp_replace(_c(x).cast("string"), r"^\s+|\s+$", ""))


# Y1 ---------------------------------------------------------------------------------
def province_code(x) -> Column:
    """First two consecutive digits anywhere in the id, valid 01-99, else ''."""
    code = F.regexp_extract(clean_id(x), r"([0-9]{2})", 1)
    return F.when(_c(x).isNull(), F.lit("")).when(code == "00", F.lit("")).otherwise(code)


# Y2 ---------------------------------------------------------------------------------
def _first_hex_letter(h: Column, default: str) -> Column:
    m = F.regexp_extract(h, "([a-f])", 1)
    return F.when(m == "", F.lit(default)).otherwise(F.upper(m))


def synthetic_id(x, salt: str) -> Column:
    """10-character synthetic id keeping the province code.

    h = sha256(salt + '_' + id). Company ids (first character a letter other
    than X/Y/Z): first letter of h + code + h[10:16] + first letter of h[16:]
    (default K). Persons: code + h[10:17] + first letter of h[17:] (default
    Z). No code -> '99'. Blank or null -> ''.
    """
    cid = clean_id(x)
    code = province_code(x)
    code = F.when(code == "", F.lit("99")).otherwise(code)
    h = F.sha2(F.concat(F.lit(salt + "_"), cid), 256)
    company = cid.rlike(r"^\p{L}") & ~F.substring(cid, 1, 1).isin("X", "Y", "Z")
    comp = F.concat(_first_hex_letter(h, "B"), code, F.upper(F.substring(h, 11, 6)),
                    _first_hex_letter(F.substring(h, 17, 64), "K"))
    pers = F.concat(code, F.upper(F.substring(h, 11, 7)), _first_hex_letter(F.substring(h, 18, 64), "Z"))
    out = F.substring(F.when(company, comp).otherwise(pers), 1, 10)
    return F.when(_c(x).isNull() | (cid == ""), F.lit("")).otherwise(out)


# Y3 / Y4 ------------------------------------------------------------------------------
def id_mapping(df: DataFrame, id_col: str, salt: str) -> DataFrame:
    """Distinct ids -> synthetic ids, injective at every size.

    Ids whose candidates collide are ranked by the original id; the first
    keeps the candidate, every later one gets a wider id, the candidate
    followed by ``-`` and its rank. Candidates hold no ``-``, so a pair
    (candidate, rank) never meets another one's text. Output: (original,
    synthetic); null ids are left out.
    """
    ids = df.select(F.col(id_col).alias("original")).filter(F.col("original").isNotNull()).distinct()
    cand = ids.withColumn("_cand", synthetic_id("original", salt))
    rk = F.row_number().over(Window.partitionBy("_cand").orderBy("original")) - 1
    wide = F.concat(F.col("_cand"), F.lit("-"), F.col("_rk").cast("string"))
    return cand.withColumn("_rk", rk).select(
        "original", F.when(F.col("_rk") == 0, F.col("_cand")).otherwise(wide).alias("synthetic"))


def pseudonymise(df: DataFrame, mapping: DataFrame, id_col: str) -> DataFrame:
    """Replace ids through the mapping (a join on the id; AQE picks the strategy)."""
    m = mapping.select(F.col("original").alias(id_col), F.col("synthetic").alias("_syn"))
    return df.join(m, id_col, "left").withColumn(id_col, F.col("_syn")).drop("_syn")


def distinct_ids_equal(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    b = before.agg(F.count_distinct(id_col).alias("before"))
    a = after.agg(F.count_distinct(id_col).alias("after"))
    return b.crossJoin(a).withColumn("equal", F.col("before") == F.col("after"))  # two one-row tables


# Y5 / Y6 ------------------------------------------------------------------------------
def perturb(df: DataFrame, factor: float, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Multiply every present numeric money column by one common factor.

    Decimal columns stay decimal (factor as decimal(10,6), result rounded
    back to the column's scale), so ratios between columns are preserved.
    """
    cols = MONEY_COLUMNS if cols is None else cols
    types = dict(df.dtypes)
    done, out = [], {}
    for c in cols:
        t = types.get(c)
        if t is None:
            continue
        if t.startswith("decimal"):
            scale = int(t.split(",")[1].rstrip(")"))
            out[c] = F.round(F.col(c) * F.lit(factor).cast("decimal(10,6)"), scale).cast(t)
        elif t in ("double", "float", "int", "bigint", "smallint"):
            out[c] = F.col(c).cast("double") * F.lit(float(factor))
        else:
            continue
        done.append(c)
    return df.withColumns(out), done


def shift_dates(df: DataFrame, days: int, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Move every present date column by one offset; unparsable -> null;
    year-month text becomes a date (first of the month) as the reference did."""
    cols = DATE_COLUMNS if cols is None else cols
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.date_add(F.try_to_date(F.col(c).cast("string")), int(days)) for c in present}), present


# Y7 ---------------------------------------------------------------------------------
def anonymise(df: DataFrame, id_col: str, salt: str, factor: float, days: int,
              drop_ids: Sequence[str] | None = None, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """Y3 -> Y4 -> Y5 -> Y6 -> P14. Returns (anonymised table, id mapping).

    ``verify`` counts the mapping's distinct ids on both sides first (one
    aggregate) and raises ``ValueError`` when two ids would share a name.
    """
    mapping = id_mapping(df, id_col, salt)
    if verify:
        n = mapping.agg(F.count(F.lit(1)).alias("ids"), F.count_distinct("synthetic").alias("names")).first()
        if n["ids"] != n["names"]:
            raise ValueError(f"{n['ids']} ids share {n['names']} synthetic ids")
    out = pseudonymise(df, mapping, id_col)
    out, _ = perturb(out, factor)
    out, _ = shift_dates(out, days)
    out, _ = drop_columns_if_present(out, INTERNAL_ID_COLUMNS if drop_ids is None else drop_ids)
    return out, mapping


# Y8 / Y10 -------------------------------------------------------------------------------
def validate_anonymisation(orig: DataFrame, anon: DataFrame, id_col: str, label_col: str,
                           province_col: str = "provincia", type_col: str | None = "tipo",
                           max_diff: int = 5, max_total: int = 10) -> DataFrame:
    """One row per check: (check, ok, detail). All checks are aggregates or
    full-outer joins of small count tables, never collections of rows."""
    spark = orig.sparkSession

    def cnt(df, col):
        return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))

    checks = []
    d_o = orig.agg(F.count_distinct(id_col).alias("a"), F.count(F.lit(1)).alias("ra"))
    d_a = anon.agg(F.count_distinct(id_col).alias("b"), F.count(F.lit(1)).alias("rb"))
    base = d_o.crossJoin(d_a)  # two one-row tables
    checks.append(base.select(F.lit("distinct_ids").alias("check"), (F.col("a") == F.col("b")).alias("ok"),
                              F.format_string("%d vs %d", "a", "b").alias("detail")))
    checks.append(base.select(F.lit("row_count").alias("check"), (F.col("ra") == F.col("rb")).alias("ok"),
                              F.format_string("%d vs %d", "ra", "rb").alias("detail")))

    def same_dist(col, name, tol=0, tol_total=0):
        a = cnt(orig, col).withColumnRenamed("n", "na")
        b = cnt(anon, col).withColumnRenamed("n", "nb")
        j = a.join(b, a[col].eqNullSafe(b[col]), "full_outer").select(
            F.abs(F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("d"))
        return j.agg(F.lit(name).alias("check"),
                     ((F.coalesce(F.max("d"), F.lit(0)) <= tol) & (F.coalesce(F.sum("d"), F.lit(0)) <= tol_total))
                     .alias("ok"),
                     F.format_string("max diff %d, total %d", F.coalesce(F.max("d"), F.lit(0)),
                                     F.coalesce(F.sum("d"), F.lit(0))).alias("detail"))

    checks.append(same_dist(label_col, "label_distribution"))
    if province_col in orig.columns and province_col in anon.columns:
        checks.append(same_dist(province_col, "province_distribution", max_diff, max_total))
    oc, ac = set(orig.columns), set(anon.columns)
    checks.append(spark.createDataFrame(
        [("column_sets", oc == ac, f"removed {len(oc - ac)}, added {len(ac - oc)}")], "check string, ok boolean, detail string"))
    inter = orig.select(id_col).intersect(anon.select(id_col)).agg(F.count(F.lit(1)).alias("n"))
    checks.append(inter.select(F.lit("no_common_ids").alias("check"), (F.col("n") == 0).alias("ok"),
                               F.format_string("%d common", "n").alias("detail")))
    if type_col and type_col in orig.columns and type_col in anon.columns:
        checks.append(same_dist(type_col, "person_type_distribution"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def province_preserved(mapping: DataFrame) -> DataFrame:
    """Province code equal before/after for every mapped id (all rows,
    where the reference printed a 10-row sample). The code sits at
    characters 2-3 of a company id and 1-2 of a person id."""
    before = province_code("original")
    before = F.when(before == "", F.lit("99")).otherwise(before)
    cid = clean_id("original")
    company = cid.rlike(r"^\p{L}") & ~F.substring(cid, 1, 1).isin("X", "Y", "Z")
    after = F.when(company, F.substring("synthetic", 2, 2)).otherwise(F.substring("synthetic", 1, 2))
    return (mapping.filter(cid != "")
            .agg(F.count(F.lit(1)).alias("n_total"), F.count_if(before == after).alias("n_preserved")))


# Y9 ---------------------------------------------------------------------------------
def check_feature_matrix(df: DataFrame, width: int, features: str = "features",
                         tol: float = 1e-6) -> DataFrame:
    """Expected width, no null or NaN entry, and per feature mean ~ 0 and std ~ 1.

    A constant feature (std 0 after scaling) is counted and is no fault, as
    z-scoring leaves it at zero. One row: bad_width, rows_with_nulls,
    max_abs_mean, max_std_dev (over features that vary), constant_features,
    ok. An empty matrix is not ok.
    """
    nulls = F.exists(features, lambda x: x.isNull() | F.isnan(x))
    stats = df.select(F.posexplode(features).alias("pos", "x")).groupBy("pos").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    base = df.agg(F.count_if((F.size(features) == width).eqNullSafe(False)).alias("bad_width"),
                  F.count_if(nulls).alias("rows_with_nulls"))
    constant = F.col("s") <= tol
    st = stats.agg(F.max(F.abs("m")).alias("max_abs_mean"),
                   F.max(F.when(~constant, F.abs(F.col("s") - 1))).alias("max_std_dev"),
                   F.count_if(constant).alias("constant_features"))
    ok = ((F.col("bad_width") == 0) & (F.col("rows_with_nulls") == 0) & (F.col("max_abs_mean") <= tol)
          & (F.coalesce("max_std_dev", F.lit(0.0)) <= tol))
    return base.crossJoin(st).withColumn("ok", F.coalesce(ok, F.lit(False)))  # two one-row tables
