"""Scalar column expressions.

All functions return ``Column`` objects built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The identifier shapes used to tell persons from companies.
# Spanish DNI, Spanish NIE, Portuguese personal NIF, Spanish company CIF,
# and the two-letter foreign VAT prefix.
DNI_PATTERN = "[0-9]{8}[A-Z]"
NIE_PATTERN = "[XYZ][0-9]{7}[A-Z]"
PT_NIF_PATTERN = "[0-9]{9}"
CIF_PATTERN = "[A-W][0-9]{8}"
FOREIGN_VAT_PREFIX = "[A-Z]{2}[0-9]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_match(x, pattern: str) -> Column:
    """Whole-string regex match (the warehouse's REGEXP_LIKE semantics)."""
    return _c(x).rlike("^(?:" + pattern + r")\z")


def prefix_match(x, pattern: str) -> Column:
    return _c(x).rlike("^(?:" + pattern + ")")


# P1 -------------------------------------------------------------------------
def normalise_id(x) -> Column:
    """TRIM(UPPER(x)) - spaces only, as the warehouse's TRIM."""
    return F.trim(F.upper(_c(x)))


def valid_id(raw) -> Column:
    """Raw id present and not blank (the registry/ledger WHERE clause)."""
    return _c(raw).isNotNull() & (F.trim(_c(raw)) != F.lit(""))


def drop_blank_ids(df: DataFrame, raw_col: str) -> DataFrame:
    return df.filter(valid_id(raw_col))


# P2 -------------------------------------------------------------------------
def country_from_tax_id(id_col, default: str, mode: str = "prefix") -> Column:
    """Two-letter country from a foreign VAT id, else the ledger's default.

    mode='prefix' is the written intent (``^[A-Z]{2}[0-9]`` at the start);
    mode='whole' is what the warehouse actually evaluated (whole-string
    match, so only 3-character ids fire).
    """
    c = _c(id_col)
    hit = prefix_match(c, FOREIGN_VAT_PREFIX) if mode == "prefix" else full_match(c, FOREIGN_VAT_PREFIX)
    return F.when(hit, F.substring(c, 1, 2)).otherwise(F.lit(default))


# P3 -------------------------------------------------------------------------
def person_type_from_id(id_col, known_type=None) -> Column:
    """Known type first; else person-shaped ids -> 'Persona'; else 'Empresa'."""
    c = _c(id_col)
    inferred = (F.when(full_match(c, DNI_PATTERN), F.lit("Persona"))
                .when(full_match(c, NIE_PATTERN), F.lit("Persona"))
                .when(full_match(c, PT_NIF_PATTERN), F.lit("Persona"))
                .otherwise(F.lit("Empresa")))
    if known_type is None:
        return inferred
    return F.coalesce(_c(known_type), inferred)


def looks_like_person(id_col) -> Column:
    c = _c(id_col)
    return full_match(c, DNI_PATTERN) | full_match(c, NIE_PATTERN) | full_match(c, PT_NIF_PATTERN)


# P4 -------------------------------------------------------------------------
def company_only(value, known_type, id_col) -> Column:
    """Sector-style rule: value when the customer is (or looks like) a company.

    Order of tests matters: a known type wins, then person-shaped ids give
    null, then a company-shaped CIF keeps the value, anything else null.
    """
    t, c = _c(known_type), _c(id_col)
    return (F.when(t == "Empresa", _c(value))
            .when(t == "Persona", F.lit(None))
            .when(looks_like_person(c), F.lit(None))
            .when(full_match(c, CIF_PATTERN), _c(value))
            .otherwise(F.lit(None)))


def company_only_by_null_type(value, known_type, id_col) -> Column:
    """Creation-date rule: known Empresa, or unknown type with a CIF-shaped id."""
    t, c = _c(known_type), _c(id_col)
    return (F.when(t == "Empresa", _c(value))
            .when(t.isNull() & full_match(c, CIF_PATTERN), _c(value))
            .otherwise(F.lit(None)))


# P5 -------------------------------------------------------------------------
def first_non_null(*cols) -> Column:
    return F.coalesce(*[_c(x) for x in cols])


# P6 / P7 / P8 ---------------------------------------------------------------
def date_part10(x) -> Column:
    return F.left(_c(x).cast("string"), F.lit(10))


def year_month(x) -> Column:
    return F.left(_c(x).cast("string"), F.lit(7))


def days_overdue(due, report_date: str) -> Column:
    """DATEDIFF(DAY, TO_DATE(LEFT(due,10)), report); unparsable -> null."""
    return F.datediff(F.lit(report_date).cast("date"), F.try_to_date(date_part10(due)))


def money(x) -> Column:
    return F.try_cast(_c(x), "decimal(16,2)") if hasattr(F, "try_cast") else _c(x).try_cast("decimal(16,2)")


# P9 -------------------------------------------------------------------------
def safe_ratio(num, den) -> Column:
    return F.when(_c(den) > 0, _c(num).cast("double") / _c(den)).otherwise(F.lit(0.0))


# P10 ------------------------------------------------------------------------
def is_open(balance) -> Column:
    return _c(balance) != 0


def is_overdue(days, balance, threshold_days: int) -> Column:
    return (_c(days) > threshold_days) & (_c(balance) > 0)


# P11 ------------------------------------------------------------------------
def day_before(d, n: int) -> Column:
    return F.date_sub(_c(d).cast("date"), n)


def business_day_before(d, n: int) -> Column:
    """Go back ``n`` weekdays (Mon-Fri; no holiday calendar).

    A weekend start first rolls back to Friday, which counts as the first
    step - the calendar-offset rule of a business-day offset.
    """
    d0 = _c(d).cast("date")
    # Monday=0 .. Sunday=6
    wd = F.pmod(F.dayofweek(d0) + 5, F.lit(7))
    # weekend: move to Friday and use one step up
    on_weekend = wd >= 5
    base = F.when(on_weekend, F.date_sub(d0, (wd - 4).cast("int"))).otherwise(d0)
    steps = F.when(on_weekend, F.lit(n - 1)).otherwise(F.lit(n))
    base_wd = F.when(on_weekend, F.lit(4)).otherwise(wd)
    weeks = F.floor(steps / 5).cast("int")
    rem = (steps - weeks * 5).cast("int")
    extra = F.when(rem > base_wd, F.lit(2)).otherwise(F.lit(0))
    return F.date_sub(base, (weeks * 7 + rem + extra).cast("int"))


# P12 ------------------------------------------------------------------------
# The Portuguese account names that make up each figure.
PT_EQUITY_ACCOUNTS = [
    "capital_realizado", "acoes_propias", "outros_inst_cap_propio", "premios_emissao",
    "reservas_legais", "outras_reservas", "result_transitados", "resultado_liquido",
    "dividendos_antecipados",
]
PT_INCOME_ACCOUNTS = ["vendas_e_serv_prestados", "outros_rendimentos"]
PT_FIN_COST_ACCOUNTS = ["juros_e_rend_obtidos", "juros_e_gastos_suport"]


def null_sum(cols) -> Column:
    """a + b + ... with SQL null propagation."""
    out = _c(cols[0])
    for x in cols[1:]:
        out = out + _c(x)
    return out


def pt_financials(df: DataFrame, equity=None, income=None, fin_cost=None) -> DataFrame:
    equity = equity or PT_EQUITY_ACCOUNTS
    income = income or PT_INCOME_ACCOUNTS
    fin_cost = fin_cost or PT_FIN_COST_ACCOUNTS
    return df.select("*", null_sum(equity).alias("fondos_propios_pt"),
                     null_sum(income).alias("ing_explotacion_pt"),
                     null_sum(fin_cost).alias("gastos_financieros_pt"))


# P13 / P14 -------------------------------------------------------------------
def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


# Internal id columns removed from an anonymised table.
INTERNAL_ID_COLUMNS = [
    "id_evaluacion", "rating_id", "id_cliente", "id_tramo", "id_negocio",
    "id_cliente_riesgo_vivo", "max_id_rating_request", "id_input_custom_data",
]


def drop_columns_if_present(df: DataFrame, cols=None) -> tuple[DataFrame, list[str]]:
    cols = INTERNAL_ID_COLUMNS if cols is None else cols
    lower = {c.lower(): c for c in df.columns}
    present = [lower[c.lower()] for c in cols if c.lower() in lower]
    return df.drop(*present), present
