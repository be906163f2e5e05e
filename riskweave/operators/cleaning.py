"""Category cleaning: provinces, country correction, sector codes.

Lookups are small fixed tables, so they become map literals inside the
projection (``create_map``): no join, no shuffle, no broadcast, and the
expression stays in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import lookups


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def map_literal(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def strip_upper(x) -> Column:
    """Python ``str.strip().upper()``: all surrounding whitespace, not only spaces."""
    return F.upper(F.regexp_replace(_c(x), r"^\s+|\s+$", ""))


def title_case(x) -> Column:
    """Python ``str.title()``: a cased letter is upper-cased when the previous
    character is not cased, lower-cased otherwise (``initcap`` only looks at
    spaces, so ``L'HOSPITALET`` would differ)."""
    chars = F.split(_c(x), "")

    def cased(ch):
        return F.lower(ch) != F.upper(ch)

    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~cased(F.element_at(chars, i)), F.upper(ch)).otherwise(F.lower(ch))), "")


def clean_category(x, mapping: Mapping[str, str], invalid: Sequence[str]) -> Column:
    """C1 as a column: strip+upper -> invalid to null -> mapping -> else title case."""
    up = strip_upper(x)
    up = F.when(up.isin(list(invalid)), F.lit(None).cast("string")).otherwise(up)
    return F.coalesce(map_literal(mapping)[up], title_case(up))


def normalise_category(df: DataFrame, col: str, mapping: Mapping[str, str] | None = None,
                       invalid: Sequence[str] | None = None) -> DataFrame:
    """C1. Null stays null (the reference turned null into the text 'None')."""
    mapping = lookups.PROVINCE_MAP if mapping is None else mapping
    invalid = lookups.INVALID_PROVINCES if invalid is None else invalid
    return df.withColumn(col, clean_category(col, mapping, invalid))


def correct_country(df: DataFrame, province_col: str = "provincia", country_col: str = "pais",
                    members: Sequence[str] | None = None, value: str = "PRT",
                    invalid: Sequence[str] | None = None) -> DataFrame:
    """Province (strip+upper, after invalid spellings are nulled) in the set -> country."""
    members = lookups.PORTUGUESE_PROVINCES if members is None else members
    invalid = lookups.INVALID_PROVINCES if invalid is None else invalid
    up = strip_upper(province_col)
    up = F.when(up.isin(list(invalid)), F.lit(None).cast("string")).otherwise(up)
    return df.withColumn(country_col, F.when(up.isin(list(members)), F.lit(value)).otherwise(F.col(country_col)))


def code_prefix(x, width: int = 4, prefix: int = 2) -> Column:
    """Strip a trailing '.0', left-pad to ``width`` with zeros (never truncating,
    unlike ``lpad``), take the first ``prefix`` characters."""
    s = F.regexp_replace(_c(x).cast("string"), r"\.0$", "")
    s = F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
    return F.substring(s, 1, prefix)


def map_code_prefix(df: DataFrame, col: str, mapping: Mapping[str, str] | None = None,
                    width: int = 4, prefix: int = 2, default: str = "Desconocido") -> DataFrame:
    """Sector from the code's leading digits; a miss (or null) -> default."""
    mapping = lookups.CNAE_SECTORS if mapping is None else mapping
    return df.withColumn(col, F.coalesce(map_literal(mapping)[code_prefix(col, width, prefix)], F.lit(default)))


def clean_customer_table(df: DataFrame) -> DataFrame:
    """The reference's post-query cleaning in its order: C2 then C1 on province, then C3."""
    return map_code_prefix(normalise_category(correct_country(df), "provincia"), "cnae")
