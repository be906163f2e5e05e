"""Left joins of chains with missing links.

Rows whose key is null match nothing, yet a plain left join hashes them all to one task.
``left_join`` spreads them: the null rows take a second key part drawn from the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_SHARES = 1 << 14      # only rows without a key are dealt, so a large number costs nothing


def _none_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1)).cast("int")


def keyed(right: DataFrame, on: str) -> DataFrame:
    """The rows of a right side that have a key, with the share of ``left_joins``: grouped by ``on`` and ``_share``
    they are joined without a second shuffle."""
    return right.filter(F.col(on).isNotNull()).withColumn("_share", _none_of(on))


def left_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None) -> DataFrame:
    """Left join on ``on`` (= ``right_on``); the rows without a key are dealt over NULL_SHARES tasks.

    With one key name the key comes back once, as in ``join(..., on)``. The right side's share is
    always 0 but spelled as a hash: Spark does not join on a constant, so a literal would leave
    the rows without a key together."""
    return left_joins(left, [(right, right_on)], on)


def left_joins(left: DataFrame, rights: Sequence[tuple[DataFrame, str | None]], on: str) -> DataFrame:
    """``left_join`` to several tables (table, its key or None) on one key: the rows are dealt and
    shuffled once for all of them. A table may have its share already (``keyed``)."""
    simple = [F.col(f"`{f.name}`") for f in left.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    share = F.when(F.col(on).isNull(), F.pmod(F.xxhash64(*simple), F.lit(NULL_SHARES))).otherwise(F.lit(0))
    out = left.withColumn("_share", share.cast("int"))
    for right, right_on in rights:
        if right_on is None or right_on == on:
            out = out.join(right if "_share" in right.columns else right.withColumn("_share", _none_of(on)), [on, "_share"], "left")
        else:
            b = right.withColumn("_share_r", _none_of(right_on))
            out = out.join(b, (F.col(on) == F.col(right_on)) & (F.col("_share") == F.col("_share_r")), "left").drop("_share_r")
    return out.drop("_share")


def lookup_join(left: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Left join to a code table. Spark broadcasts it when its measured size is small."""
    return left_join(left, dim, key, dim_key)


def snowflake_join(base: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """A chain of left joins; every step is (table, key among the columns so far, key of the table).

    Each step keys on a column that an earlier one brought, so a missing link leaves the
    rest of the chain null."""
    out = base
    for table, key, table_key in steps:
        out = left_join(out, table, key, table_key)
    return out
