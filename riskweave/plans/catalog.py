"""Registry of named queries (Spark callables) and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver's
TESTDATA; the oracle text (when SQL can express the operator) lives next
to it. ``__spark_entry__`` exposes both dicts.

Both sides normalise negative zero in double outputs (``x + 0.0``), since a
rounded -1e-17 prints as -0 in one engine and 0 in the other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def no_negative_zero(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (c + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            c = F.transform(c, lambda x: x + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def wrap_round_sql(sql: str) -> str:
    """Wrap every ``round(...)`` call as ``(round(...) + 0.0)``."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = wrap_round_sql(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            return no_negative_zero(fn(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = wrap_round_sql(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from riskweave.plans import (queries_cleaning, queries_cluster, queries_features,  # noqa: F401
                                 queries_ledger, queries_misc, queries_privacy, queries_rating, queries_report,
                                 queries_topology)
