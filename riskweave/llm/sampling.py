"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1_000_000_000


def fold(id_col: str, mod: int):
    """crc32 of the id written as decimal text, modulo ``mod`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def sample_per_class(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class (all, if it has fewer), chosen by a hash
    of the id, and the class sizes. One small aggregate sets a hash threshold per
    class, so no row is moved and no task holds more than its share."""
    sizes = {r[class_col]: r["n"] for r in rows.groupBy(class_col).agg(F.count("*").alias("n")).collect()}
    sizes = {k: v for k, v in sizes.items() if k is not None}
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(SCALE))
    keep = F.lit(False)
    for k, n in sizes.items():
        keep = keep | ((F.col(class_col) == F.lit(k)) & (draw < F.lit(int(SCALE * min(1.0, per_class / n)) + 1)))
    return rows.filter(keep), sizes
