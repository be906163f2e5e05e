"""Ranks of whole tables without a single-partition window, and what follows from them.

``with_rank`` range-partitions on the order, sorts inside partitions and adds up the
partition sizes: no task holds more than its range, and only one number per partition
reaches the driver. ``exact_quantiles`` reads order statistics off those ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

_ROW_BITS = 33        # monotonically_increasing_id: partition above, row in the partition below


def with_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in ``order``, written to the shared folder.

    Rows that ``order`` leaves tied take any places among themselves; give a total order
    for a repeatable result."""
    at = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, seen = [], 0
    for p, n in sizes:                                    # one entry per shuffle partition
        before += [F.lit(p), F.lit(seen)]
        seen += n
    start = F.create_map(*before)[part] if before else F.lit(0)
    out = at.withColumn(name, (start + row + 1).cast("long")).drop("_at")
    out._scratch_path = at._scratch_path
    return out


def running_total(df: DataFrame, order: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over its own and all earlier rows in ``order``, written."""
    import pyarrow as pa
    import pyarrow.compute as pc

    src = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def cumulate(batches):
        seen = 0
        for batch in batches:
            if batch.num_rows:
                sums = pc.add(pc.cumulative_sum(batch.column(batch.schema.get_field_index(weight))), pa.scalar(seen, pa.int64()))
                seen = sums[-1].as_py()
                yield batch.append_column(name, sums)

    from pyspark.sql import types as T
    schema = T.StructType([*src.schema.fields, T.StructField(name, T.LongType())])
    at = cut_lineage(src.mapInArrow(cumulate, schema))
    totals = sorted((r["_part"], r["n"]) for r in at.groupBy("_part").agg(F.sum(weight).alias("n")).collect())
    before, seen = [], 0
    for p, n in totals:                                   # one entry per shuffle partition
        before += [F.lit(p), F.lit(seen).cast("long")]
        seen += n
    start = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    out = at.withColumn(name, F.col(name) + start).drop("_part")
    out._scratch_path = at._scratch_path
    return out


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
              approx: int | None = None) -> DataFrame:
    """(groups, n, q): the quantiles of the non-null values of every group, as numpy's linear
    interpolation gives them.

    Exact by default: distinct values are counted first, so ties cost nothing, ordered over all
    partitions, and each order statistic is the one run of equal values that covers its place.
    No task holds the values of a group. ``approx`` is the accuracy of a mergeable sketch instead
    (rank error at most n / approx; an observed value, not interpolated)."""
    from riskweave.operators.neighbors import spread_join
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("_all"))
    data = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    names = [F.col("_g")[c].alias(c) for c in groups]
    if approx is not None:
        return data.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", list(probs), approx).alias("q")) \
            .select(*names, "n", "q")
    runs = data.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = running_total(runs, ["_g", "_v"], "_c", "_upto")
    sizes = upto.groupBy("_g").agg(F.sum("_c").alias("n"), F.min(F.col("_upto") - F.col("_c")).alias("_first"))
    at = spread_join(upto, sizes, ["_g"], "_v")
    end = F.col("_upto") - F.col("_first")
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]

    def held(place):
        return (place >= end - F.col("_c")) & (place < end)

    wanted, picked = F.lit(False), []
    for k, place in enumerate(places):
        lo, hi = F.floor(place), F.ceil(place)
        wanted = wanted | held(lo) | held(hi)
        picked += [F.max(F.when(held(lo), F.col("_v"))).alias(f"lo{k}"), F.max(F.when(held(hi), F.col("_v"))).alias(f"hi{k}")]
    found = at.filter(wanted).groupBy("_g", "n").agg(*picked)
    q = F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (p - F.floor(p)) for k, p in enumerate(places)])
    return found.select(*names, "n", q.alias("q"))
