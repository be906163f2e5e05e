"""Risk alerts for newly arriving customers, in batch and as a stream.

The model is static and fitted once on the customer table: z-score
statistics, DBSCAN core points with their cluster and the cluster's
delinquency rate. A new customer takes the cluster of its nearest core
point within eps (ties -> least core id) - an equi-join on grid cells of
the principal axes with an exact distance check, so the core set is never
shipped whole to a task; a cell of many cores is split into buckets that
every probe visits, and a cell of many probes takes as many copies of its
cores; a vector that is a core's own is settled by an equi-join on the
vector - and gets a level: rate > 50 % high, 10-50 %
medium (both ends inclusive), < 10 % low, no core point within eps ->
review (outlier).

Streaming runs the same batch function inside ``foreachBatch``: the core
table is static, each micro-batch is a bounded DataFrame, and the sink
write is idempotent per batch id.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.neighbors import dot, principal_axes, spread_join, sq_dist, wide_join

MAX_CELL, MAX_PROBES = 4096, 65_536       # cores of a bucket, probes of a share

# Level boundaries and the commercial action per level.
HIGH_RATE, LOW_RATE = 0.5, 0.1
ACTIONS = {"alto": "bloquear nuevas ventas y reclamar", "medio": "vigilar y pedir garantias",
           "bajo": "operacion normal", "revisar": "revision manual"}


@dataclass
class AlertModel:
    stats: dict            # column -> (mean, std)
    columns: list          # feature order
    eps: float
    axes: np.ndarray       # projection for the grid (k x d)
    cores: DataFrame       # (core_id, features, cluster, tasa) with _cell and its bucket _b
    cells: DataFrame       # (_cell, _nb): number of buckets of every cell


def fit_alert_model(df: DataFrame, id_col: str, label_col: str, columns: list | None, eps: float,
                    min_samples: int, axes: int = 2, max_cell: int = MAX_CELL) -> AlertModel:
    """Fit on raw columns (z-scored here), or - with ``columns=None`` - on a
    DataFrame that already carries the ``features`` array."""
    from riskweave.operators import features as FE
    from riskweave.operators.cluster import dbscan
    from riskweave.session import cut_lineage, drop_scratch
    if columns is None:
        stats, z = {}, df.select(id_col, label_col, "features")
    else:
        stats = FE.zscore_stats(df, columns)
        z = FE.assemble(FE.zscore(df.select(id_col, label_col, *columns), columns, stats), columns)
    z = cut_lineage(z.select(id_col, label_col, "features"))
    cl = dbscan(z, id_col, eps, min_samples)
    lab = wide_join(cl, z, id_col)
    rates = (lab.filter(F.col("cluster") != F.lit(-1).cast(df.schema[id_col].dataType))
                .groupBy("cluster").agg(F.avg(F.col(label_col).cast("int").cast("double")).alias("tasa")))
    A = principal_axes(z, "features", axes)
    cells = F.array(*[F.floor(dot(F.col("features"), a) / F.lit(float(eps))).cast("long") for a in A])
    # identical core vectors collapse to one (least core id wins, as in a tie)
    cores = (lab.filter("is_core").join(rates, "cluster")
                .groupBy("features").agg(F.min(F.struct(F.col(id_col).alias("core_id"), "cluster", "tasa")).alias("_c"))
                .select("_c.core_id", "features", "_c.cluster", "_c.tasa", cells.alias("_cell")))
    cores = cut_lineage(cores)
    buckets = cut_lineage(cores.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(max_cell)).cast("int").alias("_nb")))
    own = F.pmod(F.xxhash64("core_id"), F.col("_nb")).cast("int").alias("_b")
    dealt = cut_lineage(spread_join(cores, buckets, ["_cell"], "core_id").select(
        "core_id", "features", "cluster", "tasa", "_cell", own))
    drop_scratch(cores)
    return AlertModel(stats, list(columns) if columns else None, float(eps), A, dealt, buckets)


def level(rate) -> F.Column:
    return (F.when(rate.isNull(), F.lit("revisar"))
             .when(rate > HIGH_RATE, F.lit("alto"))
             .when(rate >= LOW_RATE, F.lit("medio"))
             .otherwise(F.lit("bajo")))


def risk_alerts(new: DataFrame, model: AlertModel, id_col: str) -> DataFrame:
    """Score new customers: (id, cluster, tasa, nivel, accion, distance)."""
    from riskweave.operators import features as FE
    if model.columns is None:
        z = new.select(id_col, "features")
    else:
        z = FE.assemble(FE.zscore(new.select(id_col, *model.columns), model.columns, model.stats), model.columns)
    m = len(model.axes)
    dim = model.axes.shape[1]
    offs = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=m)])
    cells = F.array(*[F.floor(dot(F.col("features"), a) / F.lit(model.eps)).cast("long") for a in model.axes])
    # score each distinct vector once; rows join back on the vector. A vector that is a core's has no nearer core
    uniq = z.select("features").distinct()
    found = ["core_id", "cluster", "tasa"]
    same = wide_join(uniq, model.cores.select("features", *found), "features").select(
        F.col("features").alias("_f"), F.struct(F.lit(0.0).alias("_d2"), *found).alias("_b"))
    probe = wide_join(uniq, model.cores.select("features"), "features", "left_anti").select(F.col("features").alias("_f"),
                        F.explode(F.transform(offs, lambda off: F.zip_with(cells, off, lambda x, y: x + y))).alias("_cell"))
    # both sides of a hot cell are split: its cores into _nb buckets, its probes into _np shares
    shares = (probe.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(MAX_PROBES)).cast("int").alias("_np"))
              .join(model.cells, "_cell"))
    probe = (spread_join(probe, shares, ["_cell"], "_f")
             .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
             .withColumn("_p", F.pmod(F.xxhash64("_f", F.lit(3)), F.col("_np")).cast("int")).drop("_nb", "_np"))
    cores = (spread_join(model.cores, shares.select("_cell", "_np"), ["_cell"], "core_id")
             .withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_np") - 1))).drop("_np"))
    cand = probe.join(cores, ["_cell", "_b", "_p"])
    d2 = sq_dist(F.col("_f"), F.col("features"), dim)
    near = (cand.withColumn("_d2", d2).filter(F.col("_d2") <= F.lit(model.eps * model.eps))
                .groupBy("_f").agg(F.min(F.struct("_d2", "core_id", "cluster", "tasa")).alias("_b")))
    near = near.unionByName(same)
    out = spread_join(z, near.withColumnRenamed("_f", "features"), ["features"], id_col, "left")
    rate = F.col("_b.tasa")
    acts = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return out.select(id_col, F.col("_b.cluster").alias("cluster"), rate.alias("tasa"),
                      level(rate).alias("nivel"), acts[level(rate)].alias("accion"),
                      F.sqrt(F.col("_b._d2")).alias("distance"))


def write_alert_batch(batch: DataFrame, batch_id: int, model: AlertModel, id_col: str, out_path: str) -> None:
    """Write a micro-batch's alerts to its own ``batch_id=<n>`` folder, replacing
    what an earlier attempt of the same batch left there."""
    risk_alerts(batch, model, id_col).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")


def start_alert_stream(stream: DataFrame, model: AlertModel, id_col: str, out_path: str,
                       checkpoint: str, trigger_once: bool = True):
    """Score a streaming DataFrame of new customers with ``foreachBatch``. A
    replayed micro-batch overwrites its own partition of ``out_path``."""
    def handle(batch: DataFrame, batch_id: int):
        write_alert_batch(batch, batch_id, model, id_col, out_path)
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
