"""Method comparison and predictive scoring of groupings.

A grouping (clusters, Mapper nodes, provinces) is scored as a classifier:
every member of a group whose delinquency rate exceeds ``threshold`` is
predicted positive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_verdicts(df: DataFrame, keys: Sequence[str], group: str, label: str, threshold: float = 0.5, noise=None) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1_score): "group rate > threshold" as a classifier, per
    ``keys`` (e.g. the method), from the counts of each group; rows never meet rates."""
    g = (df.select(*keys, group, F.col(label).cast("int").alias("_y")).groupBy(*keys, group)
         .agg(F.count("_y").alias("_n"), F.sum("_y").cast("long").alias("_pos")))
    hit = F.col("_pos") / F.col("_n") > threshold
    if noise is not None:
        hit = hit & (F.col(group) != F.lit(noise))
    hit = F.coalesce(hit, F.lit(False))
    zero = F.lit(0).cast("long")
    c = g.groupBy(*keys).agg(F.coalesce(F.sum(F.when(hit, F.col("_pos"))), zero).alias("tp"),
                             F.coalesce(F.sum(F.when(hit, F.col("_n") - F.col("_pos"))), zero).alias("fp"),
                             F.coalesce(F.sum(F.when(~hit, F.col("_pos"))), zero).alias("fn"))
    p = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    r = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return c.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
                    F.try_divide(2 * p * r, p + r).alias("f1_score"))


def cluster_as_classifier(df: DataFrame, group: str, label: str, threshold: float = 0.5,
                          noise=None) -> DataFrame:
    """M6: precision / recall / F1 of "group rate > threshold" (noise never positive)."""
    return group_verdicts(df, [], group, label, threshold, noise)


def top_features(df: DataFrame, group: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """M7: per group the k features with the largest |mean| (z-scored input),
    as (group, rank, feature, mean) plus a 'name=0.00' text per group."""
    long = df.unpivot([group], list(features), "feature", "value")
    m = long.groupBy(group, "feature").agg(F.avg("value").alias("mean"))
    w = Window.partitionBy(group).orderBy(F.abs("mean").desc(), F.col("feature"))
    top = m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("text", F.concat(F.col("feature"), F.lit("="), F.format_number("mean", 2)))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives and their share."""
    y = F.col(label).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.sum(y).cast("long").alias("n_morosos"),
                  (F.avg(y.cast("double")) * 100).alias("pct_morosos"))


def stack_labelings(labelings: Mapping[str, DataFrame], noise: Mapping[str, object] | None = None) -> DataFrame:
    """(method, id, grp, noise): several labelings (id, group) as one long table. A method may put an
    id in several groups; ids of its ``noise`` group are in none."""
    out = None
    for name, df in labelings.items():
        ident, group = df.columns[:2]
        bad = (noise or {}).get(name)
        part = df.select(F.lit(name).alias("method"), F.col(ident).alias("id"), F.col(group).cast("string").alias("grp"),
                         (F.lit(False) if bad is None else F.col(group) == F.lit(bad)).alias("noise"))
        out = part if out is None else out.unionByName(part)
    return out


def predictive_metrics(stacked: DataFrame, rows: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """(method, metric, value): each method as a classifier and the structure of its groups, in one
    pass. An id is predicted positive when the rate of one of its groups exceeds ``threshold``;
    noise and ids without a group are negative. ``rows`` (id, label) holds every id once."""
    from riskweave.operators.neighbors import spread_join, wide_join
    y = rows.select("id", F.col(label).cast("int").alias("_y"))
    live = wide_join(stacked.filter("NOT noise"), y, "id")
    groups = live.groupBy("method", "grp").agg((F.avg("_y") > threshold).alias("_hit"))
    seen = (spread_join(live, groups, ["method", "grp"], "id").groupBy("method", "id")
            .agg(F.max("_hit").alias("hit"), F.max("_y").alias("_y"), F.count(F.lit(1)).alias("in_groups")))
    sizes = groups.groupBy("method").agg(F.count(F.lit(1)).alias("n_groups"))
    total = y.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("_y"), F.lit(0)).alias("positives"))
    c = (seen.groupBy("method").agg(F.count_if(F.col("hit") & (F.col("_y") == 1)).alias("tp"), F.count_if("hit").alias("said"),
                                    F.count(F.lit(1)).alias("inside"), F.count_if(F.col("in_groups") > 1).alias("shared"))
         .join(sizes, "method").crossJoin(F.broadcast(total)))                     # one-row table
    p, r = F.try_divide(F.col("tp"), F.col("said")), F.try_divide(F.col("tp"), F.col("positives"))
    values = {"precision": p, "recall": r, "f1_score": F.try_divide(2 * p * r, p + r), "n_groups": F.col("n_groups"),
              "exclusive_groups": (F.col("shared") == 0).cast("int"), "pct_overlap": 100 * F.col("shared") / F.col("total"),
              "pct_outliers": 100 * (F.col("total") - F.col("inside")) / F.col("total")}
    return c.select("method", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                                                  for k, v in values.items()])).alias("m")).select("method", "m.metric", "m.value")


def quality_metrics(stacked: DataFrame, points: DataFrame, methods: Sequence[str], features: str = "features") -> DataFrame:
    """(method, metric, value): silhouette, Davies-Bouldin and Calinski-Harabasz of the named methods
    (those whose groups do not overlap), noise left out."""
    from riskweave.operators import quality as Q
    from riskweave.operators.neighbors import wide_join
    from riskweave.session import cut_lineage
    data = cut_lineage(wide_join(stacked.filter("NOT noise").filter(F.col("method").isin(list(methods))),
                                 points.select("id", features), "id").select("method", "grp", features))
    moments = Q.group_moments(data, ["method", "grp"], features)
    ch = F.col("ssb") / F.nullif("ssw", F.lit(0.0)) * ((F.col("n") - F.col("k")) / F.nullif(F.col("k") - 1, F.lit(0)))
    out = Q.within_between(moments, ["method"]).select("method", F.lit("calinski_harabasz").alias("metric"), ch.alias("value"))
    for m in methods:
        own = data.filter(F.col("method") == m)
        for metric, one in (("silhouette", Q.silhouette(own, "grp", features)), ("davies_bouldin", Q.davies_bouldin(own, "grp", features))):
            out = out.unionByName(one.select(F.lit(m).alias("method"), F.lit(metric).alias("metric"), F.col(metric).alias("value")))
    return out


METRICS = ("silhouette", "davies_bouldin", "calinski_harabasz", "precision", "recall", "f1_score",
           "n_groups", "exclusive_groups", "pct_overlap", "pct_outliers")


def method_comparison(metrics: DataFrame, methods: Sequence[str]) -> DataFrame:
    """M9: one row per metric, one column per method; null where a method has no such metric."""
    wide = metrics.groupBy("metric").pivot("method", list(methods)).agg(F.first("value"))
    every = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    return metrics.sparkSession.range(1).select(every).join(wide, "metric", "left")


def executive_summary(balance: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals, global rate, best F1 and the method that has it (ties: the last name)."""
    f1 = metrics.filter((F.col("metric") == "f1_score") & F.col("value").isNotNull())
    best = f1.agg(F.max_by("method", F.struct("value", "method")).alias("best_method"), F.max("value").alias("best_f1"))
    return balance.crossJoin(best)  # two one-row tables


def explained_variance(ratios: Sequence[float]) -> DataFrame:
    """M5: per component and cumulative explained variance share."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows, acc = [], 0.0
    for i, r in enumerate(ratios):
        acc += r
        rows.append((i + 1, float(r), float(acc)))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def projected_centroids(proj: DataFrame, group: str, pc: str = "pc") -> DataFrame:
    """M8: per-group mean of the 2-D projection."""
    return proj.groupBy(group).agg(F.avg(F.col(pc)[0]).alias("pc1"), F.avg(F.col(pc)[1]).alias("pc2"),
                                   F.count(F.lit(1)).alias("n"))
