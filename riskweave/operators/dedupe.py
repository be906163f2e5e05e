"""Keep-one-row-per-key operators, correlated-subquery rewrites, sampling.

SURVEY W1-W3, J5-J7, R1, R2. Every window gets a *total* order (the
reference's windows have ties with no tie-breaker); callers pass
tie-break columns and we append them.

Scale notes: ``row_number() == 1`` filters are rewritten by Spark into a
``WindowGroupLimit`` that runs before the shuffle as well as after it, so
only one candidate per key and map task crosses the network. A hot key (a
third of all rows) still ends in one reducer task for the final window;
its input there is at most one row per map task thanks to the partial
limit, so the hot reducer stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OrderSpec = Sequence[Column | str]


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _window(keys, order) -> Window:
    return Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))


def dedupe_by_priority(df: DataFrame, keys: Sequence[str], order: OrderSpec,
                       rank_col: str = "_rn") -> DataFrame:
    """Keep row 1 per key by the given total order (priority first)."""
    return (df.withColumn(rank_col, F.row_number().over(_window(keys, order)))
              .filter(F.col(rank_col) == 1).drop(rank_col))


def latest_by(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: OrderSpec = (),
              nulls: str = "last") -> DataFrame:
    """Newest row per key (ts DESC, then tie-breaks)."""
    ts_order = F.col(ts).desc_nulls_last() if nulls == "last" else F.col(ts).desc_nulls_first()
    return dedupe_by_priority(df, keys, [ts_order, *tiebreak])


def latest_attributes(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                      tiebreak: OrderSpec = (), nulls: str = "last") -> DataFrame:
    """FIRST_VALUE(col) OVER (PARTITION BY key ORDER BY ts DESC) for each col.

    With a total order every FIRST_VALUE comes from the same (first) row, so
    one row_number pass is equivalent and cheaper than one window per column.
    """
    # Catalyst prunes every column not named here before the shuffle.
    return latest_by(df, keys, ts, tiebreak, nulls).select(*keys, *cols)


def latest_per_key_in(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """(k, d) IN (SELECT k, MAX(d) ... GROUP BY k) - keeps all ties.

    Semi-join against the per-key maximum: the aggregate is partial
    (map-side combined), so a hot key costs one row per map task.
    """
    mx = df.groupBy(key).agg(F.max(order_col).alias("_max_d"))
    return df.join(mx, (df[key] == mx[key]) & (df[order_col] == mx["_max_d"]), "left_semi")


def latest_request(requests: DataFrame, group_key: str, id_col: str, keep: Column) -> DataFrame:
    """Correlated ``id = (SELECT MAX(id) ... same group)`` then a filter.

    MAX is taken over *all* requests of the group before ``keep`` is applied,
    so a group whose newest request fails the filter yields nothing. No id exceeds
    the maximum, so ``>=`` says the same as ``=`` but is no join key: requests that
    already lie by group are not shuffled again by (group, id).
    """
    mx = requests.groupBy(group_key).agg(F.max(id_col).alias("_max_id"))
    return (requests.join(mx, group_key, "inner")
                    .filter((F.col(id_col) >= F.col("_max_id")) & keep)
                    .drop("_max_id"))


def argmax_rejoin(df: DataFrame, key: str | Sequence[str], id_col: str) -> DataFrame:
    """MAX(id) per key (or keys), joined back for the whole row.

    ``max_by(struct, id)`` keeps the row in one aggregate (no second scan,
    no join); ids are unique per key in the reference, so no tie exists.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(id_col)).alias("_row"))
    return agg.select(*keys, "_row.*")


def sample_key(id_col: str, seed: int) -> Column:
    """Partition-independent pseudo-random order: md5 of 'id|seed' (a native
    function in Spark and in SQL engines, so a sample can be re-derived)."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_quotas(df: DataFrame, label_col: str, n: int) -> tuple[int, int]:
    """``round(n * p)`` positives (half away from zero) and the rest negatives (two scalars)."""
    import math
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col(label_col).cast("long")).alias("pos")).first()
    total, pos = int(row["n"] or 0), int(row["pos"] or 0)
    if total == 0:
        return 0, 0
    q_pos = min(pos, int(math.floor(n * pos / total + 0.5)))
    q_neg = min(total - pos, n - q_pos)
    return q_pos, max(q_neg, 0)


def stratified_sample(df: DataFrame, id_col: str, label_col: str, n: int,
                      seed: int = 42) -> DataFrame:
    """Exact-size stratified sample without replacement.

    Stratum quotas are ``round(n * p)`` positives and the rest negatives
    (one tiny aggregate, two scalars to the driver). Each stratum is then a
    top-q by ``md5(id|seed)`` (id breaks ties): Spark plans it as
    ``TakeOrderedAndProject``, where every task keeps at most q rows, so no
    stratum is ever gathered in one task and the result does not depend on
    partitioning. ``sampleBy`` would be neither exact nor partition-stable.
    """
    q_pos, q_neg = stratified_quotas(df, label_col, n)
    h = sample_key(id_col, seed)
    lab = F.col(label_col).cast("int")
    pos = df.filter(lab == 1).withColumn("_h", h).orderBy("_h", id_col).limit(q_pos)
    neg = df.filter(lab != 1).withColumn("_h", h).orderBy("_h", id_col).limit(q_neg)
    return pos.unionByName(neg).drop("_h")


def uniform_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """R2: exactly n rows without replacement, by hash order (partition-independent).

    The global top-n is a ``TakeOrderedAndProject``: each task keeps only its
    own n best rows, so no task ever holds more than n rows per partition.
    """
    return (df.withColumn("_h", sample_key(id_col, seed))
              .orderBy("_h", id_col).limit(n).drop("_h"))
