"""Session helpers: building a session for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "riskweave") -> SparkSession:
    """Session used by tests and bench. On a cluster, callers bring their own."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RISKWEAVE_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one in
    local mode (tests), never on a cluster where a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running "
                           "iterative operators on a cluster")
    path = tempfile.mkdtemp(prefix="riskweave-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back.

    A reliable ``checkpoint()`` would also survive a lost executor, but it
    carries the pre-checkpoint size estimate forward; in iterative joins
    (components, Boruvka) that estimate is squared every round and the
    driver ends up multiplying enormous integers while planning. A written
    table restarts the estimate from its real size, cuts the lineage, and
    lives in the folder the cluster names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/riskweave-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables written by ``cut_lineage`` that nothing will read again.

    Only call it once everything derived from them has itself been written:
    a lazy plan over a deleted table fails.
    """
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path is None:
            continue
        jvm = t.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
