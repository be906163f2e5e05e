"""Sources and sinks. Everything goes through Spark's own
readers/writers; no file is read or written by the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.ledger import CUSTOMER_RISK_COLUMNS  # noqa: F401  (documented schema)

CUSTOMER_RISK_SCHEMA = T.StructType([
    T.StructField("cif_nif", T.StringType()), T.StructField("cnae", T.StringType()),
    T.StructField("provincia", T.StringType()), T.StructField("pais", T.StringType()),
    T.StructField("tipo", T.StringType()), T.StructField("fecha_creacion", T.DateType()),
    T.StructField("es_moroso", T.BooleanType()), T.StructField("es_moroso_60d", T.BooleanType()),
    T.StructField("es_moroso_90d", T.BooleanType()), T.StructField("dias_mora_maximo", T.IntegerType()),
    T.StructField("saldo_pendiente_total", T.DecimalType(26, 2)),
    T.StructField("n_facturas_totales", T.LongType()), T.StructField("n_facturas_vencidas", T.LongType()),
    T.StructField("n_facturas_morosas", T.LongType()), T.StructField("proporcion_facturas_morosas", T.DoubleType()),
])


# S1 ----------------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
               **options) -> DataFrame:
    """Read parquet / csv / json with an explicit schema (no inference in production);
    a schema given for parquet is checked against the file's."""
    r = spark.read.options(**options)
    if fmt == "parquet":
        df = r.parquet(path)
        if schema is not None:
            missing = [f.name for f in schema.fields if f.name not in df.columns]
            if missing:
                raise ValueError(f"columns missing from {path}: {missing}")
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        return df
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", options.get("header", "true")).csv(path)
    if fmt == "json":
        return r.json(path)
    raise ValueError(f"unsupported format {fmt}")


# S2 / S3 ------------------------------------------------------------------------------
def read_split_layout(df_single: DataFrame | None = None, positives: DataFrame | None = None,
                      negatives: DataFrame | None = None) -> DataFrame:
    """One table, or two (positives, negatives) stacked by name; else an error."""
    if df_single is not None:
        return df_single
    if positives is not None and negatives is not None:
        return positives.unionByName(negatives, allowMissingColumns=True)
    raise ValueError("give one table, or both the positive and negative tables")


def write_split_layout(df: DataFrame, flag: str, path: str, mode: str = "overwrite") -> None:
    """Write one dataset partitioned by the flag (the two-sheet layout as partitions)."""
    df.write.mode(mode).partitionBy(flag).parquet(path)


# S4 ---------------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Replace-then-write export (Spark's overwrite is the delete-if-exists)."""
    w = df.write.mode(mode).options(**options)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


# S5 ---------------------------------------------------------------------------------
def write_metrics_json(spark: SparkSession, metrics: dict, path: str) -> None:
    """A nested metrics document as one JSON record, written by Spark."""
    spark.createDataFrame([(json.dumps(metrics, default=float),)], "doc string") \
        .select(F.col("doc")).coalesce(1).write.mode("overwrite").text(path)


def read_metrics_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", "false")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# S6 ---------------------------------------------------------------------------------
# The four column headers of the export.
def node_members_export(members: DataFrame, nodes: DataFrame, path: str, id_col: str = "id") -> None:
    """CSV per node: node, id, node delinquency rate (%), node size."""
    out = (members.join(nodes.select("node_id", "size", "tasa"), "node_id")
                  .select(F.col("node_id").alias("Nodo"), F.col(id_col).alias("CIF/NIF"),
                          F.round(F.col("tasa") * 100, 2).alias("Tasa Morosidad del Nodo (%)"),
                          F.col("size").alias("N° Clientes en Nodo"), F.col("node_id").alias("node_part")))
    out.write.mode("overwrite").partitionBy("node_part").option("header", "true").csv(path)
