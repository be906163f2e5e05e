"""Corpus preparation in five stages, each calling one operator of ``riskweave.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them to ``documents``, writing every
stage's result as Parquet into the shared folder and reading it again. All
stages but the last return the columns of ``documents``.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: repeated lines go from all but the first document holding them;
   ``n_chars`` follows the text.
3. near_copies: of each group of near copies the document with the least id stays.
4. decontaminate: documents holding a benchmark passage go.
5. encode: token counts and digests per document.

Null or repeated ids, null or empty texts and empty tables are treated as each
operator's docstring says; no stage drops a row for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, decontam, jaccardjoin, linededup, quality
from riskweave.session import cut_lineage


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(source, labels, "doc_id", "text", "quality", folds=5, held=0)
    return quality.keep_good(docs, model)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccardjoin.drop_near_copies(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.round_trip_report(docs, bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", _quality),
    ("line_dedup", _line_dedup),
    ("near_copies", _near_copies),
    ("decontaminate", _decontaminate),
    ("encode", _encode),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
