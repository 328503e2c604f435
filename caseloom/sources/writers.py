"""Writers and the check of what they wrote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.lsa import LsaModel


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_splits(split: DataFrame, path: str, as_json: bool = False) -> None:
    """One folder per split, so that reading one split prunes the others."""
    writer = split.write.mode("overwrite").partitionBy("split")
    writer.json(path) if as_json else writer.parquet(path)


def write_taxonomy(taxonomy: DataFrame, path: str, version: str = "1.0") -> None:
    """The taxonomy as one nested JSON object with its metadata; one row per declared intent."""
    record = F.struct(
        "name", "description", "inclusion_criteria", "exclusion_criteria", "sample_count",
        "representative_examples",
    )
    nested = taxonomy.agg(
        F.struct(F.count("*").alias("total_intents"), F.lit(version).alias("version")).alias("metadata"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("intent_order", record.alias("r")))), lambda x: x["r"]
        ).alias("intents"),
    )
    nested.write.mode("overwrite").json(path)


def write_report(table: DataFrame, path: str) -> None:
    """A report is a table: Parquet for later use and CSV for reading, if it has flat columns.

    The CSV copy is made from the Parquet files, so the report's plan runs once.
    """
    table.write.mode("overwrite").parquet(f"{path}/parquet")
    flat = all(t not in k for _, k in table.dtypes for t in ("array", "struct", "map"))
    if flat:
        stored = table.sparkSession.read.schema(table.schema).parquet(f"{path}/parquet")
        stored.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


@dataclass
class CaseIndex:
    """Stored cases with their embeddings, and the model that made them."""

    cases: DataFrame
    model: LsaModel


def write_index(index: CaseIndex, path: str, source: str, spark: SparkSession) -> None:
    index.model.save(f"{path}/model", spark)
    index.cases.write.mode("overwrite").parquet(f"{path}/cases")
    config = spark.read.parquet(f"{path}/cases").agg(
        F.lit("tfidf+svd").alias("embedding_type"),
        F.count("*").alias("total_examples"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
        F.lit(source).alias("source_path"),
        F.current_timestamp().cast("string").alias("indexed_at"),
    )
    config.write.mode("overwrite").json(f"{path}/config")


def read_index(spark: SparkSession, path: str) -> CaseIndex:
    """Fails when a part is missing."""
    return CaseIndex(spark.read.parquet(f"{path}/cases"), LsaModel.load(spark, f"{path}/model"))


def artifact_status(spark: SparkSession, artifacts: dict[str, tuple[str, str]]) -> DataFrame:
    """``(artifact, rows, ok)`` for ``{name: (format, path)}``; a missing one has 0 rows."""
    rows = []
    for name, (fmt, path) in artifacts.items():
        try:
            n = spark.read.format(fmt).load(path).count()
        except AnalysisException:  # a missing path or one without data files
            n = 0
        rows.append((name, n, n > 0))
    return spark.createDataFrame(rows, "artifact STRING, rows BIGINT, ok BOOLEAN")


def require_artifacts(spark: SparkSession, artifacts: dict[str, tuple[str, str]]) -> DataFrame:
    status = artifact_status(spark, artifacts)
    bad = [r["artifact"] for r in status.where(~F.col("ok")).collect()]
    if bad:
        raise RuntimeError(f"missing or empty artifacts: {bad}")
    return status
