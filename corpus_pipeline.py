"""The corpus pipeline: stages that each take the documents the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import caseloom
from caseloom.llm.common import if_small, materialise, small_batches, table
from caseloom.llm.decontamination import contaminated
from caseloom.llm.mixing import mixed_rows
from caseloom.llm.near_dups import near_duplicates
from caseloom.llm.quality_classifier import fit_compression_model, score_quality
from caseloom.llm.sharding import shard_rows

# Ship the package's Python functions with the tasks, wherever the session was started.
cloudpickle.register_pickle_by_value(caseloom)

N_SHARDS = 40


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in ``_row``, beside ``doc_id``, ``text`` and ``source``: no name can clash."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose id is (``left_semi``) or is not (``left_anti``) in ``ids``."""
    ids = materialise(ids.select(F.col("doc_id").alias("_wanted")), "ids")
    return packed(docs).join(if_small(ids, ids.count()), F.col("doc_id") == F.col("_wanted"), how).select("_row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier scores below 0.5."""
    small_batches(spark)
    model = fit_compression_model(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return score_quality(packed(docs), ["_row"], model).where("score >= 0.5").select("_row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words, a similarity of 0.8.

    Rows that repeat an id stay together; a row without id stays.
    """
    small_batches(spark)
    dropped = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return only(docs, dropped, "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages, as they are or with other values."""
    small_batches(spark)
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return only(docs, found, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources until the sources have their weights; none is dropped."""
    return mixed_rows(packed(docs), budget=None, carry=["_row"]).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: the rows in 40 shards of nearly equal bytes."""
    return shard_rows(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near duplicates", keep_distinct),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# A trained classifier, a schedule and permutations by hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
