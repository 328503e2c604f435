"""Offline preparation: from raw messages to labelled, split conversations of one brand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.constants import MIN_BRAND_CONVERSATIONS
from caseloom.functions.text import parse_created_at
from caseloom.operators import brands, intents, profile, splits, threads
from caseloom.operators.cleaning import clean_counts, clean_tweets
from caseloom.sources import writers


def prepare(
    raw: DataFrame,
    out: str,
    min_conversations: int = MIN_BRAND_CONVERSATIONS,
) -> DataFrame:
    """Write every table of the preparation below ``out`` and return the artifact check.

    Each stage reads what the stage before it wrote, so a lost executor repeats one stage.
    """
    spark = raw.sparkSession
    writers.write_report(profile.missing_values(raw), f"{out}/profile/missing_values")
    writers.write_report(profile.directions(raw), f"{out}/profile/directions")
    writers.write_report(profile.text_lengths(raw), f"{out}/profile/text_lengths")
    writers.write_report(profile.top_brand_authors(raw), f"{out}/profile/top_brand_authors")
    writers.write_report(clean_counts(raw), f"{out}/profile/cleaning")

    threads.thread_turns(clean_tweets(raw)).write.mode("overwrite").parquet(f"{out}/turns")
    turns = spark.read.parquet(f"{out}/turns")
    threads.summarise_threads(turns).write.mode("overwrite").parquet(f"{out}/conversations")
    threads.history_pages(turns).write.mode("overwrite").parquet(f"{out}/history")
    convs = spark.read.parquet(f"{out}/conversations")

    table = brands.brand_table(convs, min_conversations)
    writers.write_report(brands.rank_brands(brands.brand_scores(table)), f"{out}/brand_ranking")
    ranking = spark.read.parquet(f"{out}/brand_ranking/parquet")
    best = ranking.where(F.col("rank") == 1).select("brand").head()
    if best is None:
        raise ValueError("no brand has enough conversations")

    labelled = intents.label_intents(brands.of_brand(convs, best["brand"]))
    split = splits.random_split(labelled, "conversation_id")
    split = splits.temporal_split(split, "conversation_id", parse_created_at(F.col("timestamp")))
    writers.write_splits(split, f"{out}/splits")
    split = spark.read.parquet(f"{out}/splits")
    splits.assert_disjoint(split, "conversation_id")
    writers.write_report(
        splits.leakage_audit(split, ["conversation_id", "customer_id", "customer_message"], True),
        f"{out}/leakage",
    )
    writers.write_taxonomy(intents.taxonomy_table(split, "conversation_id"), f"{out}/taxonomy")
    return writers.require_artifacts(
        spark,
        {
            "conversations": ("parquet", f"{out}/conversations"),
            "history": ("parquet", f"{out}/history"),
            "splits": ("parquet", f"{out}/splits"),
            "taxonomy": ("json", f"{out}/taxonomy"),
            "profile": ("parquet", f"{out}/profile/missing_values/parquet"),
            "brand_ranking": ("parquet", f"{out}/brand_ranking/parquet"),
        },
    )
