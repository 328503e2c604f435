"""Cleaning of raw messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import clean_text


def clean_tweets(raw: DataFrame) -> DataFrame:
    """Distinct rows that have their keys and a non-empty ``cleaned_text``.

    The row filters come before the distinct: they give the same rows and less to shuffle. The
    distinct combines copies before its shuffle, so a heavily copied row is no hot key.
    """
    kept = raw.where(
        F.col("tweet_id").isNotNull()
        & F.col("author_id").isNotNull()
        & (clean_text(F.col("text")) != "")
    )
    return kept.dropDuplicates().withColumn("cleaned_text", clean_text(F.col("text")))


def clean_counts(raw: DataFrame) -> DataFrame:
    """One row: how many rows each cleaning step drops, in the order of the steps."""
    keyless = F.col("tweet_id").isNull() | F.col("author_id").isNull()
    empty = clean_text(F.col("text")) == ""
    distinct = raw.groupBy(*raw.columns).agg(F.count("*").alias("copies"))
    return distinct.agg(
        F.sum("copies").alias("rows_in"),
        F.sum(F.col("copies") - 1).alias("dropped_duplicates"),
        F.count_if(keyless).alias("dropped_missing_keys"),
        F.count_if(~keyless & empty).alias("dropped_empty_text"),
        F.count_if(~keyless & ~empty).alias("rows_out"),
    )
