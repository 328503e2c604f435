"""Brand statistics over conversations and the choice of a brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.constants import BRAND_WEIGHTS, MIN_BRAND_CONVERSATIONS
from caseloom.functions.numbers import half_up
from caseloom.functions.text import split_words


def brand_counts(conversations: DataFrame) -> DataFrame:
    """Conversations, turns, multi-turn and resolved conversations of each brand."""
    return conversations.groupBy("brand").agg(
        F.count("*").alias("total_conversations"),
        F.sum("turns").alias("total_turns"),
        F.count_if(F.col("turns") >= 3).alias("multi_turn_convs"),
        F.count_if(F.col("resolution_available")).alias("resolutions_count"),
    )


def brand_vocabulary(conversations: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct lower-cased words in the first messages to each brand.

    The distinct shuffles on (brand, word), so a dominant brand is spread over its words.
    """
    words = conversations.select(
        "brand", F.explode(split_words(F.lower("customer_message"))).alias("word")
    )
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return words.groupBy("brand").agg(counter("word").alias("vocab_size"))


def brand_table(
    conversations: DataFrame,
    min_conversations: int = MIN_BRAND_CONVERSATIONS,
    approximate: bool = False,
) -> DataFrame:
    """Counts and ratios of every brand that is large enough."""
    counts = brand_counts(conversations).where(F.col("total_conversations") >= min_conversations)
    n = F.col("total_conversations")
    return counts.join(brand_vocabulary(conversations, approximate), "brand", "left").select(
        "brand",
        "total_conversations",
        "multi_turn_convs",
        half_up(F.col("multi_turn_convs") / n * 100, 1).alias("multi_turn_pct"),
        half_up(F.col("total_turns") / n, 2).alias("avg_turns"),
        "resolutions_count",
        half_up(F.col("resolutions_count") / n * 100, 1).alias("res_pct"),
        F.coalesce("vocab_size", F.lit(0)).alias("vocab_size"),
    )


def _of_max(table: DataFrame, column: str) -> Column:
    """The column divided by its maximum; null where the maximum is 0."""
    return F.col(column) / F.nullif(table.select(F.max(column).alias("m")).scalar(), F.lit(0))


def brand_scores(table: DataFrame, weights: dict[str, float] = BRAND_WEIGHTS) -> DataFrame:
    """Scores relative to the best brand, and their weighted sum."""
    scored = table.select(
        "*",
        _of_max(table, "total_conversations").alias("score_vol"),
        _of_max(table, "multi_turn_convs").alias("score_multi"),
        _of_max(table, "vocab_size").alias("score_vocab"),
        _of_max(table, "res_pct").alias("score_res"),
    )
    return scored.withColumn(
        "composite_score",
        F.lit(weights["volume"]) * F.col("score_vol")
        + F.lit(weights["multi_turn"]) * F.col("score_multi")
        + F.lit(weights["vocabulary"]) * F.col("score_vocab")
        + F.lit(weights["resolution"]) * F.col("score_res"),
    )


def rank_brands(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best brands with their rank; the name breaks ties.

    The rank window sees only the ``n`` rows that the top-n step left over.
    """
    order = [F.desc_nulls_last("composite_score"), F.asc("brand")]
    best = scores.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def of_best_brand(conversations: DataFrame, scores: DataFrame) -> DataFrame:
    """Conversations of the best brand, as a lazy semi join with a one-row table."""
    return conversations.join(F.broadcast(rank_brands(scores, 1).select("brand")), "brand", "left_semi")


def of_brand(conversations: DataFrame, brand: str) -> DataFrame:
    return conversations.where(F.col("brand") == brand)
