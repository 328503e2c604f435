"""Rule taxonomy: labels, counts and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.constants import INTENT_PATTERNS, INTENT_TEXTS, OTHER
from caseloom.functions.numbers import half_up
from caseloom.functions.text import count_matching, matching_sql, split_words
from caseloom.session import small_table

Rules = dict[str, list[str]]


def intent_hits(text: str, rules: Rules = INTENT_PATTERNS) -> Column:
    """Array of ``(hits, order, intent)`` for a column of lower-cased text, ``order`` falling."""
    return F.array(
        *[
            F.struct(
                count_matching(text, patterns).alias("hits"),
                F.lit(-i).alias("order"),
                F.lit(intent).alias("intent"),
            )
            for i, (intent, patterns) in enumerate(rules.items())
        ]
    )


def label_intents(
    df: DataFrame, message: str = "customer_message", rules: Rules = INTENT_PATTERNS
) -> DataFrame:
    """Add ``intent`` and ``intent_confidence``.

    The intent with the most matching patterns wins and the one declared first breaks ties.
    """
    counts = ", ".join(matching_sql("_text", patterns) for patterns in rules.values())
    # A lambda keeps the many tests out of the method that Spark writes for a whole stage, which would be too
    # long to be compiled to machine code.
    each = df.withColumn("_texts", F.array(F.lower(F.col(message)))).withColumn(
        "_counts", F.expr(f"transform(_texts, _text -> array({counts}))[0]")
    )
    best = each.withColumn("_hits", F.array_max("_counts"))
    names = F.array(*[F.lit(name) for name in rules])
    winner = F.element_at(names, F.array_position("_counts", F.col("_hits")).cast("int"))
    hits = F.col("_hits")
    confidence = F.least(F.lit(1.0), half_up(hits * F.lit(0.4) + F.lit(0.2), 2))
    return best.withColumns(
        {
            # Not nullable, so that joins on it need no null filter over these expressions.
            "intent": F.coalesce(F.when(hits > 0, winner), F.lit(OTHER)),
            "intent_confidence": F.when(hits > 0, confidence).otherwise(F.lit(0.0)),
        }
    ).drop("_texts", "_counts", "_hits")


def hit_table(df: DataFrame, key: str, message: str, rules: Rules = INTENT_PATTERNS) -> DataFrame:
    """Long form ``(key, intent, hits)`` of the intents with at least one matching pattern."""
    # The outer form keeps Spark from testing the array in an added filter, at double cost.
    lower = df.select(key, F.lower(F.col(message)).alias("_text"))
    entry = F.explode_outer(intent_hits("_text", rules)).alias("e")
    return lower.select(key, entry).select(key, "e.intent", "e.hits").where(F.col("hits") > 0)


def intent_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("intent").agg(F.count("*").alias("sample_count"))


def representative_examples(
    labelled: DataFrame, order: str, message: str = "customer_message", n: int = 5, min_words: int = 4
) -> DataFrame:
    """The first ``n`` messages of each intent with at least ``min_words`` words.

    The rank filter is applied per partition before the shuffle, so a dominant intent sends
    ``n`` rows per partition.
    """
    first = Window.partitionBy("intent").orderBy(order)
    return (
        labelled.where(F.size(split_words(F.col(message))) >= min_words)
        .select("intent", order, message)
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
    )


def taxonomy_texts(spark, rules: Rules = INTENT_PATTERNS) -> DataFrame:
    """One row per declared intent and one for the rest: order, name and describing texts."""
    names = [*rules, OTHER]
    rows = [(i, name, *INTENT_TEXTS.get(name, ("", "", ""))) for i, name in enumerate(names)]
    return small_table(
        spark,
        rows,
        "intent_order INT, name STRING, description STRING, inclusion_criteria STRING, "
        "exclusion_criteria STRING",
    )


def taxonomy_table(
    labelled: DataFrame,
    order: str,
    message: str = "customer_message",
    rules: Rules = INTENT_PATTERNS,
    n_examples: int = 5,
) -> DataFrame:
    """Report record of every declared intent, also of those that never occur."""
    examples = (
        representative_examples(labelled, order, message, n_examples)
        .groupBy("intent")
        .agg(F.array_sort(F.collect_list(F.struct("rank", message))).alias("ranked"))
        .select(
            F.col("intent").alias("name"),
            F.transform("ranked", lambda r: r[message]).alias("representative_examples"),
        )
    )
    counts = intent_counts(labelled).withColumnRenamed("intent", "name")
    return (
        taxonomy_texts(labelled.sparkSession, rules)
        .join(counts, "name", "left")
        .join(examples, "name", "left")
        .select(
            "intent_order", "name", "description", "inclusion_criteria", "exclusion_criteria",
            F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
            F.coalesce("representative_examples", F.array().cast("array<string>")).alias(
                "representative_examples"
            ),
        )
    )


def intent_distribution(labelled: DataFrame, rules: Rules = INTENT_PATTERNS) -> DataFrame:
    """Count and percentage of every declared intent."""
    counts = intent_counts(labelled).withColumnRenamed("intent", "name")
    full = (
        taxonomy_texts(labelled.sparkSession, rules)
        .select("intent_order", "name")
        .join(counts, "name", "left")
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    )
    total = F.sum("sample_count").over(Window.partitionBy())
    share = F.when(total > 0, half_up(F.col("sample_count") * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return full.withColumn("share_pct", share)
