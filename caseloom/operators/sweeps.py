"""Evaluation of the escalation policy and threshold sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import constants as K
from caseloom.functions.numbers import half_up, share
from caseloom.operators.policy import rule_flags
from caseloom.session import small_table

# --- fixed values: grid of the validation sweep, steps of 0.05 in binary floating point ---
VALIDATION_GRID = (
    [float(x) for x in np.arange(0.30, 0.75, 0.05)],
    [float(x) for x in np.arange(0.20, 0.65, 0.05)],
)


def needs_human(true_intent: Column, confidence: Column) -> Column:
    """Stand-in label for messages that a human should handle."""
    return (true_intent == K.OTHER) | (confidence < 0.3)


def policy_metrics(decided: DataFrame) -> DataFrame:
    """One row of rates from ``escalate``, ``true_intent``, ``intent`` and ``confidence``."""
    human = needs_human(F.col("true_intent"), F.col("confidence"))
    auto = ~F.col("escalate")
    counts = decided.agg(
        F.count("*").alias("n_total"),
        F.count_if(auto).alias("n_auto"),
        F.count_if(F.col("escalate")).alias("n_escalated"),
        F.count_if(human).alias("n_needs_human"),
        F.count_if(auto & human).alias("n_false_auto"),
        F.count_if(F.col("escalate") & ~human).alias("n_false_escalation"),
        F.count_if(auto & (F.col("intent") == F.col("true_intent"))).alias("n_right_auto"),
    )
    n = F.col("n_total")
    right = F.col("n_auto") - F.col("n_false_auto")
    return counts.select(
        "n_total", "n_auto", "n_escalated", "n_needs_human", "n_false_auto", "n_false_escalation",
        share(F.col("n_auto"), n).alias("coverage"),
        share(F.col("n_escalated"), n).alias("escalation_rate"),
        share(F.col("n_false_auto"), n).alias("false_auto_rate"),
        share(F.col("n_false_escalation"), n).alias("false_escalation_rate"),
        half_up(right / F.greatest(F.col("n_auto"), F.lit(1)), 4).alias("selective_accuracy_proxy"),
        share(F.col("n_right_auto"), F.col("n_auto")).alias("selective_accuracy_label"),
    )


def reason_counts(decided: DataFrame) -> DataFrame:
    """Escalations by the raw reason text, numbers included.

    The rows that are not escalated are counted as 0 and dropped after the aggregation: a
    filter before it would make Spark evaluate the whole rule chain twice per row.
    """
    counts = decided.groupBy(F.col("escalation_reason").alias("reason")).agg(
        F.count_if(F.col("escalate")).alias("n")
    )
    return counts.where(F.col("n") > 0)


def rule_shares(decided: DataFrame) -> DataFrame:
    """Escalations by rule, so that reasons with numbers count as one, and their share."""
    counts = decided.groupBy("rule_id").agg(F.count_if(F.col("escalate")).alias("n"))
    # One row per rule.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", share(F.col("n") * 100.0, total, 2)).where(F.col("n") > 0)


def _reached(value: Column, limits: list[float]) -> Column:
    """How many of the rising limits the value reaches."""
    return sum(((value >= F.lit(x)).cast("int") for x in limits), F.lit(0))


def _sweep(rows: DataFrame, blocked: Column, human: Column, grid: tuple[list[float], list[float]]) -> DataFrame:
    """Counts of every grid cell.

    A row is handled at a pair of limits when nothing else blocks it and it reaches both. So
    only the number of limits it reaches matters: one aggregation to at most
    4 * (len + 1)^2 rows, and the grid is then applied to that histogram instead of to the rows.
    """
    conf_limits, sim_limits = grid
    hist = rows.groupBy(
        _reached(F.col("confidence"), conf_limits).alias("c"),
        _reached(F.coalesce("top_similarity", F.lit(0.0)), sim_limits).alias("s"),
        F.coalesce(blocked, F.lit(False)).alias("blocked"),
        F.coalesce(human, F.lit(False)).alias("human"),
    ).agg(F.count("*").alias("n"))
    cells = F.explode_outer(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("ci"), F.lit(j).alias("si"),
                    F.lit(round(c, 2)).alias("conf_threshold"), F.lit(round(s, 2)).alias("sim_threshold"),
                )
                for i, c in enumerate(conf_limits, start=1)
                for j, s in enumerate(sim_limits, start=1)
            ]
        )
    )
    auto = ~F.col("blocked") & (F.col("c") >= F.col("cell.ci")) & (F.col("s") >= F.col("cell.si"))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))

    return (
        hist.withColumn("cell", cells)
        .groupBy("cell.conf_threshold", "cell.sim_threshold")
        .agg(
            F.sum("n").alias("n_total"),
            count(auto).alias("n_auto"),
            count(auto & F.col("human")).alias("n_false_auto"),
            count(~auto & ~F.col("human")).alias("n_false_escalation"),
        )
    )


def sweep_policy(df: DataFrame, grid: tuple[list[float], list[float]] = K.POLICY_GRID) -> DataFrame:
    """Automation and false automation of the whole policy at every pair of limits.

    ``df`` has what :func:`policy.escalate` needs and ``true_intent``. The rules that know no
    limit are evaluated once per row.
    """
    rows = rule_flags(df)
    blocked = (
        F.col("rule_action") | F.col("rule_short") | F.col("rule_phrase") | F.col("rule_taxonomy")
        | F.col("rule_no_cases") | F.col("rule_conflict")
    )
    cells = _sweep(rows, blocked, needs_human(F.col("true_intent"), F.col("confidence")), grid)
    n = F.col("n_total")
    return cells.select(
        "conf_threshold", "sim_threshold", "n_auto", "n_false_auto",
        share(F.col("n_auto"), n).alias("auto_rate"),
        share(F.col("n_false_auto"), n).alias("false_auto_rate"),
    )


def sweep_validation(
    records: DataFrame,
    similarities: DataFrame | None = None,
    key: str = "conversation_id",
    grid: tuple[list[float], list[float]] = VALIDATION_GRID,
) -> DataFrame:
    """Rates of the light rule set at every pair of limits.

    ``records`` has ``intent`` and ``confidence``; ``similarities`` holds the best similarity
    per key and a missing one counts as 0.
    """
    rows = records
    if similarities is not None:
        rows = records.join(similarities.select(key, "top_similarity"), key, "left")
    rows = rows.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.5)),
            "intent": F.coalesce("intent", F.lit(K.OTHER)),
        }
    )
    human = needs_human(F.col("intent"), F.col("confidence"))
    cells = _sweep(rows, human, human, grid)
    n = F.col("n_total")
    return cells.select(
        "conf_threshold", "sim_threshold",
        share(F.col("n_auto"), n).alias("auto_rate"),
        share(n - F.col("n_auto"), n).alias("escalation_rate"),
        share(F.col("n_false_auto"), n).alias("false_auto_rate"),
        share(F.col("n_false_escalation"), n).alias("false_escalation_rate"),
        "n_false_auto", "n_false_escalation",
    )


def safe_thresholds(grid: DataFrame) -> DataFrame:
    """The cell with the least false automation, then the least escalation, then grid order."""
    return grid.orderBy("false_auto_rate", "escalation_rate", "conf_threshold", "sim_threshold").limit(1)


def against_targets(metrics: DataFrame) -> DataFrame:
    """Join ``(metric, value)`` rows with the fixed targets and tell which are met."""
    targets = small_table(
        metrics.sparkSession, K.METRIC_TARGETS, "metric STRING, direction STRING, target DOUBLE"
    )
    met = F.when(F.col("direction") == ">=", F.col("value") >= F.col("target")).otherwise(
        F.col("value") <= F.col("target")
    )
    return targets.join(metrics, "metric", "left").select(
        "metric", "value", "direction", "target", F.coalesce(met, F.lit(False)).alias("met")
    )


def as_metric_rows(row: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Turn columns of a one-row table into ``(metric, value)`` rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"))
            for c, metric in columns.items()
        ]
    )
    return row.select(F.inline(pairs))
