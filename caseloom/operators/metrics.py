"""Classification metrics. Everything derives from the confusion counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.numbers import half_up
from caseloom.session import small_table


def confusion_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(truth, predicted, n)``: the only pass over the data; the rest has classes^2 rows."""
    return df.groupBy(
        F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, classes: list[str]) -> DataFrame:
    """One row per true class and one column per predicted class, missing pairs as 0."""
    wide = counts.groupBy("truth").pivot("predicted", classes).agg(F.sum("n"))
    labels = small_table(counts.sparkSession, [(c,) for c in classes], "truth STRING")
    return labels.join(wide, "truth", "left").na.fill(0, classes)


def class_scores(counts: DataFrame) -> DataFrame:
    """Unrounded precision, recall, F1 and support of each class seen on either side."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)))
    by_truth = counts.groupBy(F.col("truth").alias("class")).agg(
        F.sum("n").alias("support"), hit.alias("true_hits")
    )
    by_guess = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guesses"))
    joined = by_truth.join(by_guess, "class", "full").select(
        "class",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "true_hits", "guesses")],
    )
    hits = F.col("true_hits").cast("double")
    none = F.lit(0.0)
    return joined.select(
        "class",
        F.when(F.col("guesses") > 0, hits / F.col("guesses")).otherwise(none).alias("precision"),
        F.when(F.col("support") > 0, hits / F.col("support")).otherwise(none).alias("recall"),
        F.when(
            F.col("support") + F.col("guesses") > 0,
            2.0 * hits / (F.col("support") + F.col("guesses")),
        ).otherwise(none).alias("f1"),
        "support",
        "true_hits",
    )


def per_class_table(scores: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Rounded scores; with ``classes`` (column ``class``) exactly those classes are listed."""
    if classes is not None:
        scores = classes.join(scores, "class", "left")
    return scores.select(
        "class",
        *[half_up(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce("support", F.lit(0)).alias("support"),
    )


def overall_scores(scores: DataFrame) -> DataFrame:
    """One row: accuracy with macro and support-weighted averages."""
    kinds = ("precision", "recall", "f1")
    return scores.agg(
        F.sum("support").alias("rows"),
        half_up(F.sum("true_hits") / F.sum("support"), 4).alias("accuracy"),
        *[half_up(F.avg(k), 4).alias(f"macro_{k}") for k in kinds],
        *[
            half_up(F.sum(F.col(k) * F.col("support")) / F.sum("support"), 4).alias(f"weighted_{k}")
            for k in kinds
        ],
    )


def evaluate(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return overall_scores(class_scores(confusion_counts(df, truth, predicted)))


def most_confused(counts: DataFrame, n: int = 10) -> DataFrame:
    # The condition includes the count, so that it stays above the aggregation.
    wrong = counts.where((F.col("n") > 0) & (F.when(F.col("truth") != F.col("predicted"), F.col("n")) > 0))
    return wrong.orderBy(F.desc("n"), "truth", "predicted").limit(n)


def compare_models(
    predictions: dict[str, Callable[[DataFrame], DataFrame]],
    splits: dict[str, DataFrame],
    truth: str = "intent",
) -> DataFrame:
    """``(model, split, metrics...)`` of every model on every split."""
    rows = None
    for model, predict in predictions.items():
        for split, data in splits.items():
            scored = evaluate(predict(data), truth, "predicted_intent").select(
                F.lit(model).alias("model"), F.lit(split).alias("split"), "*"
            )
            rows = scored if rows is None else rows.unionByName(scored)
    if rows is None:
        raise ValueError("nothing to compare")
    return rows


def best_model(comparison: DataFrame, select_on: str = "val") -> DataFrame:
    """The model with the best macro F1. ``select_on="test"`` repeats the published choice."""
    order = Window.orderBy(F.desc("macro_f1"), "model")
    chosen = comparison.where(F.col("split") == select_on)
    return chosen.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def improvements(comparison: DataFrame, best: DataFrame, split: str = "test") -> DataFrame:
    """Absolute and relative macro-F1 gain of the chosen model over each other model."""
    rows = comparison.where(F.col("split") == split).select("model", "macro_f1")
    chosen = rows.join(F.broadcast(best.select("model")), "model", "left_semi").select(
        F.max(F.struct("model", "macro_f1")).alias("b")
    ).scalar()
    gain = F.col("b.macro_f1") - F.col("macro_f1")
    return (
        rows.withColumn("b", chosen)
        .where(F.col("model") != F.col("b.model"))
        .select(
            F.col("b.model").alias("best_model"),
            F.col("model").alias("baseline"),
            half_up(gain, 4).alias("absolute_gain"),
            half_up(gain * 100.0 / F.greatest(F.col("macro_f1"), F.lit(1e-5)), 2).alias("relative_gain_pct"),
        )
    )
