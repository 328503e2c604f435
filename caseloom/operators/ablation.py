"""Three settings of the decision chain, compared.

A: no retrieval; B: retrieval without the policy; C: everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.numbers import half_up, share
from caseloom.operators.drafting import Generator, draft_from_template
from caseloom.operators.policy import decide, escalate
from caseloom.operators.rubric import SCORES, score_replies

COLUMNS = ["setting", "true_intent", "intent", "draft_reply", "evidence", "escalate", *SCORES, "has_unsupported_claim"]


def _without_policy(df: DataFrame, key: str, setting: str, generate: Generator) -> DataFrame:
    drafted = generate(df).withColumn("escalate", F.lit(False))
    return score_replies(drafted).select(key, F.lit(setting).alias("setting"), *COLUMNS[1:])


def setting_a(df: DataFrame, key: str, generate: Generator = draft_from_template) -> DataFrame:
    """Draft with no cases; whatever the reply cites is not counted as evidence."""
    bare = df.withColumn("cases", F.array().cast(df.schema["cases"].dataType))
    no_evidence = F.array().cast("array<string>")
    return _without_policy(bare, key, "A", lambda d: generate(d).withColumn("evidence", no_evidence))


def setting_b(df: DataFrame, key: str, generate: Generator = draft_from_template) -> DataFrame:
    return _without_policy(df, key, "B", generate)


def setting_c(df: DataFrame, key: str, generate: Generator = draft_from_template, **limits: float) -> DataFrame:
    """The whole chain; an escalated row scores 0 and is left out of the averages."""
    decided = decide(generate(escalate(df, **limits)))
    scored = score_replies(decided)
    zeroed = {s: F.when(F.col("escalate"), F.lit(0)).otherwise(F.col(s)) for s in SCORES}
    zeroed["has_unsupported_claim"] = ~F.col("escalate") & F.col("has_unsupported_claim")
    return scored.withColumns(zeroed).select(key, F.lit("C").alias("setting"), *COLUMNS[1:])


def all_settings(df: DataFrame, key: str, **limits: float) -> DataFrame:
    return setting_a(df, key).unionByName(setting_b(df, key)).unionByName(setting_c(df, key, **limits))


def setting_metrics(results: DataFrame) -> DataFrame:
    """Per setting: how much is automated and the average scores of that part."""
    auto = ~F.col("escalate")
    averages = [
        half_up(F.coalesce(F.avg(F.when(auto, F.col(s))), F.lit(0.0)), 3).alias(f"avg_{s}")
        for s in ("groundedness", "relevance", "tone", "correctness", "overall")
    ]
    return results.groupBy("setting").agg(
        F.count("*").alias("n_total"),
        F.count_if(auto).alias("n_auto"),
        F.count_if(~auto).alias("n_escalated"),
        share(F.count_if(auto), F.count("*")).alias("auto_rate"),
        *averages,
        share(F.count_if(auto & F.col("has_unsupported_claim")), F.count_if(auto)).alias("unsupported_claim_rate"),
    )


def setting_deltas(metrics: DataFrame) -> DataFrame:
    """Change of each setting against the one before it (B - A, C - B); three rows in all."""
    before = Window.orderBy("setting")
    named = ["auto_rate", "avg_groundedness", "avg_relevance", "avg_overall", "unsupported_claim_rate"]
    return metrics.select(
        "setting",
        F.lag("setting").over(before).alias("compared_with"),
        *[half_up(F.col(c) - F.lag(c).over(before), 4).alias(f"delta_{c}") for c in named],
    ).where(F.col("compared_with").isNotNull())
