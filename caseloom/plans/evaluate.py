"""Final evaluation: score once, derive every metric from that one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import metrics, retrieval, rubric, sweeps
from caseloom.plans.decide import DecisionPlan, retrieve
from caseloom.session import cut_lineage


def score_test_set(plan: DecisionPlan, test: DataFrame) -> DataFrame:
    """Predictions, cases, decisions and drafts of labelled conversations."""
    messages = test.select(
        F.col("conversation_id"),
        F.col("customer_message").alias("message"),
        F.col("intent").alias("true_intent"),
        F.col("brand_response").alias("true_reply"),
    )
    return cut_lineage(plan.run(messages, "conversation_id"))


def retrieval_hits(scored: DataFrame) -> DataFrame:
    found = scored.select("conversation_id", "true_intent", F.explode_outer("cases").alias("c"))
    ranked = found.select(
        F.col("conversation_id").alias("query_id"), "true_intent", F.col("c.rank").alias("rank"),
        F.col("c.intent").alias("intent"),
    )
    return retrieval.judge_hits(ranked, "query_id")


def system_metrics(scored: DataFrame) -> DataFrame:
    """All headline metrics with their targets, from the scored table alone."""
    scores = metrics.evaluate(scored, "true_intent", "intent")
    found = retrieval.retrieval_metrics(retrieval_hits(scored))
    policy = sweeps.policy_metrics(scored)
    quality = rubric.quality_summary(rubric.score_replies(scored))
    rows = (
        sweeps.as_metric_rows(scores, {"macro_f1": "macro_f1", "accuracy": "accuracy"})
        .unionByName(sweeps.as_metric_rows(found, {"recall_at_5": "recall_at_5", "mrr": "mrr"}))
        .unionByName(sweeps.as_metric_rows(policy, {"selective_accuracy_label": "selective_accuracy"}))
        .unionByName(
            sweeps.as_metric_rows(
                quality,
                {"unsupported_claim_rate": "unsupported_claim_rate", "avg_groundedness": "groundedness"},
            )
        )
    )
    return sweeps.against_targets(rows)


def tune_thresholds(validation: DataFrame, plan: DecisionPlan) -> DataFrame:
    """Retrieve the best case of each validation message, sweep the limits, choose a cell."""
    asked = validation.select("conversation_id", F.col("customer_message").alias("message"))
    cases = retrieve(asked, "conversation_id", plan.index, 1)
    best = cases.select(
        "conversation_id", F.coalesce(F.get("cases", F.lit(0))["similarity_score"], F.lit(0.0)).alias("top_similarity")
    )
    records = validation.select(
        "conversation_id", "intent", F.col("intent_confidence").alias("confidence")
    )
    return sweeps.safe_thresholds(sweeps.sweep_validation(records, best))
