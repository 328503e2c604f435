"""Escalation policy, trust checks and decision labels.

A row has ``message``, ``intent``, ``confidence``, ``is_uncertain`` and ``cases``, an array of
structs that holds at least ``similarity_score`` and ``intent``, best case first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import constants as K
from caseloom.functions.numbers import half_up
from caseloom.functions.text import matches_any, strip, strip_links_and_handles

PRE = "ESCALATED_PRE_GENERATION"
POST = "ESCALATED_POST_GENERATION"
AUTO = "AUTO_HANDLED"


def asks_unavailable_action(message: str = "message") -> Column:
    return matches_any(message, K.UNAVAILABLE_ACTION_PATTERNS, ignore_case=True)


def is_too_short(message: Column) -> Column:
    return F.length(strip_links_and_handles(message)) < K.MIN_CLEAR_LENGTH


def is_ambiguous_phrase(message: str = "message") -> Column:
    return matches_any(message, K.AMBIGUOUS_PATTERNS, ignore_case=True)


def top_similarity(cases: Column) -> Column:
    first = F.get(F.transform(cases, lambda c: c["similarity_score"]), F.lit(0))
    return F.coalesce(first, F.lit(0.0))


def case_count(cases: Column) -> Column:
    return F.coalesce(F.size(cases), F.lit(0))


def is_conflicting(cases: Column, intent: Column) -> Column:
    """At least three cases, and none of the first three has the predicted intent."""
    agrees = F.exists(F.slice(cases, 1, 3), lambda c: F.coalesce(c["intent"] == intent, F.lit(False)))
    return F.coalesce((case_count(cases) >= 3) & ~agrees, F.lit(False))


def rule_flags(df: DataFrame) -> DataFrame:
    """Add one boolean per rule that needs no threshold, for sweeps and trust checks."""
    message = F.col("message")
    return df.withColumns(
        {
            "rule_action": asks_unavailable_action(),
            "rule_short": is_too_short(message),
            "rule_phrase": is_ambiguous_phrase(),
            "rule_taxonomy": (F.col("intent") == K.OTHER) | F.col("is_uncertain"),
            "rule_no_cases": case_count(F.col("cases")) <= 0,
            "rule_conflict": is_conflicting(F.col("cases"), F.col("intent")),
            "top_similarity": top_similarity(F.col("cases")),
        }
    )


def escalate(
    df: DataFrame,
    min_confidence: float = K.MIN_INTENT_CONFIDENCE,
    min_similarity: float = K.MIN_SIMILARITY,
) -> DataFrame:
    """Add ``rule_id``, ``escalate`` and ``escalation_reason`` of the first rule that holds.

    One lazy ``when`` chain: a later rule is not evaluated once an earlier one has fired.
    """
    message, cases = F.col("message"), F.col("cases")
    confidence, similarity = F.col("confidence"), top_similarity(cases)
    conf_limit, sim_limit = F.lit(min_confidence), F.lit(min_similarity)
    rules = [
        ("ACTION", asks_unavailable_action(), F.lit(K.REASON_ACTION)),
        ("TOO_SHORT", is_too_short(message), F.lit(K.REASON_AMBIGUOUS)),
        ("AMBIGUOUS", is_ambiguous_phrase(), F.lit(K.REASON_AMBIGUOUS)),
        ("TAXONOMY", (F.col("intent") == K.OTHER) | F.col("is_uncertain"), F.lit(K.REASON_TAXONOMY)),
        ("CONFIDENCE", confidence < conf_limit, F.format_string(K.REASON_CONFIDENCE, confidence, conf_limit)),
        ("NO_CASES", case_count(cases) <= 0, F.lit(K.REASON_NO_CASES)),
        ("SIMILARITY", similarity < sim_limit, F.format_string(K.REASON_SIMILARITY, similarity, sim_limit)),
        ("CONFLICT", is_conflicting(cases, F.col("intent")), F.lit(K.REASON_CONFLICT)),
    ]
    first, hold, why = rules[0]
    chain = F.when(hold, F.struct(F.lit(first).alias("rule"), why.alias("reason")))
    for name, hold, why in rules[1:]:
        chain = chain.when(hold, F.struct(F.lit(name).alias("rule"), why.alias("reason")))
    return (
        df.withColumn("_v", chain)
        .withColumns(
            {
                "rule_id": F.coalesce(F.col("_v.rule"), F.lit("NONE")),
                "escalate": F.col("_v").isNotNull(),
                "escalation_reason": F.coalesce(F.col("_v.reason"), F.lit("")),
                "top_similarity": half_up(similarity, 4),
            }
        )
        .drop("_v")
    )


def _percent(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value * 100)


def trust_checks(
    df: DataFrame,
    min_confidence: float = K.MIN_INTENT_CONFIDENCE,
    min_similarity: float = K.MIN_SIMILARITY,
) -> DataFrame:
    """Add ``trust_checks``: six independent checks, all of them always evaluated."""
    message, intent, cases = F.col("message"), F.col("intent"), F.col("cases")
    flags = df.withColumns(
        {
            "_t1": intent != K.OTHER,
            "_t2": F.col("confidence") >= F.lit(min_confidence),
            "_t3": (top_similarity(cases) >= F.lit(min_similarity)) & (case_count(cases) > 0),
            "_t4": ~asks_unavailable_action(),
            "_t5": ~(is_too_short(message) | is_ambiguous_phrase()),
            "_t6": ~is_conflicting(cases, intent),
        }
    )

    def check(name: str, passed: str, good: Column, bad: Column) -> Column:
        detail = F.when(F.col(passed), good).otherwise(bad)
        return F.struct(F.lit(name).alias("check"), F.col(passed).alias("passed"), detail.alias("detail"))

    conf = F.concat(
        F.lit("Model confidence is "), _percent(F.col("confidence"), 1),
        F.lit(f"% (threshold: {min_confidence * 100:.0f}%)."),
    )
    sim = F.when(
        case_count(cases) > 0,
        F.concat(
            F.lit("Top similarity is "), _percent(top_similarity(cases), 1),
            F.lit(f"% (threshold: {min_similarity * 100:.0f}%)."),
        ),
    ).otherwise(F.lit("No historical cases retrieved."))
    checks = F.array(
        check("Supported Intent Taxonomy", "_t1",
              F.concat(F.lit("Intent '"), intent, F.lit("' is recognized.")),
              F.lit("Intent is unknown / outside taxonomy.")),
        check(f"Intent Confidence (>= {int(min_confidence * 100)}%)", "_t2", conf, conf),
        check(f"Historical Grounding (>= {int(min_similarity * 100)}% sim)", "_t3", sim, sim),
        check("Permitted Action Scope", "_t4",
              F.lit("Permitted within autonomous response bounds."),
              F.lit("Requires human-only action (financial refund, account deletion, or fraud/legal).")),
        check("Query Clarity & Specificity", "_t5",
              F.lit("Query is sufficiently specific."),
              F.lit("Query is ambiguous or lacks necessary context.")),
        check("Consistent Historical Guidance", "_t6",
              F.lit("Historical evidence aligns with predicted intent."),
              F.lit("Historical evidence shows conflicting intents.")),
    )
    return flags.withColumn("trust_checks", checks).drop("_t1", "_t2", "_t3", "_t4", "_t5", "_t6")


def decide(df: DataFrame) -> DataFrame:
    """Add ``decision`` and ``pipeline_stage`` after drafting.

    ``reply_escalates`` tells that the drafted reply itself asked for a human; a row stopped
    by the policy has no draft and no evidence.
    """
    if "reply_escalates" not in df.columns:
        df = df.withColumn("reply_escalates", F.lit(False))
    stopped = F.col("escalate")
    asked = ~stopped & F.col("reply_escalates")
    given = F.col("reply_reason") if "reply_reason" in df.columns else F.lit(None).cast("string")
    reason = F.coalesce(F.nullif(given, F.lit("")), F.lit(K.REASON_FROM_REPLY))
    return df.withColumns(
        {
            "draft_reply": F.when(stopped, F.lit("")).otherwise(F.col("draft_reply")),
            "evidence": F.when(stopped, F.array().cast("array<string>")).otherwise(F.col("evidence")),
            "pipeline_stage": F.when(stopped, F.lit(PRE)).when(asked, F.lit(POST)).otherwise(F.lit(AUTO)),
            "escalation_reason": F.when(asked, reason).otherwise(F.col("escalation_reason")),
            "decision": F.when(stopped | asked, F.lit("ESCALATE")).otherwise(F.lit("AUTO-HANDLE")),
            "escalate": stopped | asked,
        }
    ).drop("reply_escalates", "reply_reason")


def shape_response(df: DataFrame, *keys: str) -> DataFrame:
    """The response record: renamed and rounded fields, and cases with their defaults."""
    cases = F.transform(
        F.coalesce("cases", F.array().cast(df.schema["cases"].dataType)),
        lambda c, i: F.struct(
            F.coalesce(c["conversation_id"], F.concat(F.lit("case_"), (i + 1).cast("string"))).alias("conversation_id"),
            F.coalesce(c["historical_customer_message"], F.lit("")).alias("customer_message"),
            F.coalesce(c["historical_brand_response"], F.lit("")).alias("brand_response"),
            half_up(F.coalesce(c["similarity_score"], F.lit(0.0)), 4).alias("similarity_score"),
            F.coalesce(c["intent"], F.lit("UNKNOWN")).alias("intent"),
            F.coalesce(c["rank"], i + 1).alias("rank"),
        ),
    )
    return df.select(
        *keys,
        "decision",
        F.coalesce("draft_reply", F.lit("")).alias("draft_reply"),
        F.when(F.col("escalate"), F.col("escalation_reason")).alias("escalation_reason"),
        F.coalesce("intent", F.lit(K.OTHER)).alias("intent"),
        half_up(F.coalesce("confidence", F.lit(0.0)), 4).alias("intent_confidence"),
        cases.alias("retrieved_cases"),
        half_up(F.coalesce("top_similarity", F.lit(0.0)), 4).alias("top_similarity"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        "trust_checks",
        F.coalesce("pipeline_stage", F.lit("COMPLETED")).alias("pipeline_stage"),
    )


def split_requests(requests: DataFrame, message: str = "message") -> tuple[DataFrame, DataFrame]:
    """Valid requests with a trimmed message, and the rejected ones with an ``error``."""
    text = strip(F.coalesce(F.col(message), F.lit("")))
    valid = requests.where(text != "").withColumn(message, text)
    rejected = requests.where(text == "").withColumn("error", F.lit("Message cannot be empty."))
    return valid, rejected
