"""From messages to decision records: classify, retrieve, escalate, draft."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions import constants as K
from caseloom.operators.drafting import Generator, draft_from_template
from caseloom.operators.lsa import fit_lsa
from caseloom.operators.policy import decide, escalate, trust_checks
from caseloom.operators.retrieval import case_rows, nearest_cases, pack_cases, with_case_details
from caseloom.session import cut_lineage
from caseloom.sources.writers import CaseIndex

# Adds the columns of a prediction record to rows with ``message``.
Classifier = Callable[[DataFrame], DataFrame]


def build_case_index(
    train: DataFrame, components: int = 300, max_features: int = 35_000
) -> CaseIndex:
    """Index of the resolved cases of the training conversations."""
    cases = cut_lineage(case_rows(train))
    cores = train.sparkSession.sparkContext.defaultParallelism
    if cases.rdd.getNumPartitions() < cores:  # however few files they come in
        cases = cut_lineage(cases.repartition(cores))
    model = fit_lsa(cases, "conversation_id", "customer_message", components, max_features=max_features)
    embedded = model.embed(cases, "conversation_id", "customer_message")
    return CaseIndex(cut_lineage(embedded), model)


def retrieve(messages: DataFrame, key: str, index: CaseIndex, k: int = 5, text: str = "message") -> DataFrame:
    """Add ``cases``, the ``k`` most similar stored cases, best first; [] where there are none.

    Equal messages have equal vectors, so one search serves all of them.
    """
    no_cases = F.array().cast(f"array<{schemas.CASE}>")
    if k <= 0:
        return messages.withColumn("cases", no_cases)
    asked = cut_lineage(index.model.embed(messages.select(key, text), key, text))
    found = nearest_cases(asked, index.cases, key, "conversation_id", k)
    packed = pack_cases(with_case_details(found, index.cases, key, "conversation_id"), key)
    known = asked.select(key, "n_known_terms")
    return (
        messages.join(packed.withColumn("cases", F.col("cases").cast(f"array<{schemas.CASE}>")), key, "left")
        .join(known, key)
        .withColumn("cases", F.coalesce("cases", no_cases))
    )


@dataclass
class DecisionPlan:
    """Everything needed to decide on messages; limits are those of the published system."""

    classify: Classifier
    index: CaseIndex
    generate: Generator = draft_from_template
    min_confidence: float = K.MIN_INTENT_CONFIDENCE
    min_similarity: float = K.MIN_SIMILARITY
    k: int = 5

    def score(self, messages: DataFrame, key: str) -> DataFrame:
        """Prediction and cases of each message."""
        predicted = self.classify(messages).withColumn("intent", F.col("predicted_intent"))
        return retrieve(predicted, key, self.index, self.k)

    def finish(self, scored: DataFrame) -> DataFrame:
        """Decision record of scored messages: one projection, no shuffle."""
        limits = {"min_confidence": self.min_confidence, "min_similarity": self.min_similarity}
        checked = trust_checks(escalate(scored, **limits), **limits)
        return decide(self.generate(checked))

    def run(self, messages: DataFrame, key: str) -> DataFrame:
        """``messages`` has ``key``, ``message`` and optionally ``history``."""
        return self.finish(self.score(messages, key))
