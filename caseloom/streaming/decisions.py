"""Continuous decisions on a stream of support requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.policy import shape_response, split_requests
from caseloom.plans.decide import DecisionPlan
from caseloom.session import cut_lineage

Decide = Callable[[DataFrame], DataFrame]


def decide_requests(plan: DecisionPlan, key: str = "request_id") -> Decide:
    """Function from valid requests, which carry ``key``, to response records."""

    def run(requests: DataFrame) -> DataFrame:
        history = F.coalesce("conversation_history", F.array().cast(requests.schema["conversation_history"].dataType))
        keyed = requests.withColumn("history", history).drop("conversation_history")
        return shape_response(plan.run(keyed, key), key, "message")

    return run


def start_decision_stream(
    requests: DataFrame,
    decide: Decide,
    decisions_path: str,
    quarantine_path: str,
    checkpoint_path: str,
    key: str = "request_id",
    **trigger: object,
) -> StreamingQuery:
    """Append decisions, and rejected requests to a quarantine table.

    Ranking needs a bounded table, hence ``foreachBatch``. Each micro-batch overwrites its own
    ``batch_id`` folder, so a batch that is run again after a failure leaves no second copy.
    Requests without an id get one from the batch and their place in it, written down before
    any use so that all parts of the plan see the same ids.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if key not in batch.columns:
            number = F.monotonically_increasing_id().cast("string")
            batch = cut_lineage(batch.withColumn(key, F.concat(F.lit(f"{batch_id}-"), number)))
        valid, rejected = split_requests(batch)
        rejected.write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
        decide(valid).write.mode("overwrite").parquet(f"{decisions_path}/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
