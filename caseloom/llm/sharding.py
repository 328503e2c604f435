"""Sharding by size: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import materialise, number_within
from caseloom.session import small_table

# A group with at least 1 / UNITS_PER_SHARD of a shard's share is scheduled by itself; smaller
# groups are bundled by hash into so many bundles a shard first. So the schedule has at most
# 2 * n_shards * UNITS_PER_SHARD entries, whatever the number of groups.
UNITS_PER_SHARD = 250
ROW_BYTES = 16


def schedule(sizes: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Longest processing time first: each entry goes to the shard with the least load so far."""
    loads = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for unit, size in sorted(sizes, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(loads)
        placed[unit] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def shard_rows(docs: DataFrame, n_shards: int = 40, units_per_shard: int = UNITS_PER_SHARD) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 16. Equal texts share a shard; a text that holds more
    than a shard's share makes its shard larger, as it must. Slots count from 0 in each shard.

    A null text has size 16 and no checksum, and is a group by itself (by ``doc_id``, null ids
    together), as there is no text to be equal. Empty texts are equal. Repeated rows are rows of
    their own with the same shard. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.coalesce(
                F.md5("text"), F.concat(F.lit("row "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
            ).alias("_key"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_bundles = n_shards * units_per_shard
    bundle = F.pmod(F.xxhash64("_key"), F.lit(n_bundles)).cast("string")
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_bytes"))
    alone = F.col("_bytes") * n_bundles >= total
    units = (
        groups.select(F.when(alone, F.col("_key")).otherwise(bundle).alias("_unit"), "_bytes", alone.alias("_alone"))
        .groupBy("_unit", "_alone")
        .agg(F.sum("_bytes").alias("_bytes"))
        .collect()
    )
    placed = schedule([(("g" if u._alone else "b") + u._unit, u._bytes) for u in units], n_shards)
    heavy = [(unit[1:], shard) for unit, shard in placed.items() if unit[0] == "g"]
    light = [(unit[1:], shard) for unit, shard in placed.items() if unit[0] == "b"]
    heavy_table = small_table(spark, heavy, "_key string, _heavy int")
    light_table = small_table(spark, light, "_bundle string, _light int")
    # Both tables have at most n_bundles rows.
    sharded = (
        rows.withColumn("_bundle", bundle)
        .join(F.broadcast(heavy_table), "_key", "left")
        .join(F.broadcast(light_table), "_bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("_heavy", "_light").alias("shard"))
    )
    return number_within(sharded, "shard", ["doc_id", "text_crc32"], "slot")
