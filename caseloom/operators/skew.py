"""Building blocks that stay parallel when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import cut_lineage

# A key with more rows than this is hot: it is spread so that a task gets about so many of them.
TARGET_ROWS = 100_000
# There are fewer hot keys than this, which bounds the table that is broadcast; the target rises
# for it from 100 billion rows on.
HOT_KEYS = 1_000_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``_hot, _salts``: the hot keys and the number of tasks that each is spread over."""
    keys = df.select(F.col(key).alias("_hot")).where(F.col("_hot").isNotNull())
    counts = keys.groupBy("_hot").agg(F.count("*").alias("_n"))
    target = counts.select(F.greatest(F.sum("_n") / F.lit(HOT_KEYS), F.lit(float(TARGET_ROWS))).alias("t"))
    salts = F.ceil(F.col("_n") / target.scalar()).cast("int")
    return counts.select("_hot", salts.alias("_salts")).where(F.col("_salts") > 1)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    rows: int | None = None,
) -> DataFrame:
    """Join many ``left`` rows per key with few ``right`` rows per key.

    Left rows of a hot key are spread over tasks, as many as their number asks for, by the hash of
    ``spread_by``, and only the right rows of hot keys are copied, so no task gets a whole hot
    group. The hash, unlike a random salt, is the same when a lost task runs again. ``rows`` is
    the number of left rows, if the caller knows it: no key can be hot among ``TARGET_ROWS`` rows,
    so none is looked for.
    """
    if rows is not None and rows <= TARGET_ROWS:
        return left.join(right, key, how)
    hot = F.broadcast(hot_keys(left, key))
    salts = F.coalesce("_salts", F.lit(1))
    spread = (
        left.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
        .drop("_hot", "_salts")
    )
    copied = (
        right.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_hot", "_salts")
    )
    return spread.join(copied, [key, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """Add the exact 1-based ``position`` of each row, overall or within ``group``.

    ``order`` must end in a unique key. One range-partitioned sort splits even a hot group
    over many tasks; the positions follow from per-partition offsets, so no window ever runs
    over all rows or over a whole group.
    """
    keys = [F.col(group)] if group else []
    placed = cut_lineage(
        df.orderBy(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    cells = ["_part"] + ([group] if group else [])
    runs = placed.groupBy(*cells).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *cells, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    if group:
        # Only groups that cross a partition edge need an offset; the rest start at their
        # own first row. Each partition edge crosses at most one group.
        starts = Window.partitionBy("_part", group)
        crossing = runs.where(F.col("_before") > 0).select(
            "_part", group, F.col("_before").alias("_offset")
        )
        numbered = placed.withColumn("_start", F.min("_seq").over(starts)).join(
            F.broadcast(crossing), ["_part", group], "left"
        )
        position = F.col("_seq") - F.col("_start") + F.coalesce("_offset", F.lit(0)) + 1
    else:
        numbered = placed.join(F.broadcast(runs), "_part", "left")
        position = F.col("_seq") - F.col("_first") + F.col("_before") + 1
    return numbered.withColumn("position", position).drop(
        "_part", "_seq", "_start", "_offset", "_first", "_before"
    )
