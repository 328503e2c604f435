"""Reproducible splits and the audit of leakage between them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.constants import SPLIT_RATIOS, SPLIT_SEED
from caseloom.operators.selection import row_at
from caseloom.session import cut_and_count

SPLITS = ["train", "val", "test"]


def shuffle_key(key: str, seed: int = SPLIT_SEED) -> Column:
    """Stable pseudo-random text for an id: independent of partitioning and of engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def random_split(
    df: DataFrame, key: str, ratios: dict[str, float] = SPLIT_RATIOS, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split`` with exact sizes: rows in the order of a seeded hash, cut at the ratios.

    Hashes and ids are written once, and the last row of each split is found among them by
    narrowing ranges. The rows themselves are only compared with the two cuts; they are
    neither sorted nor shuffled.
    """
    place_of = F.struct(shuffle_key(key, seed).alias("h"), F.col(key).alias("k"))
    keyed, n = cut_and_count(df.select(place_of.alias("_o")).select("_o.h", "_o.k"))
    n_train, n_val = math.floor(n * ratios["train"]), math.floor(n * ratios["val"])
    cuts = F.struct(
        row_at(keyed, ["h", "k"], n_train, n).alias("train"), row_at(keyed, ["h", "k"], n_train + n_val, n).alias("val")
    )
    split = F.when(place_of <= F.col("_cuts.train"), F.lit("train")).when(
        place_of <= F.col("_cuts.val"), F.lit("val")
    )
    return df.withColumn("_cuts", cuts).withColumn("split", split.otherwise(F.lit("test"))).drop("_cuts")


def bucket_split(
    df: DataFrame, key: str, ratios: dict[str, float] = SPLIT_RATIOS, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split`` from the id's hash alone: sizes are near the ratios and no row ever moves
    when data is added. Needs no shuffle."""
    place = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("bigint") % 10_000 / 10_000.0
    split = F.when(place < ratios["train"], F.lit("train")).when(
        place < ratios["train"] + ratios["val"], F.lit("val")
    )
    return df.withColumn("split", split.otherwise(F.lit("test")))


def temporal_split(
    df: DataFrame, key: str, time: Column, test_ratio: float = SPLIT_RATIOS["test"]
) -> DataFrame:
    """Add ``is_temporal_test``: the latest part of all rows, unreadable times first.

    Ids and times are written once, and the last earlier row is found among them by narrowing
    ranges, of times and then of ids; the rows are then compared with it. Nothing is sorted,
    however many rows have one time.
    """
    moment = F.struct(time.alias("t"), F.col(key).alias("k"))
    keyed, n = cut_and_count(df.select(moment.alias("_m")).select("_m.t", "_m.k"))
    last = row_at(keyed, ["t", "k"], math.floor(n * (1.0 - test_ratio)), n)
    flagged = df.withColumn("_last", last)
    late = F.coalesce(moment > F.col("_last"), F.lit(True))
    return flagged.withColumn("is_temporal_test", late).drop("_last")


def split_sizes(split: DataFrame) -> DataFrame:
    """Rows and distinct ids per split."""
    return split.groupBy("split").agg(F.count("*").alias("rows"))


def _membership(split: DataFrame, value: str, extra: dict[str, Column]) -> DataFrame:
    members = {name: F.col("split") == name for name in SPLITS} | extra
    return (
        split.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(*[F.bool_or(cond).alias(name) for name, cond in members.items()])
    )


def overlap_matrix(split: DataFrame, value: str, temporal: bool = False) -> DataFrame:
    """Number of distinct values that two splits share, for each pair of splits.

    One aggregation marks the splits each value occurs in; copies of a value are combined
    before the shuffle and no pairs of rows are formed.
    """
    extra = {"temporal_test": F.col("is_temporal_test")} if temporal else {}
    names = SPLITS + list(extra)
    marks = _membership(split, value, extra)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    counted = marks.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left_split"),
                F.lit(b).alias("right_split"),
                F.col(f"{a}|{b}").alias("shared"),
            )
            for a, b in pairs
        ]
    )
    return counted.select(F.inline(rows)).withColumn("subject", F.lit(value))


def leakage_audit(split: DataFrame, values: list[str], temporal: bool = False) -> DataFrame:
    """Overlap of every pair of splits by each of the given columns."""
    parts = [overlap_matrix(split, value, temporal) for value in values]
    audit = parts[0]
    for part in parts[1:]:
        audit = audit.unionByName(part)
    return audit


def assert_disjoint(split: DataFrame, key: str) -> None:
    """Fail if an id occurs in more than one split."""
    shared = overlap_matrix(split, key).where(F.col("left_split") != F.col("right_split"))
    leaks = shared.where(F.col("shared") > 0).head()
    if leaks is not None:
        raise ValueError(f"leakage: {leaks['shared']} ids in {leaks['left_split']} and {leaks['right_split']}")


def index_audit(index: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """How many indexed ids lie in each split, and how many in none of them."""
    inside = index.select(key).join(split.select(key, "split"), key, "left")
    return inside.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(
        F.count("*").alias("indexed")
    )
