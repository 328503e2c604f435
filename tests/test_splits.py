import pytest
from pyspark.sql import functions as F

from caseloom.operators import splits


def test_sizes_are_exact_and_stable(spark):
    ids = spark.range(1003).select(F.concat(F.lit("c"), "id").alias("key"))
    first = splits.random_split(ids, "key")
    sizes = {r["split"]: r["rows"] for r in splits.split_sizes(first).collect()}
    assert sizes == {"train": 702, "val": 150, "test": 151}
    again = splits.random_split(ids.repartition(7), "key")
    assert first.exceptAll(again.select(first.columns)).count() == 0
    splits.assert_disjoint(first, "key")


def test_published_sizes(spark):
    ids = spark.range(81480).withColumnRenamed("id", "key")
    sizes = {r["split"]: r["rows"] for r in splits.split_sizes(splits.random_split(ids, "key")).collect()}
    assert sizes == {"train": 57036, "val": 12222, "test": 12222}


def test_bucket_split_never_moves_a_row(spark):
    small = splits.bucket_split(spark.range(500), "id")
    large = splits.bucket_split(spark.range(5000), "id")
    assert small.join(large, ["id", "split"]).count() == 500


def test_temporal_split_with_one_hot_time(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 5).otherwise(F.col("id") % 10).alias("t"))
    got = splits.temporal_split(rows, "id", F.col("t")).where("is_temporal_test").collect()
    ranked = sorted((r["t"], r["id"]) for r in rows.collect())
    assert sorted((r["t"], r["id"]) for r in got) == ranked[850:]


def test_leaks_are_found(spark):
    rows = [("a", "train", "x"), ("b", "test", "x"), ("c", "val", "y"), ("a", "val", "z")]
    df = spark.createDataFrame(rows, "key STRING, split STRING, message STRING")
    with pytest.raises(ValueError):
        splits.assert_disjoint(df, "key")
    found = {(r["left_split"], r["right_split"]): r["shared"] for r in splits.overlap_matrix(df, "message").collect()}
    assert found[("train", "test")] == 1 and found[("train", "val")] == 0 and found[("val", "val")] == 2
