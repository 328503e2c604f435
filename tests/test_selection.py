"""Places of an order beside Python's sorting."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import selection, splits


def at(df, columns, place):
    n = df.count()
    found = df.sparkSession.range(1).select(selection.row_at(df, columns, place, n).alias("r")).head()["r"]
    return tuple(found) if found else None


def null_first(row):
    return tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in row)


@pytest.mark.parametrize("small", [1, 50, 100_000])
def test_places_beside_sorting(spark, small, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", small)
    pick = random.Random(6)
    day = datetime.datetime(2020, 1, 1)
    rows = []
    for k in range(400):
        number = pick.choice([None, 7, pick.randint(-(2**63), 2**63 - 1), pick.randint(0, 50), -3])
        text = pick.choice([None, "", "é" * pick.randint(0, 3), f"id{pick.randint(0, 9)}", "same" * 20, "same" * 20 + chr(pick.randint(1, 0xD7FF))])
        rows.append((number, text, day + datetime.timedelta(microseconds=pick.choice([0, 1, 10**12]) * pick.randint(0, 9))))
    df = spark.createDataFrame(rows, "a bigint, b string, t timestamp").cache()
    for columns in (["a", "b"], ["b", "a", "t"], ["t", "b", "a"]):
        ordered = sorted(({n: v for n, v in zip("abt", r)} for r in rows), key=lambda r: null_first(r[c] for c in columns))
        for place in (1, 2, 133, 250, 400):
            assert at(df, columns, place) == tuple(ordered[place - 1][c] for c in columns)
    assert at(df, ["a"], 0) is None and at(df, ["a"], 401) is None and at(df.limit(0), ["a"], 1) is None


def test_types_without_ranges(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 3)
    df = spark.range(10).select((F.col("id") / 3).alias("x"), "id", F.col("id").cast("int").alias("i"))
    with pytest.raises(TypeError):
        at(df, ["x"], 4)
    assert at(df, ["i", "x"], 4)[0] == 3
    days = df.select(F.date_add(F.lit("2020-01-01"), "i").alias("d"), F.col("id").cast("timestamp_ltz").cast("timestamp_ntz").alias("n"))
    assert at(days, ["d"], 4)[0] == datetime.date(2020, 1, 4)
    assert at(days, ["n"], 4) == tuple(days.orderBy("n").collect()[3][1:])


@pytest.mark.parametrize("small", [5, 100_000])
def test_splits_without_sorting(spark, small, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", small)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 5).otherwise(F.col("id") % 10).alias("t"))
    timed = splits.temporal_split(rows, "id", F.col("t"))
    plan = timed._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    ranked = sorted((r["t"], r["id"]) for r in rows.collect())
    assert sorted((r["t"], r["id"]) for r in timed.where("is_temporal_test").collect()) == ranked[850:]
    split = splits.random_split(rows, "id")
    assert {r["split"]: r["rows"] for r in splits.split_sizes(split).collect()} == {"train": 700, "val": 150, "test": 150}
    hashed = [r["id"] for r in rows.orderBy(splits.shuffle_key("id")).collect()]
    assert {r["id"] for r in split.where("split = 'train'").collect()} == set(hashed[:700])
    assert splits.split_sizes(splits.random_split(rows.limit(0), "id")).count() == 0
