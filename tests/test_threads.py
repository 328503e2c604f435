"""Thread rebuilding against a plain walk over many small random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import skew, threads


def expected_threads(rows):
    """Walk from each root in id order; a message belongs to the first root that reaches it."""
    by_id = {r[0]: r for r in rows}
    owner = {}
    walks = {}
    for tid in sorted(by_id, key=int):
        row = by_id[tid]
        if not row[2] or (row[6] and row[6] in by_id) or tid in owner:
            continue
        queue, walk = deque([tid]), []
        owner[tid] = tid
        while queue:
            current = queue.popleft()
            walk.append(current)
            for raw in (by_id[current][5] or "").split(","):
                child = raw.strip()
                if child in by_id and child not in owner:
                    owner[child] = tid
                    queue.append(child)
        walks[tid] = walk
    return walks


def random_rows(rng, base):
    n = rng.randint(2, 9)
    ids = [str(base + i) for i in range(n)]
    rows = []
    for i, tid in enumerate(ids):
        kind = rng.random()
        if kind < 0.35:
            kids = rng.sample(ids, rng.randint(0, min(3, n)))
        else:
            kids = [ids[i + 1]] if i + 1 < n else []
        if rng.random() < 0.1:
            kids.append(str(base + 900))
        if rng.random() < 0.1 and kids:
            kids.append(kids[0])
        parent = None
        if rng.random() < 0.6:
            parent = rng.choice(ids + [str(base + 901)])
        rows.append(
            (tid, f"a{i}", rng.random() < 0.6, "Tue Oct 31 22:10:47 +0000 2017", f"text {tid}",
             rng.choice([",", ", "]).join(kids) or None, parent)
        )
    return rows


def random_table(seed, graphs):
    rng = random.Random(seed)
    rows = [row for g in range(graphs) for row in random_rows(rng, (g + 1) * 1000)]
    # one long chain, to need several rounds of doubling
    base = 5_000_000
    rows += [
        (str(base + i), "c", i % 2 == 0, "Tue Oct 31 22:10:47 +0000 2017", "x",
         str(base + i + 1) if i < 70 else None, str(base + i - 1) if i else None)
        for i in range(71)
    ]
    rng.shuffle(rows)
    return rows


def found_threads(spark, rows):
    turns = threads.thread_turns(spark.createDataFrame(rows, schemas.TWEETS))
    placed = threads.turn_positions(turns).select("root_tweet_id", "position", "tweet_id").collect()
    walks = {}
    for r in sorted(placed, key=lambda r: (r["root_tweet_id"], r["position"])):
        walks.setdefault(r["root_tweet_id"], []).append(r["tweet_id"])
    positions = {}
    for r in placed:
        positions.setdefault(r["root_tweet_id"], []).append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in positions.values())
    return walks


@pytest.mark.parametrize("hot", [False, True])
def test_random_graphs(spark, monkeypatch, hot):
    if hot:  # treat nearly every key as hot
        monkeypatch.setattr(skew, "TARGET_ROWS", 1)
    rows = random_table(11 + hot, 600)
    assert found_threads(spark, rows) == expected_threads(rows)


def test_record_fields(spark):
    at = "Tue Oct 31 22:10:47 +0000 2017"
    rows = [
        ("1", "cust", True, at, "hello", "2, 3", None),
        ("2", "BrandA", False, at, "first reply", None, "1"),
        ("3", "cust", True, at, "Thank you", "4", "1"),
        ("4", "BrandB", False, at, "bye", None, "3"),
        ("5", "other", True, at, "thanks", None, None),  # no brand reply
        ("6", "BrandC", False, at, "hello?", "7", None),  # not a root
        ("7", "cust", True, at, "orphan of 8", None, "8"),  # its parent is missing: a root
    ]
    records, pages = threads.conversations(spark.createDataFrame(rows, schemas.TWEETS))
    found = {r["conversation_id"]: r for r in records.collect()}
    assert set(found) == {"conv_1"}
    conv = found["conv_1"]
    assert (conv["brand"], conv["customer_id"], conv["turns"]) == ("BrandA", "cust", 4)
    assert (conv["customer_message"], conv["brand_response"]) == ("hello", "first reply")
    assert conv["resolution_available"] is True
    history = pages.where("conversation_id = 'conv_1'").collect()
    assert [t["tweet_id"] for page in history for t in page["conversation_history"]] == ["1", "2", "3", "4"]


def test_history_pages_hold_every_turn(spark):
    at = "Tue Oct 31 22:10:47 +0000 2017"
    rows = [
        (str(i), "b" if i % 2 else "c", i % 2 == 0, at, "x", str(i + 1) if i < 24 else None,
         str(i - 1) if i else None)
        for i in range(25)
    ]
    turns = threads.thread_turns(spark.createDataFrame(rows, schemas.TWEETS))
    assert threads.conversations(spark.createDataFrame(rows, schemas.TWEETS), page_turns=10)[0].count() == 1
    pages = threads.history_pages(turns, page_turns=10).orderBy("page").collect()
    assert [len(p["conversation_history"]) for p in pages] == [10, 10, 5]
    assert [t["tweet_id"] for p in pages for t in p["conversation_history"]] == [str(i) for i in range(25)]


def test_last_row_of_a_repeated_id_wins(spark):
    rows = [
        ("1", "a", True, "Tue Oct 31 22:10:47 +0000 2017", "old", None, None),
        ("1", "a", True, "Wed Nov 01 22:10:47 +0000 2017", "new", None, None),
    ]
    nodes = threads.message_nodes(spark.createDataFrame(rows, schemas.TWEETS)).select("text").collect()
    assert [n["text"] for n in nodes] == ["new"]


def test_row_numbers_cross_partitions(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"))
    out = skew.number_rows(rows, [F.desc("id")], "k").toPandas()
    for _, part in out.groupby("k"):
        ordered = part.sort_values("id", ascending=False)
        assert list(ordered["position"]) == list(range(1, len(ordered) + 1))
