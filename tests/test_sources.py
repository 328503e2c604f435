import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import rubric, sweeps
from caseloom.plans.decide import DecisionPlan, build_case_index
from caseloom.operators.classifiers import predict_by_rules
from caseloom.sources import readers, writers
from caseloom.streaming.decisions import decide_requests, start_decision_stream

AT = "Tue Oct 31 22:10:47 +0000 2017"


def training(spark):
    texts = ["where is my package", "tracking number not updated", "my app keeps crashing", "the app is slow",
             "battery will not charge", "battery drains fast", "where is my order package", "app crashing again"]
    rows = [
        (f"conv_{i}", str(i), "b", "c", AT, t, f"@1 we are sorry about case {i}, we will look into it", None, 2, False,
         "ORDER_SHIPPING_DELIVERY" if "package" in t or "tracking" in t else "APP_CRASH_PERFORMANCE", 0.6)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schemas.LABELLED)


@pytest.fixture(scope="module")
def plan(spark):
    index = build_case_index(training(spark), components=5)
    return DecisionPlan(lambda df: predict_by_rules(df, "message"), index)


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        f'1,a,True,{AT},"two\nlines, ""quoted""",2,\n2,b,False,{AT},null,,1\n'
    )
    one, two = readers.read_tweets_csv(spark, str(tmp_path / "t.csv")).orderBy("tweet_id").collect()
    assert one["text"] == 'two\nlines, "quoted"' and one["in_response_to_tweet_id"] is None
    assert two["text"] == "null" and two["inbound"] is False
    strict = readers.read_tweets_csv(spark, str(tmp_path / "t.csv"), ("", "null")).where("tweet_id = '2'").head()
    assert strict["text"] is None
    ordered = readers.with_file_order(readers.read_tweets_csv(spark, str(tmp_path / "t.csv")))
    assert [r["tweet_id"] for r in readers.head_rows(ordered, 1).collect()] == ["1"]


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"conversation_id": "a", "customer_message": "hi", "intent": "X", "brand_response": " "}), "",
             json.dumps({"conversation_id": "b", "customer_message": "yo"})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    df = readers.read_labelled_json(spark, str(tmp_path / "c.jsonl"))
    assert df.count() == 2 and df.where(readers.has_text("customer_message", "brand_response")).count() == 0
    with pytest.raises(Exception, match="missing message or intent"):
        readers.read_labelled_json(spark, str(tmp_path / "c.jsonl"), strict=True).select("conversation_id").collect()


def test_damaged_json_lines(spark, tmp_path):
    lines = [json.dumps({"customer_message": "no id", "intent": "X"}), '{"customer_message": "cut o',
             json.dumps({"conversation_id": "b", "customer_message": "\n\t", "intent": "X", "brand_response": "x"})]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    df = readers.read_labelled_json(spark, str(tmp_path / "d.jsonl"))
    got = {(r["customer_message"], r[readers.CORRUPT]) for r in df.collect()}
    assert got == {("no id", None), (None, lines[1]), ("\n\t", None)}
    assert df.where(readers.has_text("customer_message")).count() == 1
    with pytest.raises(Exception, match="corrupt line"):
        readers.read_labelled_json(spark, str(tmp_path / "d.jsonl"), strict=True).select("intent").collect()


def test_index_survives_storage(spark, plan, tmp_path):
    path = str(tmp_path / "index")
    writers.write_index(plan.index, path, "training", spark)
    again = DecisionPlan(plan.classify, writers.read_index(spark, path))
    asked = spark.createDataFrame([(1, "where is my package"), (2, "zzz qqq")], "id INT, message STRING")
    for p in (plan, again):
        one, two = p.run(asked, "id").orderBy("id").collect()
        assert one["cases"][0]["conversation_id"] == "conv_0" and one["cases"][0]["similarity_score"] > 0.99
        assert [c["rank"] for c in one["cases"]] == [1, 2, 3, 4, 5]
        assert one["decision"] == "AUTO-HANDLE" and one["draft_reply"].startswith("we are sorry")
        assert two["n_known_terms"] == 0 and two["decision"] == "ESCALATE"
    config = spark.read.json(f"{path}/config").head()
    assert (config["total_examples"], config["source_path"]) == (8, "training")
    with pytest.raises(Exception):
        writers.read_index(spark, str(tmp_path / "nothing"))


def test_artifacts(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    found = {"good": ("parquet", str(tmp_path / "good"))}
    assert writers.require_artifacts(spark, found).head()["rows"] == 3
    with pytest.raises(RuntimeError, match="bad"):
        writers.require_artifacts(spark, found | {"bad": ("parquet", str(tmp_path / "bad"))})


def test_stream(spark, plan, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, messages in enumerate([["delete my account please", "  ", "where is my package"], ["", "help", "help"]]):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"message": m}) for m in messages))
    stream = readers.read_requests(spark, str(source), stream=True, files_per_trigger=1)
    query = start_decision_stream(
        stream, decide_requests(plan), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state")
    )
    query.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["message"], r["decision"], r["draft_reply"] != "") for r in done.collect())
    assert got == [
        ("delete my account please", "ESCALATE", False), ("help", "ESCALATE", False), ("help", "ESCALATE", False),
        ("where is my package", "AUTO-HANDLE", True),
    ]
    assert done.select("request_id").distinct().count() == 4
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_sweep_equals_direct_count(spark):
    rows = [(i, "OTHER / UNKNOWN" if i % 7 == 0 else "A", (i * 37 % 101) / 100, (i * 53 % 97) / 100) for i in range(500)]
    df = spark.createDataFrame(rows, "id INT, intent STRING, confidence DOUBLE, top_similarity DOUBLE")
    cells = {(r["conf_threshold"], r["sim_threshold"]): r for r in sweeps.sweep_validation(df).collect()}
    assert len(cells) == 81
    for c, s in [(0, 0), (3, 4), (6, 6), (8, 8)]:
        conf, sim = sweeps.VALIDATION_GRID[0][c], sweeps.VALIDATION_GRID[1][s]
        human = [r[1] != "A" or r[2] < 0.3 for r in rows]
        auto = [not h and r[2] >= conf and r[3] >= sim for r, h in zip(rows, human)]
        cell = cells[(round(conf, 2), round(sim, 2))]
        assert cell["n_false_auto"] == 0
        assert cell["n_false_escalation"] == sum(not a and not h for a, h in zip(auto, human))


def test_rubric_edges(spark):
    rows = [
        (1, "hi there", "X", "", [], "thanks a lot"),
        (2, "where is my order", "ORDER_SHIPPING_DELIVERY", "your order will be cancelled", ["your order will be cancelled"], ""),
        (3, "?", "X", "I can give you a full refund", ["  "], "?"),
        (4, "?", "X", "!", ["!"], "?"),
    ]
    df = spark.createDataFrame(
        rows, "id INT, message STRING, intent STRING, draft_reply STRING, evidence ARRAY<STRING>, true_reply STRING"
    )
    empty, order, refund, no_words = rubric.score_replies(df).orderBy("id").collect()
    assert [empty[s] for s in rubric.SCORES] == [1, 1, 1, 1, 1, 1.0]
    assert (order["groundedness"], order["correctness"]) == (5, 3)
    assert order["unsupported_claims"] == ["your order will be cancelled"]
    assert refund["groundedness"] == 1 and refund["unsupported_claims"] == ["I can give you a full refund"]
    assert no_words["correctness"] == 3 and no_words["groundedness"] == 1


def test_a_draft_is_counted_once_for_its_three_similarities(spark, monkeypatch):
    counted, count = [], rubric._term_counts
    monkeypatch.setattr(rubric, "_term_counts", lambda text: counted.append(text) or count(text))
    texts = [pd.Series([a, b]) for a, b in (("red sea boat", ""), ("red sea", "red sea"), ("the sea", "..."))]
    found = rubric._similarities.func(texts[0], pd.Series([["red boat", "sea"], []]), *texts[1:])
    assert counted.count("red sea boat") == 1
    alone = [rubric._first_to_others(["red sea boat", *x]) for x in (["red boat", "sea"], ["red sea"], ["the sea"])]
    assert found.iloc[0].tolist() == pytest.approx(alone)
    assert found.iloc[1].isna().tolist() == [True, False, True] and found.iloc[1]["to_message"] == 0.0
