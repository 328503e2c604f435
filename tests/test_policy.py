import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.constants import OTHER
from caseloom.operators.drafting import draft_from_template
from caseloom.operators.policy import decide, escalate, shape_response, split_requests, trust_checks

ORDER = "ORDER_SHIPPING_DELIVERY"


def case(similarity, intent, reply="@123 we will look at the parcel https://t.co/x", rank=1):
    return (rank, similarity, "where is it", reply, intent, f"conv_{rank}", "Brand: b | Turns: 2", "t")


GOOD = [case(0.9, ORDER), case(0.8, ORDER, rank=2), case(0.7, "X", rank=3)]


def rows(spark, items):
    schema = (
        f"id INT, message STRING, intent STRING, confidence DOUBLE, is_uncertain BOOLEAN, cases ARRAY<{schemas.CASE}>"
    )
    return spark.createDataFrame([(i, *item) for i, item in enumerate(items)], schema)


CASES = [
    ("Please delete my account and erase all my data immediately.", ORDER, 0.9, False, GOOD, "ACTION"),
    ("Give me a refund for my order right now, the item never arrived!", ORDER, 0.9, False, GOOD, "ACTION"),
    ("If this is not fixed I will sue and take legal action against your company.", ORDER, 0.9, False, GOOD, "ACTION"),
    ("help", ORDER, 0.9, False, GOOD, "TOO_SHORT"),
    ("@AmazonHelp why", ORDER, 0.9, False, GOOD, "TOO_SHORT"),
    ("see https://t.co/abc123 @115821", ORDER, 0.9, False, GOOD, "TOO_SHORT"),
    ("My pet lizard ate my shoe", OTHER, 0.9, False, GOOD, "TAXONOMY"),
    ("where is my package", ORDER, 0.9, True, GOOD, "TAXONOMY"),
    ("where is my package", ORDER, 0.44, False, GOOD, "CONFIDENCE"),
    ("where is my package", ORDER, 0.45, False, [case(0.40, ORDER)], "NONE"),
    ("where is my package", ORDER, 0.9, False, [], "NO_CASES"),
    ("where is my package", ORDER, 0.9, False, [case(0.39, ORDER)], "SIMILARITY"),
    ("where is my package", ORDER, 0.9, False, [case(0.9, "X", rank=i) for i in (1, 2, 3)], "CONFLICT"),
    ("where is my package", ORDER, 0.9, False, [case(0.9, "X", rank=i) for i in (1, 2)], "NONE"),
    ("where is my package", ORDER, 0.9, False, GOOD, "NONE"),
]


def test_first_rule_wins(spark):
    got = escalate(rows(spark, [c[:5] for c in CASES])).orderBy("id").collect()
    assert [r["rule_id"] for r in got] == [c[5] for c in CASES]
    assert got[8]["escalation_reason"] == "Intent confidence below validated threshold (0.4400 < 0.45)."
    assert got[11]["escalation_reason"] == (
        "No sufficiently similar historical resolution (Similarity 0.3900 < 0.40)."
    )
    assert got[14]["escalation_reason"] == "" and got[14]["escalate"] is False


def test_stages_and_drafts(spark):
    done = decide(draft_from_template(escalate(rows(spark, [c[:5] for c in CASES]))))
    for r in done.collect():
        if r["escalate"]:
            assert (r["draft_reply"], r["evidence"]) == ("", [])
            assert (r["decision"], r["pipeline_stage"]) == ("ESCALATE", "ESCALATED_PRE_GENERATION")
        else:
            assert r["draft_reply"] == "we will look at the parcel"
            assert (r["decision"], r["pipeline_stage"]) == ("AUTO-HANDLE", "AUTO_HANDLED")


def test_reply_can_ask_for_a_human(spark):
    drafted = draft_from_template(escalate(rows(spark, [CASES[-1][:5]]))).withColumn("reply_escalates", F.lit(True))
    row = decide(drafted).head()
    assert (row["pipeline_stage"], row["escalate"]) == ("ESCALATED_POST_GENERATION", True)
    assert row["escalation_reason"] == "LLM determined escalation required."


def test_six_checks_always(spark):
    for r in trust_checks(rows(spark, [c[:5] for c in CASES])).collect():
        assert len(r["trust_checks"]) == 6
    failed = trust_checks(rows(spark, [("delete my account please", ORDER, 0.9, False, GOOD)])).head()["trust_checks"]
    assert [c["passed"] for c in failed] == [True, True, True, False, True, True]


@pytest.mark.parametrize("message,handle,reply,expected", [
    ("@115821 where is it", "@115821", "@99 we are looking into it", "@115821 we are looking into it"),
    ("where is it", "", "@99 @other we are looking into it", "we are looking into it"),
    ("@me hi", "@me", "short", "@me I'm sorry for any trouble! We'd like to look into this for you. Please connect with our support team so we can assist. ^CS"),
    ("hi", "", "", "I'm sorry for any trouble! We'd like to look into this for you. Please connect with our support team so we can assist. ^CS"),
])
def test_template(spark, message, handle, reply, expected):
    df = rows(spark, [(message, ORDER, 0.9, False, [case(0.9, ORDER, reply)])])
    assert draft_from_template(df).head()["draft_reply"] == expected


def test_response_and_requests(spark):
    done = decide(draft_from_template(trust_checks(escalate(rows(spark, [CASES[-1][:5], CASES[0][:5]])))))
    auto, stopped = shape_response(done, "id").orderBy("id").collect()
    assert auto["escalation_reason"] is None and len(auto["retrieved_cases"]) == 3
    assert stopped["escalation_reason"] and stopped["decision"] == "ESCALATE"
    asked = spark.createDataFrame([("",), ("   ",), (" hi ",), (None,)], "message STRING")
    valid, rejected = split_requests(asked)
    assert [r["message"] for r in valid.collect()] == ["hi"] and rejected.count() == 3
