import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import constants as K
from caseloom.functions.text import (
    clean_text, count_matching, java_pattern, matches_any, parse_created_at, required_start, strip,
    strip_links_and_handles, whole_word, with_bigrams, word_tokens,
)
from caseloom.operators.intents import OTHER, label_intents


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, text STRING")


def ask(df, expr):
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_cleaner(spark):
    df = column(spark, [None, "a\u0000b", "  a \n\t b ", "smile \U0001f600", "a  b"])
    assert ask(df, clean_text(F.col("text"))) == ["", "ab", "a b", "smile \U0001f600", "a b"]


def test_timestamps(spark):
    df = column(spark, ["Tue Oct 31 22:10:47 +0000 2017", "garbage", None, "Tue Oct 31 22:10:47 +0200 2017"])
    assert ask(df, F.unix_seconds(parse_created_at(F.col("text")))) == [1509487847, None, None, 1509480647]


def test_word_edges_are_unicode(spark):
    df = column(spark, ["ésue", "issue", "i will sue.", "SUE them", "sueé", "pursue sue"])
    assert ask(df, matches_any("text", [r"\bsue\b"], ignore_case=True)) == [False, False, True, True, False, True]


def test_every_rule_agrees_with_python(spark):
    """Patterns of all lists against Python's own matching, on texts made of their pieces."""
    lists = [K.UNAVAILABLE_ACTION_PATTERNS, K.AMBIGUOUS_PATTERNS, K.UNSUPPORTED_CLAIM_PATTERNS,
             K.RESOLUTION_PATTERNS, *K.INTENT_PATTERNS.values(), *K.RULE_CLASSIFIER_PATTERNS.values()]
    rng = random.Random(5)
    pieces = [re.sub(r"\\[bsw]|[()?^$*+\\]", " ", part).strip() for group in lists for p in group for part in p.split("|")]
    texts = []
    for _ in range(400):
        words = rng.choices(pieces, k=rng.randint(1, 4)) + rng.choices(["x", "é", "s", "?", "help"], k=1)
        rng.shuffle(words)
        text = rng.choice([" ", "", ", "]).join(words)
        texts.append(text.upper() if rng.random() < 0.3 else text)
    texts += ["help", " why ", "@someone", "?", "wtf\n", "wi-fi", "within 24 hours you'll receive"]
    df = column(spark, texts)
    for group in lists:
        expected = [sum(bool(re.search(p, t, re.IGNORECASE)) for p in group) for t in texts]
        assert ask(df, count_matching("text", group, ignore_case=True)) == expected
        expected = [sum(bool(re.search(p, t)) for p in group) for t in texts]
        assert ask(df, count_matching("text", group)) == expected


def test_required_start():
    assert required_start(r"\bapp(s)?\b") == "app"
    assert required_start(r"\bpasswords?\b") == "password"
    assert required_start(r"^\s*help\s*$") == ""
    assert required_start(r"\bone|two\b") == ""


def test_tokens_and_bigrams(spark):
    df = column(spark, ["A bc DE f gh", "x", "", "café 2fa"])
    assert ask(df, word_tokens(F.col("text"))) == [["bc", "de", "gh"], [], [], ["café", "2fa"]]
    assert ask(df, with_bigrams(word_tokens(F.col("text")))) == [
        ["bc", "de", "gh", "bc de", "de gh"], [], [], ["café", "2fa", "café 2fa"],
    ]


def test_bigrams_look_for_the_words_once(spark):
    df = column(spark, ["A bc DE f gh", None]).select(with_bigrams(word_tokens(F.col("text"))).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [r["x"] for r in df.collect()] == [["bc", "de", "gh", "bc de", "de gh"], None]


def test_letters_that_matching_equates(spark):
    """The substring test before a pattern never rules out what the pattern matches."""
    texts = ["LEGAL ACT\u0130ON", "legal act\u0131on", "LEGAL ACTION", "di\u017fpute", "\u212aindle", "legalaction"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\blegal action\b", r"\bdispute\b", r"\bkindle\b"):
        plain = F.col("t").rlike(java_pattern(pattern, True))
        rows = df.select("t", plain.alias("plain"), matches_any("t", [pattern], True).alias("guarded")).collect()
        assert [r["plain"] for r in rows] == [r["guarded"] for r in rows], pattern


@pytest.mark.parametrize("ignore_case", [False, True])
def test_whole_words_match_as_the_plain_pattern_does(spark, ignore_case):
    patterns = [r"\blag(gy)?\b", r"\bairpods?\b", r"\bsign in\b", r"\bcharg(e|ing)\b", r"\bthank(s|\s+you)?\b"]
    around = ["", "a", "_", "5", "é", "𝒜", " ", "-", "@", "̇"]
    words = ["lag", "laggy", "LAG", "airpod", "airpodss", "sign in", "sign  in", "charging", "charge", "thank you", "lagging"]
    rows = [(f"{a}{w}{b}",) for a in around for w in words for b in around]
    df = spark.createDataFrame([*rows, ("lag lagg",), ("flag lag",), ("",), (None,)], "t STRING")
    for pattern in patterns:
        plain, fast = java_pattern(pattern, ignore_case), whole_word(pattern, ignore_case)
        assert (fast == plain) == (r"\s" in pattern)
        assert df.where(~F.rlike("t", F.lit(plain)).eqNullSafe(F.rlike("t", F.lit(fast)))).count() == 0


def test_strip_trims_every_kind_of_white_space(spark):
    blanks = [c for c in map(chr, range(0x3001)) if re.fullmatch(r"\s", c)]
    rows = [(f"{a}x{a} y{a}{b}", f"x{a} y") for a in blanks for b in ("", " ", "　")] + [("​x", "​x"), (None, None)]
    df = spark.createDataFrame(rows, "t STRING, want STRING")
    assert df.where(~strip(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_links_and_handles_go_with_and_without_each_other(spark):
    rows = [("see https://t.co/a @b now", "see   now"), ("http://x", ""), ("@a_1é!", "!"), ("http @", "http @"), (" a ", "a"), (None, None)]
    df = spark.createDataFrame(rows, "t STRING, want STRING")
    assert df.where(~strip_links_and_handles(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_labels_are_compiled_to_machine_code(spark, capsys):
    # HotSpot interprets methods of more than 8,000 bytes.
    df = spark.range(10).select(F.col("id").cast("string").alias("customer_message"))
    label_intents(df).explain("codegen")
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_labels_of_ties_and_nulls(spark):
    rows = [("my battery and the update", "SOFTWARE_UPDATE_ISSUES"), ("BATTERY power", "BATTERY_POWER_CHARGING"), ("", OTHER), (None, OTHER)]
    df = spark.createDataFrame(rows, "customer_message STRING, want STRING")
    found = label_intents(df).collect()
    assert all(r["intent"] == r["want"] for r in found)
    assert [r["intent_confidence"] for r in found][2:] == [0.0, 0.0]
