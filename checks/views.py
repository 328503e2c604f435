"""Support-message views over the supplied tables, in Spark.

The supplied texts are invented words without any support vocabulary, so the messages take
their wording from a short list of phrases, chosen by the ids of the rows. Every row of the
table becomes a message, so the views grow with the tables. ``oracles.py`` has the same views
in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators.intents import label_intents
from caseloom.session import small_table, spread_by_key

PHRASES = [
    "where is my package the tracking has not updated",
    "my order was delivered to the wrong address",
    "my kindle app keeps crashing and is slow",
    "the software update failed to install",
    "battery will not charge and the power drains",
    "i cannot login my account is locked",
    "i was charged twice for my subscription payment",
    "wifi and bluetooth connection keeps dropping",
    "no sound from the speaker and the volume is low",
    "the screen is black and the glass is cracked",
    "i need a warranty repair appointment at the store",
    "thank you that worked perfectly",
    "help",
    "@AmazonHelp why",
    "give me a refund for my order right now",
    "please delete my account and erase all my data",
    "i will sue and take legal action",
    "i paid for shipping but the refund never arrived",
    "my pet lizard ate my shoe",
    "see https://t.co/abc123 @115821",
    "@115821 sorry for the trouble please check your order status https://t.co/xyz we are happy to help",
    "i have issued your refund and you are all set",
    "your order will be cancelled guaranteed refund",
    "we are sorry please contact our support team so we can investigate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PHRASE_ARRAY = "array(" + ", ".join(f"'{p}'" for p in PHRASES) + ")"


def phrase(index: Column) -> Column:
    return F.element_at(F.expr(_PHRASE_ARRAY), (index + 1).cast("int"))


def raw_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``conversations`` with reply links, copied rows and blank texts."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") != "system").select(
        "conv_id", "turn", "role"
    )

    def neighbour(step: int, name: str) -> DataFrame:
        return turns.select("conv_id", (F.col("turn") - step).alias("turn"), F.lit(True).alias(name))

    linked = (
        turns.join(neighbour(-1, "has_prev"), ["conv_id", "turn"], "left")
        .join(neighbour(1, "has_next"), ["conv_id", "turn"], "left")
        .join(neighbour(2, "has_next2"), ["conv_id", "turn"], "left")
    )
    conv, turn = F.col("conv_id"), F.col("turn")

    def tweet_id(step: int) -> Column:
        return (conv * 100 + turn + step).cast("string")

    inbound = F.col("role") == "user"
    branches = F.col("has_prev").isNull() & F.col("has_next") & F.col("has_next2") & (conv % 5 == 0)
    wall_clock = F.to_timestamp_ntz(F.lit("2017-10-01 00:00:00")) + F.make_dt_interval(
        hours=conv.cast("int"), mins=turn.cast("int")
    )
    created = F.concat(
        F.date_format(wall_clock, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(wall_clock, "yyyy")
    )
    rows = linked.select(
        "conv_id",
        F.col("has_prev").isNull().alias("is_first"),
        tweet_id(0).alias("tweet_id"),
        F.when(inbound, F.concat(F.lit("cust_"), (conv % 37).cast("string")))
        .otherwise(F.concat(F.lit("Brand"), (conv % 4).cast("string")))
        .alias("author_id"),
        inbound.alias("inbound"),
        created.alias("created_at"),
        phrase(
            F.when(inbound, (conv * 7 + turn * 3) % 20).otherwise(20 + (conv + turn) % 4)
        ).alias("text"),
        F.when(branches, F.concat(tweet_id(1), F.lit(", "), tweet_id(2)))
        .when(F.col("has_next"), tweet_id(1))
        .alias("response_tweet_id"),
        F.when(F.col("has_prev"), tweet_id(-1)).alias("in_response_to_tweet_id"),
    )
    copies = rows.where(conv % 10 == 3)
    blanks = rows.where((conv % 10 == 4) & F.col("is_first")).withColumns(
        {
            "tweet_id": (conv * 100 + 99).cast("string"),
            "text": F.lit("   "),
            "response_tweet_id": F.lit(None).cast("string"),
            "in_response_to_tweet_id": F.lit(None).cast("string"),
        }
    )
    columns = [c.split(" ")[0] for c in schemas.TWEETS.split(", ")]
    return rows.unionByName(copies).unionByName(blanks).select(*columns)


def phrase_intents(spark: SparkSession) -> Column:
    """Array with the intent of each phrase, as a scalar subquery."""
    rows = small_table(spark, list(enumerate(PHRASES)), "i INT, phrase STRING")
    labelled = label_intents(rows, "phrase").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "intent"))), lambda x: x["intent"]
        ).alias("intents")
    )
    return labelled.scalar()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer message per event, with a noisy true intent, a model confidence and cases."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    events = spread_by_key(events, "event_id")  # however few files they come in
    n = F.col("event_id")
    text = phrase(n % 20)
    text = F.when(n % 11 == 0, F.upper(text)).otherwise(text)
    text = F.concat(F.when(n % 5 == 0, F.lit("@115821 ")).otherwise(F.lit("")), text)
    text = F.concat(text, F.when(n % 7 == 0, F.lit(" https://t.co/x")).otherwise(F.lit("")))
    shift = F.when(n % 13 == 0, F.lit(1)).otherwise(F.lit(0))
    similarity = ((n * 53) % 100) / 100.0

    def intent_of(index: Column) -> Column:
        return F.element_at(F.col("_intents"), (index + 1).cast("int"))

    def case(i: int) -> Column:
        return F.struct(
            F.lit(i).alias("rank"),
            F.floor(similarity * (1.1 - 0.1 * i) * 10000 + 0.5) / 10000,
            phrase((n + i) % 20),
            phrase(20 + (n + i) % 4),
            intent_of((n + i) % 20),
            F.concat(F.lit("conv_"), (n + i).cast("string")),
            F.lit("Brand: Brand1 | Turns: 2"),
            F.lit("Tue Oct 31 22:10:47 +0000 2017"),
        ).cast(schemas.CASE)

    return (
        events.withColumn("_intents", phrase_intents(spark))
        .select(
            n.alias("message_id"),
            F.col("user_id").alias("customer_id"),
            text.alias("message"),
            intent_of((n + shift) % 20).alias("true_intent"),
            (((n * 37) % 100) / 100.0).alias("confidence"),
            similarity.alias("top_similarity"),
            F.array(case(1), case(2), case(3)).alias("cases"),
            phrase(20 + n % 4).alias("true_reply"),
        )
    )


def predicted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the labeller's intent and an uncertainty flag, ready for the policy."""
    return (
        label_intents(messages(spark, sf_dir), "message")
        .drop("intent_confidence")
        .withColumn("is_uncertain", F.col("confidence") < 0.1)
    )
