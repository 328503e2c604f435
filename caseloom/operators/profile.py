"""Profile of a raw message table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.numbers import half_up
from caseloom.functions.text import parse_created_at


def table_shape(raw: DataFrame) -> DataFrame:
    """One row per column: its position, name, type and the number of rows."""
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
            for i, (n, t) in enumerate(raw.dtypes, start=1)
        ]
    )
    counted = raw.agg(F.count("*").alias("rows"))
    return counted.select("rows", F.inline(fields))


def missing_values(raw: DataFrame) -> DataFrame:
    """Number and percentage of nulls of every column, from one pass over the table."""
    counts = raw.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in raw.columns]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in raw.columns]
    )
    return counts.select("_rows", F.inline(pairs)).select(
        "column", "missing", half_up(F.col("missing") * 100.0 / F.col("_rows"), 2).alias("missing_pct")
    )


def duplicates(raw: DataFrame) -> DataFrame:
    """One row: exact duplicate rows and repeated ids, the first of each group not counted."""
    rows = raw.groupBy(*raw.columns).agg(F.count("*").alias("n"))
    ids = raw.groupBy("tweet_id").agg(F.count("*").alias("n"))
    return rows.select(F.sum(F.col("n") - 1).alias("exact_duplicates")).join(
        ids.select(F.sum(F.col("n") - 1).alias("duplicate_tweet_ids"))
    )


def directions(raw: DataFrame) -> DataFrame:
    """One row: inbound and outbound counts with their shares in percent."""
    return raw.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("inbound")).alias("customer_tweets"),
        F.count_if(~F.col("inbound")).alias("brand_tweets"),
    ).select(
        "*",
        half_up(F.col("customer_tweets") * 100.0 / F.col("rows"), 2).alias("customer_pct"),
        half_up(F.col("brand_tweets") * 100.0 / F.col("rows"), 2).alias("brand_pct"),
    )


def top_brand_authors(raw: DataFrame, n: int = 20) -> DataFrame:
    """The authors with the most outbound messages; the name breaks ties."""
    counts = raw.where(~F.col("inbound")).groupBy("author_id").agg(F.count("*").alias("tweets"))
    return counts.orderBy(F.desc("tweets"), "author_id").limit(n)


def authors(raw: DataFrame, compat: bool = False, approximate: bool = False) -> DataFrame:
    """One row: distinct authors and distinct brands.

    ``compat`` counts distinct message volumes of brands instead of brands, which is what the
    published profile did. ``approximate`` uses sketches for very wide tables.
    """
    if approximate and not compat:
        return raw.agg(
            F.approx_count_distinct("author_id").alias("unique_authors"),
            F.approx_count_distinct(F.when(~F.col("inbound"), F.col("author_id"))).alias(
                "unique_brands"
            ),
        )
    per_author = raw.groupBy("author_id").agg(F.count_if(~F.col("inbound")).alias("sent"))
    sent = F.when((F.col("sent") > 0) & F.col("author_id").isNotNull(), F.col("sent"))
    brands = F.count_distinct(sent) if compat else F.count(sent)
    return per_author.agg(F.count("author_id").alias("unique_authors"), brands.alias("unique_brands"))


def text_lengths(raw: DataFrame, short: int = 10, long: int = 280) -> DataFrame:
    """One row of length statistics. The exact median comes from the histogram of lengths."""
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    hist = raw.groupBy(length.alias("length")).agg(F.count("*").alias("n"))
    return hist.agg(
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        half_up(F.sum(F.col("length") * F.col("n")) / F.sum("n"), 2).alias("mean_length"),
        F.percentile("length", F.lit(0.5), F.col("n")).alias("median_length"),
        F.coalesce(F.sum(F.when(F.col("length") < short, F.col("n"))), F.lit(0)).alias("short_texts"),
        F.coalesce(F.sum(F.when(F.col("length") > long, F.col("n"))), F.lit(0)).alias("long_texts"),
    )


def date_range(raw: DataFrame) -> DataFrame:
    """One row: first and last readable time as epoch seconds, and the unreadable ones."""
    seconds = F.unix_seconds(parse_created_at(F.col("created_at")))
    return raw.agg(
        F.min(seconds).alias("first_epoch"),
        F.max(seconds).alias("last_epoch"),
        F.count_if(seconds.isNull()).alias("unreadable"),
    )


def link_counts(raw: DataFrame) -> DataFrame:
    """One row: how many messages point to a parent and how many list replies."""
    return raw.agg(
        F.count("in_response_to_tweet_id").alias("with_parent"),
        F.count("response_tweet_id").alias("with_replies"),
    )
