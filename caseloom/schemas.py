"""Schemas of the tables that cross a boundary: files, streams and decisions."""

from __future__ import annotations

TWEETS = (
    "tweet_id STRING, author_id STRING, inbound BOOLEAN, created_at STRING, text STRING, "
    "response_tweet_id STRING, in_response_to_tweet_id STRING"
)
TURN = "STRUCT<tweet_id: STRING, author_id: STRING, inbound: BOOLEAN, created_at: STRING, text: STRING>"
CONVERSATIONS = (
    "conversation_id STRING, root_tweet_id STRING, brand STRING, customer_id STRING, "
    "timestamp STRING, customer_message STRING, brand_response STRING, "
    f"conversation_history ARRAY<{TURN}>, turns BIGINT, resolution_available BOOLEAN"
)
LABELLED = CONVERSATIONS + ", intent STRING, intent_confidence DOUBLE"
TAXONOMY = (
    "name STRING, description STRING, inclusion_criteria STRING, exclusion_criteria STRING, "
    "sample_count BIGINT, representative_examples ARRAY<STRING>"
)
CASE_INDEX = (
    "conversation_id STRING, customer_message STRING, brand_response STRING, intent STRING, "
    "turns BIGINT, context STRING, timestamp STRING, embedding ARRAY<FLOAT>"
)
CASE = (
    "STRUCT<rank: INT, similarity_score: DOUBLE, historical_customer_message: STRING, "
    "historical_brand_response: STRING, intent: STRING, conversation_id: STRING, "
    "context: STRING, timestamp: STRING>"
)
REQUEST = (
    "message STRING, "
    "conversation_history ARRAY<STRUCT<author_id: STRING, text: STRING, inbound: BOOLEAN>>"
)
