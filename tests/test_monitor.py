"""The stream monitor with repeated and late requests, and the head of CSV files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caseloom.sources.readers import read_tweets_head
from caseloom.streaming.monitor import escalation_windows, first_requests, start_monitor

START = datetime(2024, 5, 1)
SCHEMA = "request_id string, ts timestamp, escalate boolean, rule_id string"


def run(spark, tmp_path, parts):
    for k, part in enumerate(parts):
        rows = [(i, None if hours is None else START + timedelta(hours=hours), e, r) for i, hours, e, r in part]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        counts = escalation_windows(first_requests(stream, "request_id", "ts", "2 hours"), "ts", "1 hour")
        start_monitor(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.schema(counts.schema).parquet(str(tmp_path / "out"))
    return sorted((r["window_start"].hour, r["rule_id"], r["requests"], r["escalated"]) for r in out.collect())


def test_repeated_and_late_requests(spark, tmp_path):
    parts = [
        [("a", 0.1, True, "ACTION"), ("a", 0.1, True, "ACTION"), ("b", 0.5, False, None), ("c", 3.5, False, "NONE"), (None, 0.2, True, "ACTION")],
        # The watermark stands at 1.5: d is late, e is not, a comes again too late, c in time.
        [("d", 1.4, True, "ACTION"), ("e", 1.9, True, "ACTION"), ("a", 0.1, True, "ACTION"), ("c", 3.5, False, "NONE"), ("x", None, True, "ACTION")],
        [("f", 9.0, True, "ACTION")],
    ]
    # Hour 9 is still open at the end.
    assert run(spark, tmp_path, parts) == [(0, "ACTION", 1, 1), (0, "NONE", 1, 0), (1, "ACTION", 1, 1), (3, "NONE", 1, 0)]


def test_nothing_new_adds_nothing(spark, tmp_path):
    parts = [[("a", 0.1, True, "ACTION"), ("b", 5.0, True, "ACTION")], []]
    assert run(spark, tmp_path, parts) == [(0, "ACTION", 1, 1)]


def test_windows_of_a_table(spark):
    rows = [(str(k), START + timedelta(minutes=20 * k), k % 2 == 0, "ACTION" if k % 2 == 0 else None) for k in range(6)]
    got = escalation_windows(spark.createDataFrame(rows, SCHEMA), "ts", "1 hour", "30 minutes")
    assert got.where("rule_id = 'ACTION'").agg(F.sum("escalated")).first()[0] == 6
    assert got.where("escalated > requests").count() == 0


def test_csv_head_reads_no_more_files_than_needed(spark, tmp_path):
    header = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
    for k in range(4):
        rows = "".join(f'{k}{n},a,True,,"line\nbreak ""{n}""",,\n' for n in range(3))
        (tmp_path / f"part-{k}.csv").write_text(header + rows)
    (tmp_path / "part-1x.csv").write_text(header)
    got = read_tweets_head(spark, str(tmp_path), 5)
    assert [r["tweet_id"] for r in got.collect()] == ["00", "01", "02", "10", "11"]
    assert got.first()["text"] == 'line\nbreak "0"'
    # A file beyond the head is not opened.
    (tmp_path / "part-3.csv").chmod(0)
    assert read_tweets_head(spark, str(tmp_path), 7).count() == 7
    (tmp_path / "part-3.csv").chmod(0o644)
    assert read_tweets_head(spark, str(tmp_path), 100).count() == 12
    assert read_tweets_head(spark, str(tmp_path), 0).count() == 0
