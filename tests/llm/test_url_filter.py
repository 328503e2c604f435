"""URL rules and the list behind the Bloom filter, beside plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.llm import url_filter
from caseloom.llm.queries import URL_RULES
from caseloom.llm.url_filter import bloom_filter, canonical, after_scheme, possible_hits, url_verdicts

SCHEMA = "page_id bigint, url string"


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    after = rest[len(host):]
    path = after.split("#")[0].split("?")[0]
    query = after.split("#")[0].partition("?")[2]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, query


def plain_canonical(url):
    host, path, query = split(url)
    if not host:
        return ""
    kept = sorted(p for p in query.split("&") if p and not p.startswith("utm_") and p.split("=")[0] not in ("ref", "gclid", "fbclid"))
    return host.removeprefix("www.") + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_verdict(url, listed):
    host, path, _ = split(url)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.name), len(r.host)))
        return host, path, best.name, best.verdict
    hit = plain_canonical(url) != "" and plain_canonical(url) in {plain_canonical(u) for u in listed}
    return host, path, None, "block" if hit else "allow"


URLS = [
    "http://example.net/en/1", "https://A.Example.NET/de/1", "http://notexample.net/en/1", "http://badnet/x", "http://net/x", "http://x.net",
    "http://x.net?a=/en/", "https://www.example.com/de/5?utm_source=x", "http://shop.example.com/en/9?b=2&a=1#top", "http://example.org/fr/1",
    "http://example.org/de/1", "org/fr/1", None, "", "://", "http://", "http:///path", "x://h.com/a://b.net/c", "http://h.com/a/?ref=1&&utm_x=2",
    "http://H.com/a", "HTTPS://www.h.com/a///", "http://h.com/A", "http://h.com/a?q=1", "http://h.com/a?ref", "http://h.com/b\nc", "http://hé.com/ü?ß",
    "http://h.com/" + "long/" * 5000, "http://h.com#/a?b", "http://u:p@h.com:80/a",
]


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_same_as_plain_version(frame, most, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
    listed = ["http://h.com/a/", "https://www.hé.com/ü?ß&gclid=3", "http://shop.example.com/en/9?a=1&b=2", "http://example.net/en/1", None, "nothing"]
    rows = [(k, u) for k, u in enumerate(URLS)] + [(1, URLS[1]), (None, URLS[-1])]
    got = url_verdicts(frame(rows, SCHEMA), frame([(0, u) for u in listed], SCHEMA), URL_RULES)
    expected = sorted(((k, *plain_verdict(u, listed)) for k, u in rows), key=repr)
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == expected


def test_canonical_urls(frame):
    df = frame(list(enumerate(URLS)), SCHEMA)
    got = dict((r[0], r[1]) for r in df.select("page_id", canonical(after_scheme(F.col("url")))).collect())
    assert got == {k: plain_canonical(u) for k, u in enumerate(URLS)}


def test_extra_columns_empty_tables_and_carried_ones(spark):
    names = ["host", "path", "rule", "verdict", "canonical", "listed", "_url", "_rest", "_block", "_w0", "_found", "_row", "_salt"]
    pages = spark.createDataFrame([(1, "http://h.com/a"), (2, "http://h.net/a")], SCHEMA).withColumns({c: F.lit(c) for c in names})
    got = url_verdicts(pages, pages.where("page_id = 1"), URL_RULES)
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == [(1, "block"), (2, "block")]
    assert url_verdicts(pages.limit(0), pages, URL_RULES).collect() == []
    free = url_verdicts(pages, pages.limit(0), URL_RULES, carry=["page_id", "url"])
    assert sorted((r["page_id"], r["verdict"], r["listed"]) for r in free.collect()) == [(1, "allow", False), (2, "block", None)]
    assert url_verdicts(pages, pages, []).where("verdict = 'block'").count() == 2


def test_filter_lets_every_listed_url_through_and_few_others(spark):
    pick = random.Random(3)
    urls = [f"h{pick.randrange(10**9)}.com/p" for _ in range(3000)]
    df = spark.createDataFrame([(u,) for u in urls], "_url string").distinct()
    blocks, n_blocks = bloom_filter(df, df.count())
    assert n_blocks == 128
    assert possible_hits(df, blocks, n_blocks).where("not _maybe").count() == 0
    others = spark.range(50_000).select(F.concat(F.lit("other"), "id").alias("_url"))
    assert possible_hits(others, blocks, n_blocks).where("_maybe").count() < 500


def test_no_python_workers(frame):
    plan = url_verdicts(frame([(1, "http://h.com/a")], SCHEMA), frame([(1, "http://h.com/a")], SCHEMA), URL_RULES)
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_hot_url(frame):
    rows = [(k, "http://h.com/same") for k in range(3000)] + [(k, f"http://h.com/{k}") for k in range(3000, 3500)]
    got = url_verdicts(frame(rows, SCHEMA), frame([(0, "https://www.h.com/same/")], SCHEMA), URL_RULES)
    assert got.where("verdict = 'block'").count() == 3000 and got.count() == 3500
