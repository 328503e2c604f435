"""URL filters: host and path rules, then a list of URLs behind a blocked Bloom filter.

Listed URLs are brought to a canonical form. A Bloom filter of bounded size holds them: a URL's
hash names one block of eight 64-bit words and one bit in each word. The blocks are sent to all
tasks, and only URLs with all eight bits set, the possible hits, are shuffled for the exact join
that removes false positives. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import materialise
from caseloom.operators.skew import lookup_join

WORDS = 8
# Bits of the filter a listed URL.
BITS_PER_URL = 16
# The filter has at most so many blocks of 64 bytes, which bounds what is broadcast. A longer list
# lets more false positives through to the exact join.
MAX_BLOCKS = 1 << 18
# Query parameters that do not change a page; names that start with the prefix are left out too.
TRACKING_PREFIX = "utm_"
TRACKING = ("ref", "gclid", "fbclid")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Pages of ``host`` and its subdomains whose path starts with ``path`` are let in or blocked."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(rest: Column) -> Column:
    """The canonical URL of what follows the scheme; empty without a host.

    Scheme, a leading ``www.``, slashes at the end of the path, the fragment, empty and tracking
    parameters go; the other parameters are sorted. The path keeps its case.
    """
    params = F.filter(
        F.split(F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1), "&"),
        lambda p: (p != "") & ~F.startswith(p, F.lit(TRACKING_PREFIX)) & ~F.substring_index(p, "=", 1).isin(*TRACKING),
    )
    query = F.array_join(F.array_sort(params), "&")
    host = F.regexp_replace(host_of(rest), "^www[.]", "")
    path = F.regexp_replace(path_of(rest), "/+$", "")
    return F.when(host == "", "").otherwise(
        F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    )


def fitting(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, of equally long ones that with the longer host; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(own & F.startswith(path, F.lit(rule.path)), F.lit(value(rule))).otherwise(found)
    return found


def masks(url: Column) -> list[Column]:
    """The bit of ``url`` in each word of its block."""
    bits = F.xxhash64(F.lit("bits"), url)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(bits, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom_filter(urls: DataFrame, n_urls: int) -> tuple[DataFrame, int]:
    """``_block, _w0, ...``: the blocks in use for distinct ``urls`` (_url), and the number of all blocks."""
    wanted = max(1, -(-n_urls * BITS_PER_URL // (64 * WORDS)))
    n_blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    set_bits = urls.select(
        F.pmod(F.xxhash64("_url"), F.lit(n_blocks)).cast("int").alias("_block"),
        *[mask.alias(f"_m{k}") for k, mask in enumerate(masks(F.col("_url")))],
    )
    return set_bits.groupBy("_block").agg(*[F.bit_or(f"_m{k}").alias(f"_w{k}") for k in range(WORDS)]), n_blocks


def possible_hits(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Add ``_maybe``: false only for rows whose ``_url`` is certainly not in the filter."""
    own = rows.withColumn("_block", F.pmod(F.xxhash64("_url"), F.lit(n_blocks)).cast("int"))
    every = F.lit(True)
    for k, mask in enumerate(masks(F.col("_url"))):
        every = every & (F.col(f"_w{k}").bitwiseAND(mask) != 0)
    return (
        # At most MAX_BLOCKS rows.
        own.join(F.broadcast(blocks), "_block", "left")
        .withColumn("_maybe", F.coalesce(every, F.lit(False)))
        .drop("_block", *[f"_w{k}" for k in range(WORDS)])
    )


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[Rule], carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default ``page_id``), ``host, path, canonical, rule, listed, verdict`` per row of ``pages``.

    The longest rule that fits a page's ``url`` decides. Without one, a page is blocked if its
    canonical URL is that of a row of ``listed`` (url), else allowed. ``listed`` is null where a rule
    has decided, so that the list was not asked.

    A null URL or one without ``://`` has an empty host and path, fits no rule, is on no list and is
    allowed; so are such rows of ``listed`` left out. Repeated rows and URLs, also a URL that most
    pages share, each keep their row. URLs of any length are read whole. Empty tables give empty
    results; an empty list lists nothing. Other columns are ignored, whatever their names.
    """
    carry = carry or ["page_id"]
    urls = listed.select(canonical(after_scheme(F.col("url"))).alias("_url")).where("_url <> ''").distinct()
    urls = materialise(urls, "listed-urls")
    blocks, n_blocks = bloom_filter(urls, urls.count())

    rest = F.col("_rest")
    rows = pages.select(F.struct(*carry).alias("_row"), after_scheme(F.col("url")).alias("_rest")).select(
        "_row", host_of(rest).alias("host"), path_of(rest).alias("path"), canonical(rest).alias("_url")
    )
    host, path = F.col("host"), F.col("path")
    ruled = rows.withColumns({
        "rule": fitting(rules, host, path, lambda r: r.name), "_ruled": fitting(rules, host, path, lambda r: r.verdict),
    })
    asked = possible_hits(ruled, blocks, n_blocks)
    known = "rule is not null or not _maybe"
    plain = asked.where(known).withColumn("listed", F.when(F.col("rule").isNull(), False))
    hits = lookup_join(
        asked.where(f"not ({known})").withColumn("_spread", F.xxhash64("_row", "path")),
        urls.withColumn("_found", F.lit(True)), "_url", "_spread",
    )
    hits = hits.withColumn("listed", F.coalesce("_found", F.lit(False)))
    columns = [
        "_row.*", "host", "path", F.col("_url").alias("canonical"), "rule", "listed",
        F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    ]
    return plain.select(*columns).union(hits.select(*columns))
