"""How far the sources of a language differ, from run-length encoded columns of term counts.

Each source of a language is a column of counts over the language's vocabulary. The vocabulary is
cut into segments of terms with about equally many occurrences, and within a segment reordered so
that equal counts lie together; each column is then a few runs. Two columns are compared run by
run: their run boundaries are intersected, and the contribution of a pair of counts is multiplied
by the number of terms that have it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import if_small, materialise, slices

# A term is kept if so many documents of its language have it.
MIN_DOCS = 10
# Shares are whole numbers of this size.
SCALE = 1_000_000_000
# SCALE as a product: a count times either factor fits 64 bits up to 280 trillion occurrences.
HIGH, LOW = 32_000, 31_250
# A segment has about so many (term, source) cells at most.
CELLS = 1 << 20
# Columns are compared in pairs of blocks of so many sources.
SOURCE_BLOCK = 64
# A task remembers so many counts before it passes them on.
REMEMBERED = 200_000
PIECE = 1_000_000

LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece: runs of letters and non-ASCII characters, A-Z lower-cased."""
    start = 0
    while start < len(text):
        end = start + PIECE
        # A piece ends where a term does.
        while end < len(text) and LETTERS[text[end]] != 0x20:
            end += 1
        yield text[start:end].translate(LETTERS).split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term (binary), and the rows that have it.

    The empty term stands for the group itself: its ``docs`` are all rows of the group. Null text,
    lang and source are empty.
    """
    schema = "lang string, source string, term binary, n bigint, docs bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in groups.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(rows), pa.string()), pa.array([source] * len(rows), pa.string()),
                        pa.array(list(rows), pa.binary()), pa.array([n[t] for t in rows], pa.int64()),
                        pa.array(list(rows.values()), pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for batch in batches:
            for part in slices(batch, "_text"):
                texts, langs, sources = (part.column(c).to_pylist() for c in ("_text", "lang", "source"))
                for text, lang, source in zip(texts, langs, sources):
                    n, rows = groups.setdefault((lang, source), (Counter(), Counter()))
                    held -= len(rows)
                    found: set[bytes] = {b""}
                    for words in terms_of(text):
                        n.update(words)
                        found.update(words)
                    rows.update(found)
                    held += len(rows)
                    if held > REMEMBERED:
                        yield from passed_on()
                        held = 0
        yield from passed_on()

    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce("text", F.lit("")).cast("binary").alias("_text"),
    )
    return rows.mapInArrow(count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


@dataclass
class Vocabulary:
    """What an audit starts from; every table is written down.

    ``langs``: lang, n_terms (V) and total (N). ``groups``: lang, source, n_terms, total, ``_no`` (the
    source's number in its language). ``segments``: lang, ``_segment``, size. ``entries``: lang, source,
    term, n, ``_segment`` and lang_n, the term's occurrences in the language; kept terms only.
    """

    langs: DataFrame
    groups: DataFrame
    segments: DataFrame
    entries: DataFrame


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, cells: int = CELLS) -> Vocabulary:
    """Count the terms of ``docs`` (text, lang, source) and place the kept ones in segments."""
    counted = materialise(term_counts(docs), "term-counts")
    terms = counted.where("term <> x''")
    kept = materialise(
        terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= min_docs)
        .select("lang", "term", "lang_n", F.floor(F.log2("lang_n")).alias("_level")),
        "kept-terms",
    )
    numbered = counted.where("term = x''").select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("_no")
    )
    sources = numbered.groupBy("lang").agg(F.count("*").alias("_sources"))
    langs = materialise(
        sources.join(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("total")), "lang", "left")
        .select("lang", "_sources", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_terms", "total")]),
        "languages",
    )
    # 64 levels a language at most.
    levels = materialise(
        kept.groupBy("lang", "_level").agg(F.count("*").alias("_terms")).join(langs, "lang")
        .select("lang", "_level", F.ceil(F.col("_terms") * F.col("_sources") / cells).alias("_parts")),
        "levels",
    )
    segment = F.struct("_level", F.pmod(F.xxhash64("term"), F.col("_parts")).alias("_part"))
    placed = materialise(
        kept.join(if_small(levels, levels.count()), ["lang", "_level"]).select("lang", "term", "lang_n", segment.alias("_segment")), "placed-terms"
    )
    entries = materialise(terms.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialise(
        numbered.join(totals, ["lang", "source"], "left").join(langs.select("lang", "n_terms"), "lang")
        .select("lang", "source", "n_terms", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), "_no"),
        "groups",
    )
    segments = placed.groupBy("lang", "_segment").agg(F.count("*").alias("size"))
    return Vocabulary(langs, groups, materialise(segments, "segments"), entries)


def share(n: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * n_terms)), without an overflow on the way."""
    whole = total + 2 * n_terms
    high = (n + 2) * HIGH
    div = lambda x: F.call_function("div", x, whole)
    return div(high) * LOW + div((high % whole) * LOW) + 1


def shares(n: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """:func:`share` of an array of counts."""
    whole = total + 2 * n_terms
    high = (n + 2) * HIGH
    return high // whole * LOW + high % whole * LOW // whole + 1


def run_length_columns(entries: DataFrame) -> DataFrame:
    """``lang, _segment, source, ends, counts``: the columns of a segment's sources as runs.

    ``entries`` has lang, _segment, term, source and n. Run k has the terms before ``ends[k]`` that no
    run before has, each with ``counts[k]`` occurrences. The terms of a segment are sorted by their
    counts in the source with the fewest different counts, then in the next one and so on, which
    leaves the fewest runs. Only sources that have a term of the segment have a column.
    """
    schema = "lang string, _segment struct<_level: bigint, _part: bigint>, source string, ends array<int>, counts array<bigint>"

    def encode(table: pa.Table) -> pa.Table:
        term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
        n_terms, n_sources = len(term.dictionary), len(source.dictionary)
        matrix = np.zeros((n_sources, n_terms), np.int64)
        matrix[source.indices.to_numpy(), term.indices.to_numpy()] = table.column("n").to_numpy()
        different = [len(np.unique(column)) for column in matrix]
        # The last key of lexsort counts first.
        matrix = matrix[:, np.lexsort(matrix[np.argsort(different, kind="stable")[::-1]])]
        ends, counts = [], []
        for column in matrix:
            end = np.append(np.nonzero(column[1:] != column[:-1])[0] + 1, n_terms)
            ends.append(end.astype(np.int32))
            counts.append(column[end - 1])
        return pa.table({
            "lang": table.column("lang").slice(0, 1).take([0] * n_sources), "_segment": table.column("_segment").slice(0, 1).take([0] * n_sources),
            "source": source.dictionary, "ends": pa.array(ends, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64())),
        })

    return entries.select("lang", "_segment", "term", "source", "n").groupBy("lang", "_segment").applyInArrow(encode, schema)


def pair_sums(table: pa.Table) -> pa.Table:
    """Sums of f over a segment for the pairs of one block of sources, or between two blocks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["_no"])
    size = rows[0]["size"]
    columns = []
    for r in rows:
        # A source without a term of the segment is one run of zeros.
        ends = np.array(r["ends"] if r["ends"] is not None else [size], np.int64)
        counts = np.array(r["counts"] if r["counts"] is not None else [0], np.int64)
        columns.append((ends, shares(counts, r["total"], r["n_terms"])))
    crossing = rows[0]["_i"] != rows[0]["_j"]
    firsts, seconds, values = [], [], []
    for x, (ends_x, p_x) in enumerate(columns):
        for y in range(x + 1, len(rows)):
            if crossing and rows[x]["_own"] == rows[y]["_own"]:
                continue
            ends_y, p_y = columns[y]
            bounds = np.union1d(ends_x, ends_y)
            p, q = p_x[np.searchsorted(ends_x, bounds)], p_y[np.searchsorted(ends_y, bounds)]
            firsts.append(rows[x]["source"])
            seconds.append(rows[y]["source"])
            values.append(int(((p - q) ** 2 // (p + q)) @ np.diff(bounds, prepend=0)))
    lang = pa.array([rows[0]["lang"]] * len(values), pa.string())
    return pa.table({"lang": lang, "source": pa.array(firsts, pa.string()), "item": pa.array(seconds, pa.string()), "value": pa.array(values, pa.int64())})


def pair_divergence(vocab: Vocabulary) -> DataFrame:
    """``lang, source, item, value``: the sum of f over all kept terms, for each source and each other one of its language."""
    groups = if_small(vocab.groups, vocab.groups.count())
    columns = run_length_columns(vocab.entries)
    block = F.floor(F.col("_no") / SOURCE_BLOCK)
    dense = (
        vocab.segments.join(groups, "lang").join(columns, ["lang", "_segment", "source"], "left")
        .withColumn("_own", block)
        .join(vocab.langs.select("lang", F.floor((F.col("_sources") - 1) / SOURCE_BLOCK).alias("_last")), "lang")
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
        .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    )
    schema = "lang string, source string, item string, value bigint"
    half = (
        dense.drop("_other", "_last").groupBy("lang", "_segment", "_i", "_j").applyInArrow(pair_sums, schema)
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    half = materialise(half, "pairs")
    # Languages without a kept term have no segment; the result lists their pairs too.
    empty = vocab.groups.where("n_terms = 0").select("lang", "source")
    zero = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    return half.union(half.select("lang", F.col("item"), F.col("source"), "value")).union(zero)


def telling_terms(vocab: Vocabulary, top: int) -> DataFrame:
    """``lang, source, term, value, rank``: the ``top`` terms that a source has more of than its language, by f."""
    groups = vocab.groups.select("lang", "source", "n_terms", "total")
    langs = vocab.langs.select("lang", F.col("total").alias("_lang_total"))
    rows = (
        vocab.entries.join(if_small(groups, groups.count()), ["lang", "source"]).join(if_small(langs, langs.count()), "lang")
        .withColumn("_p", share(F.col("n"), F.col("total"), F.col("n_terms")))
        .withColumn("_q", share(F.col("lang_n"), F.col("_lang_total"), F.col("n_terms")))
        .where("_p > _q")
        .withColumn("value", F.expr("(_p - _q) * (_p - _q) div (_p + _q)"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term"))
    # The limit by rank is taken in each partition before rows are shuffled.
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", "term", "value", "rank")


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = 10, cells: int = CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for the rows of ``docs`` (text, lang, source).

    Terms are runs of letters and characters outside ASCII, A-Z lower-cased. A language keeps the
    terms that at least ``min_docs`` of its documents have. With p and q the smoothed shares of a
    term, f = floor((p - q)^2 / (p + q)). Part ``pair`` has, for each source, every other source of its
    language and the sum of f over all kept terms. Part ``term`` has the ``top`` terms of a source by f
    against its language, among those that it has and has more of. Ranks start from 1, by falling value, then
    by the UTF-8 of the item. All numbers are exact.

    Null text, lang and source are empty; the empty language and source are as good as any. A group
    without a term has its pairs; a language with one source has none. Repeated rows count each.
    Texts of any length are read whole. An empty table gives an empty result. Other columns are
    ignored.
    """
    vocab = vocabulary(docs, min_docs, cells)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_divergence(vocab).withColumn("rank", F.row_number().over(order))
    terms = telling_terms(vocab, top).withColumn("item", F.col("term").cast("string"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).union(terms.withColumn("part", F.lit("term")).select(*columns))
