"""Exact search over sparse term weights: an inverted index with prefix filtering."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.numbers import half_up
from caseloom.operators.skew import lookup_join
from caseloom.operators.tfidf import document_frequencies, smooth_idf, term_counts
from caseloom.session import checkpoint_dir, cut_and_count, cut_lineage

# The first candidates of a query hold one of its rarest terms, so many postings of them at least.
SEED_POSTINGS = 256
# So many cases of a query, those with the largest part so far, are scored before the others are judged.
PROBED = 64
# Bounds are compared with scores that are rounded to 6 places.
SLACK = 1e-6
# Tables up to this number of narrow rows are sent to all executors.
BROADCAST_ROWS = 200_000


@dataclass
class TermIndex:
    """Written tables of an index.

    ``postings``: case_id, term and tf. ``lengths``: case_id and the length of its raw weights; a weight is
    the raw one over it. ``terms``: term, df and idf.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    n_cases: int
    sublinear: bool = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def raw_weight(sublinear: bool) -> Column:
    tf = F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")
    return tf * F.col("idf")


def lengths_of(counts: DataFrame, idf: DataFrame, n_terms: int, key: str, sublinear: bool) -> DataFrame:
    """``key, _length`` of the counted terms in ``idf`` (term, df, idf).

    A long vocabulary is looked up in two parts. The ``BROADCAST_ROWS`` most frequent terms, which make up
    most postings, are sent to all tasks and added up there before rows meet by ``key``. Only postings of
    the other terms are shuffled by term; none of those is frequent.
    """
    idf = idf.select("term", "df", "idf")
    raw = raw_weight(sublinear)
    square = F.sum(raw * raw)
    if n_terms <= BROADCAST_ROWS:
        squares = counts.join(F.broadcast(idf), "term").groupBy(key).agg(square.alias("_square"))
    else:
        frequent = cut_lineage(idf.orderBy(F.desc("df"), "term").limit(BROADCAST_ROWS))
        rare = idf.join(F.broadcast(frequent), "term", "left_anti")
        unseen = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti")
        parts = [counts.join(F.broadcast(frequent), "term"), unseen.join(rare, "term")]
        added = [part.groupBy(key).agg(square.alias("_square")) for part in parts]
        squares = added[0].unionByName(added[1])
    return squares.groupBy(key).agg(F.sqrt(F.sum("_square")).alias("_length"))


def build_term_index(
    docs: DataFrame, key: str, text: str = "text", min_df: int = 2, bigrams: bool = False, sublinear: bool = True
) -> TermIndex:
    """Index the terms of ``docs`` that at least ``min_df`` of them have; every one, whatever the number."""
    counts = written(term_counts(docs, key, text, bigrams).withColumnRenamed(key, "case_id"), "postings")
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    kept = document_frequencies(counts).where(F.col("df") >= min_df)
    terms = written(kept.select("term", "df", smooth_idf(F.col("df"), n_docs).alias("idf")), "terms")
    lengths = written(lengths_of(counts, terms, terms.count(), "case_id", sublinear), "lengths")
    return TermIndex(counts, lengths, terms, lengths.count(), sublinear)


def with_weights(found: DataFrame, index: TermIndex) -> DataFrame:
    """Add ``weight`` to postings with their ``idf``."""
    if index.n_cases <= BROADCAST_ROWS:
        found = found.join(F.broadcast(index.lengths), "case_id")
    else:
        found = lookup_join(found, index.lengths, "case_id", "term", "inner")
    return found.withColumn("weight", raw_weight(index.sublinear) / F.col("_length"))


def postings_of(some: DataFrame, n_some: int, index: TermIndex, query_id: str) -> DataFrame:
    """Postings of the terms in ``some`` (query_id, term, idf, _asked): ``query_id, case_id, term, weight, _asked``.

    A frequent term is spread over tasks.
    """
    if n_some <= BROADCAST_ROWS:
        found = index.postings.join(F.broadcast(some), "term")
    else:
        found = lookup_join(index.postings, some, "term", "case_id", "inner")
    return with_weights(found, index)


def shared_terms(pairs: DataFrame, n_pairs: int, asked: DataFrame, n_asked: int, index: TermIndex, query_id: str) -> DataFrame:
    """Postings, with weights, of the cases in ``pairs`` (query_id, case_id) for those terms in ``asked`` that their query has."""
    asked = asked.select(query_id, "term", "idf", "_asked")
    postings = index.postings
    if n_asked <= BROADCAST_ROWS:
        postings = postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    # Postings meet the queries that ask for their case, and then only the terms of those.
    if n_pairs <= BROADCAST_ROWS:
        own = postings.join(F.broadcast(pairs), "case_id")
    else:
        own = lookup_join(postings, pairs, "case_id", "term", "inner")
    return with_weights(own.join(few(asked, n_asked), [query_id, "term"]), index)


def pair_scores(pairs: DataFrame, n_pairs: int, asked: DataFrame, n_asked: int, index: TermIndex, query_id: str) -> DataFrame:
    """``query_id, case_id, similarity`` of the ``pairs`` (query_id, case_id): the whole dot product."""
    both = shared_terms(pairs, n_pairs, asked, n_asked, index, query_id)
    # Added up in the order of the terms, whatever the order in which they arrive.
    parts = F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * F.col("_asked")).alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda so_far, e: so_far + e["part"])
    return both.groupBy(query_id, "case_id").agg(half_up(total, 6).alias("similarity"))


def sparse_topk(queries: DataFrame, index: TermIndex, query_id: str, text: str = "text", k: int = 5, bigrams: bool = False) -> DataFrame:
    """``query_id, rank, case_id, similarity``: the exact ``k`` most similar cases that share a term.

    Similarity is the cosine of TF-IDF weights, rounded to 6 places; the lower case id breaks ties.

    Terms of a query are taken from the rarest on. The cases with its rarest terms are scored first,
    and the k-th best of them is a score to beat. Then the frequent terms are left out as long as
    what they could add together, with the largest weight that any case gives them, stays below that score:
    a case with none of the other terms cannot be among the k best. So frequent terms form no pairs
    of a query and a case, unless a query has nothing else. Cases whose part from the terms looked
    at, with the most that the others can add, stays below the score are dropped before the rest is added up. The
    cases with the largest such parts are scored first, which raises the score to beat for all others.

    A query without a known term has no rows. Repeated queries are answered each.
    """
    counts = cut_lineage(term_counts(queries, query_id, text, bigrams))
    # Queries bring few terms; only those are looked up among all.
    wanted, n_wanted = cut_and_count(counts.select("term").distinct())
    known = cut_lineage(index.terms.join(few(wanted, n_wanted), "term", "left_semi"))
    lengths = lengths_of(counts, known, n_wanted, query_id, index.sublinear)
    shared = ["term", "idf", "df"]
    weights = counts.join(few(known.select(*shared), n_wanted), "term").join(lengths, query_id)
    weights = cut_lineage(weights.select(query_id, *shared, (raw_weight(index.sublinear) / F.col("_length")).alias("_asked")))
    each = known.select(F.lit(0).alias(query_id), "term", "idf", F.lit(0.0).alias("_asked"))
    most = postings_of(each, n_wanted, index, query_id).groupBy("term").agg(F.max("weight").alias("most"))
    asked, n_asked = cut_and_count(weights.join(few(cut_lineage(most), n_wanted), "term"))

    def candidates(some: DataFrame) -> DataFrame:
        return postings_of(some.select(query_id, "term", "idf", "_asked"), n_asked, index, query_id)

    rarest = Window.partitionBy(query_id).orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = asked.withColumn("_before", before).where(F.col("_before") < max(SEED_POSTINGS, k))
    first, n_first = cut_and_count(candidates(seeds).select(query_id, "case_id").distinct())
    scored = cut_lineage(pair_scores(first, n_first, asked, n_asked, index, query_id))
    ranked = Window.partitionBy(query_id).orderBy(F.desc("similarity"), "case_id")

    def to_beat(scores: DataFrame) -> DataFrame:
        kth = scores.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == k)
        return kth.select(query_id, F.col("similarity").alias("_least"))

    # What the terms from the most frequent down to this one can add at most.
    frequent = Window.partitionBy(query_id).orderBy(F.desc("df"), F.desc("term"))
    added = F.col("_asked") * F.col("most")
    bound = F.sum(added).over(frequent.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    judged = asked.withColumn("_bound", bound).join(to_beat(scored), query_id, "left").withColumn("_least", F.coalesce("_least", F.lit(-1.0)))
    marked = cut_lineage(judged.withColumn("_prefix", F.col("_bound") >= F.col("_least") - SLACK))
    rest = marked.groupBy(query_id).agg(
        F.max("_least").alias("_least"), F.coalesce(F.sum(F.when(~F.col("_prefix"), added)), F.lit(0.0)).alias("_rest")
    )
    partial = cut_lineage(
        candidates(marked.where("_prefix")).groupBy(query_id, "case_id").agg(F.sum(F.col("weight") * F.col("_asked")).alias("_part"))
        .join(few(rest, n_asked), query_id).where(F.col("_part") + F.col("_rest") >= F.col("_least") - SLACK)
        .join(few(first, n_first), [query_id, "case_id"], "left_anti")
        .select(query_id, "case_id", "_part", "_rest")
    )
    largest = Window.partitionBy(query_id).orderBy(F.desc("_part"), "case_id")
    placed = partial.withColumn("_place", F.row_number().over(largest)).where(F.col("_place") <= max(PROBED, k))
    probed, n_probed = cut_and_count(placed.select(query_id, "case_id"))
    scored = cut_lineage(scored.union(pair_scores(probed, n_probed, asked, n_asked, index, query_id)))
    least = few(cut_lineage(to_beat(scored)), n_asked)
    open_, n_open = cut_and_count(
        partial.join(least, query_id, "left").where(F.col("_part") + F.col("_rest") >= F.coalesce("_least", F.lit(-1.0)) - SLACK)
        .join(few(probed, n_probed), [query_id, "case_id"], "left_anti").select(query_id, "case_id", "_part")
    )
    # Of those, the terms left out are looked at, too; only near the k-th best are scores added up in order.
    pairs = open_.select(query_id, "case_id")
    left_out = cut_lineage(marked.where(~F.col("_prefix")).join(few(pairs.select(query_id).distinct(), n_asked), query_id, "left_semi"))
    others = shared_terms(pairs, n_open, left_out, n_asked, index, query_id)
    others = others.select(query_id, "case_id", (F.col("weight") * F.col("_asked")).alias("_part"))
    sums = cut_lineage(open_.unionByName(others).groupBy(query_id, "case_id").agg(F.sum("_part").alias("_part")))
    kth = sums.withColumn("_place", F.row_number().over(largest)).where(F.col("_place") == k)
    best = F.greatest(F.coalesce("_kth", F.lit(-1.0)), F.coalesce("_least", F.lit(-1.0)))
    near = (
        sums.join(few(kth.select(query_id, F.col("_part").alias("_kth")), n_asked), query_id, "left")
        .join(least, query_id, "left").where(F.col("_part") >= best - 2 * SLACK)
    )
    more, n_more = cut_and_count(near.select(query_id, "case_id"))
    every = scored.union(pair_scores(more, n_more, asked, n_asked, index, query_id))
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(query_id, "rank", "case_id", "similarity")
