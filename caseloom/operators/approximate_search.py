"""Approximate nearest cases: random projections name buckets, found cases are ranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caseloom.functions.numbers import half_up
from caseloom.operators.skew import lookup_join
from caseloom.session import cut_and_count, cut_lineage

TABLES = 4
BITS = 6
PROBES = 2
# Rows of a bucket that one task compares with rows of the other side at once.
BLOCK_ROWS = 4096
# Piece counts of buckets: at most TABLES << BITS rows, which bounds what is broadcast.
MAX_BITS = 16


def hyperplanes(tables: int, bits: int, dimension: int, seed: int) -> np.ndarray:
    """Normals of the planes: (tables * bits) x dimension."""
    return np.random.default_rng(seed).standard_normal((tables * bits, dimension))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.array(vectors.tolist(), dtype=float)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)


def with_buckets(rows: DataFrame, planes: np.ndarray, tables: int, bits: int, probes: int) -> DataFrame:
    """``rows`` once per bucket of its ``embedding``: adds ``table`` and ``bucket``.

    A bucket is the pattern of the sides of a table's planes on which the vector lies; with ``probes``
    also the patterns that differ in up to so many sides.
    """
    shared = rows.sparkSession.sparkContext.broadcast(planes)
    flips = np.array([sum(1 << b for b in chosen) for n in range(probes + 1) for chosen in combinations(range(bits), n)], np.int32)

    @F.pandas_udf("array<int>")
    def patterns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            sides = (np.array(vectors.tolist(), dtype=float) @ shared.value.T >= 0).reshape(len(vectors), tables, bits)
            own = (sides << np.arange(bits)).sum(axis=2).astype(np.int32)
            # The table's number above the pattern.
            keys = (own[:, :, None] ^ flips) + (np.arange(tables, dtype=np.int32) << bits)[None, :, None]
            yield pd.Series(list(keys.reshape(len(vectors), -1)))

    return rows.withColumn("bucket", F.explode(patterns("embedding")))


def approximate_cases(
    queries: DataFrame, index: DataFrame, query_id: str, case_id: str, k: int = 5, tables: int = TABLES, bits: int = BITS,
    probes: int = PROBES, seed: int = 42, block_rows: int = BLOCK_ROWS, exclude_self: bool = False,
) -> DataFrame:
    """``query_id, rank, case_id, similarity_score``: up to ``k`` similar cases, most of the truly nearest among them.

    In each of ``tables`` tables, ``bits`` random planes through the origin put every vector into a
    bucket. A query looks into its own buckets and into those across up to ``probes`` planes. The cases found
    are ranked by their exact cosine, rounded to 6 places, then by case id. A case at the angle t of a query is
    missed by one table with the chance that more than ``probes`` of ``bits`` planes part them, each with
    the chance t / pi.

    Copies of a vector are merged first: of equal vectors only the first ``k`` case ids can be
    returned, and one search serves all equal queries. Large buckets, on either side, are split into
    pieces of about ``block_rows`` rows that meet in pairs, so no task holds a whole bucket, and
    each pair of pieces is a matrix product that passes on ``k`` rows per query. Rows without a
    vector, and queries whose buckets are empty, have no result. It is an operator of its own; the
    exact search never turns into it.
    """
    spark = queries.sparkSession
    if bits > MAX_BITS:
        raise ValueError(f"at most {MAX_BITS} planes a table")
    query_type, case_type = queries.schema[query_id].dataType.simpleString(), index.schema[case_id].dataType.simpleString()
    want = k + 1 if exclude_self else k
    copies = Window.partitionBy("embedding").orderBy("case_id")
    cases, n_cases = cut_and_count(
        index.where(F.col("embedding").isNotNull()).select(F.col(case_id).alias("case_id"), "embedding")
        .withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= want).drop("_copy")
    )
    if k <= 0 or not n_cases:
        return spark.createDataFrame([], f"{query_id} {query_type}, rank int, case_id {case_type}, similarity_score double")
    searches = cut_lineage(queries.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min(query_id).alias("rep")))
    planes = hyperplanes(tables, bits, len(cases.select("embedding").first()[0]), seed)

    known = with_buckets(cases, planes, tables, bits, 0)
    asked = with_buckets(searches, planes, tables, bits, probes)

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    # At most tables << bits rows.
    plan = cut_lineage(pieces(known, "_known").join(pieces(asked, "_asked"), "bucket"))
    plan = F.broadcast(plan)
    left = (
        asked.join(plan, "bucket").withColumn("_i", F.pmod(F.xxhash64("rep"), F.col("_asked")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_known") - 1)))
        .select(F.col("bucket").alias("bucket"), "_i", "_j", F.col("rep").alias("rep"), F.col("embedding").alias("_vector"))
    )
    right = (
        known.join(plan, "bucket").withColumn("_j", F.pmod(F.xxhash64("case_id"), F.col("_known")).cast("int"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_asked") - 1)))
        .select(F.col("bucket").alias("bucket"), "_i", "_j", F.col("case_id").alias("case_id"), F.col("embedding").alias("_vector"))
    )

    schema = pa.schema([("rep", arrow_type(left, "rep")), ("case_id", arrow_type(right, "case_id")), ("similarity", pa.float64())])

    def rank(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return schema.empty_table()
        others = others.sort_by("case_id")
        a, b = unit_rows(some.column("_vector").to_pandas()), unit_rows(others.column("_vector").to_pandas())
        similarity = np.floor(a @ b.T * 1e6 + 0.5) / 1e6
        n = min(want, similarity.shape[1])
        # The lower case id is first among equals.
        best = np.argsort(-similarity, axis=1, kind="stable")[:, :n]
        rows = np.repeat(np.arange(len(best)), n)
        return pa.table(
            [some.column("rep").take(pa.array(rows)), others.column("case_id").take(pa.array(best.ravel())), pa.array(similarity[rows, best.ravel()])],
            schema=schema,
        )

    keys = ["bucket", "_i", "_j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, f"rep {query_type}, case_id {case_type}, similarity double")
    order = Window.partitionBy("rep").orderBy(F.desc("similarity"), "case_id")
    best = found.groupBy("rep", "case_id").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)
    # At most k + 1 entries a query.
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "case_id", "similarity"))).alias("_found"))
    answers = cut_lineage(searches.join(lists, "rep").select(F.xxhash64("embedding").alias("_vector"), F.col("embedding").alias("_same"), "_found"))
    own = queries.select(query_id, "embedding", F.xxhash64("embedding").alias("_vector"))
    joined = lookup_join(own, answers, "_vector", query_id, "inner").where("embedding = _same")
    found = F.filter("_found", lambda f: ~f["case_id"].eqNullSafe(F.col(query_id))) if exclude_self else F.col("_found")
    return joined.select(query_id, F.posexplode(F.slice(found, 1, k)).alias("_at", "_f")).select(
        query_id, (F.col("_at") + 1).alias("rank"), "_f.case_id", half_up(F.greatest(F.col("_f.similarity"), F.lit(0.0)), 4).alias("similarity_score")
    )


def arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(rows.schema[column].dataType)


def recall(found: DataFrame, exact: DataFrame, query_id: str) -> DataFrame:
    """One row: ``queries, expected, found, recall`` of the pairs of ``exact`` (query_id, case_id)."""
    hits = found.select(query_id, "case_id", F.lit(1).alias("_hit"))
    return (
        exact.select(query_id, "case_id").join(hits, [query_id, "case_id"], "left")
        .agg(F.count_distinct(query_id).alias("queries"), F.count("*").alias("expected"), F.count("_hit").alias("found"))
        .withColumn("recall", half_up(F.col("found") / F.col("expected"), 4))
    )
