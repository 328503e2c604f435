"""Exact nearest-case search and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.constants import OTHER
from caseloom.functions.numbers import half_up
from caseloom.functions.text import strip
from caseloom.operators.skew import lookup_join
from caseloom.session import cut_and_count, cut_lineage

# Cases in a block, and queries: each vector is copied once for every block of the other side.
BLOCK_ROWS = 8192
# A task works out the similarities of so many queries at a time.
SLICE_ROWS = 256
# Up to so many distinct query vectors are sent to all tasks, and cases stay where they are.
SENT_QUERIES = 4096
MAX_PIVOTS = 1024
SLACK = 2e-6  # similarities are compared after rounding to 6 places


def _unit_rows(vectors: pd.Series, query: bool = False) -> np.ndarray:
    """Rows of length 1.

    Two extra coordinates, one for each side, take up a zero vector: it then has length 1 as
    well and similarity 0 to everything, so that distance always falls as similarity rises.
    """
    matrix = np.array(vectors.tolist(), dtype=float)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    zero = (lengths == 0).astype(float)
    none = np.zeros_like(zero)
    extra = [none, zero] if query else [zero, none]
    return np.hstack([matrix / np.where(lengths == 0, 1.0, lengths), *extra])


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(2.0 - 2.0 * (a @ b.T), 0.0)


def similarities(asked: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Products of the rows to 6 places, with the place of the first, for ``SLICE_ROWS`` rows of ``asked`` at a time."""
    for first in range(0, len(asked), SLICE_ROWS):
        yield first, np.floor(asked[first : first + SLICE_ROWS] @ known.T * 1e6 + 0.5) / 1e6


def _best(similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest entries per row; the lower column breaks ties."""
    k = min(k, similarity.shape[1])
    least = np.partition(similarity, similarity.shape[1] - k, axis=1)[:, -k]
    rows, cols = np.nonzero(similarity >= least[:, None])
    order = np.lexsort((cols, -similarity[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], cols[keep]


def _unit_lists(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero."""
    sizes = vectors.value_lengths()
    if pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors of several lengths")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    matrix = flat.reshape(len(vectors), len(flat) // len(vectors))
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)


def _nearest_to_few(searches: DataFrame, cases: DataFrame, want: int, out_schema: str) -> DataFrame:
    """``rep, case_id, similarity``: of every batch of cases the ``want`` nearest to each of a few queries.

    Lower ids come first among equals, as they do in the end, so copies of a vector need not be merged.
    """
    table = searches.select("rep", "embedding").toArrow().combine_chunks()
    if not len(table):
        return searches.sparkSession.createDataFrame([], out_schema)
    reps = table["rep"].combine_chunks()
    shared = searches.sparkSession.sparkContext.broadcast(_unit_lists(table["embedding"].combine_chunks()))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.array_sort_indices(batch["case_id"], null_placement="at_start")
            ids, known = batch["case_id"].take(order), _unit_lists(batch["embedding"])[order.to_numpy()]
            for first, similarity in similarities(shared.value, known):
                rows, cols = _best(similarity, want)
                found = [reps.take(pa.array(first + rows)), ids.take(pa.array(cols)), pa.array(similarity[rows, cols])]
                yield pa.RecordBatch.from_arrays(found, ["rep", "case_id", "similarity"])

    return cases.mapInArrow(nearest, out_schema)


def _pivots(cases: DataFrame, n_cases: int, block_rows: int) -> np.ndarray:
    """A hash-chosen sample of the cases, one per block of cases and at most MAX_PIVOTS."""
    wanted = min(MAX_PIVOTS, max(1, math.ceil(n_cases / block_rows)))
    sample = cases.orderBy(F.xxhash64("case_id"), "case_id").limit(wanted).select("embedding")
    return _unit_rows(sample.toArrow().to_pandas()["embedding"])


def _nearest_to_many(searches: DataFrame, known: DataFrame, want: int, out_schema: str, block_rows: int) -> DataFrame:
    """``rep, case_id, similarity``: of every block of cases the ``want`` nearest to each query that it can matter to."""
    spark = searches.sparkSession
    copies = Window.partitionBy("embedding").orderBy("case_id")
    cases = cut_lineage(
        known.withColumn("copy", F.row_number().over(copies))
        .where(F.col("copy") <= want)
        .drop("copy")
    )
    n_cases = cases.count()
    if n_cases == 0:
        return spark.createDataFrame([], out_schema)
    pivots = spark.sparkContext.broadcast(_pivots(cases, n_cases, block_rows))

    @F.pandas_udf("struct<cell: int, distance: double>")
    def nearest_pivot(vectors: pd.Series) -> pd.DataFrame:
        square = _squared_distances(_unit_rows(vectors), pivots.value)
        cell = square.argmin(axis=1)
        distance = np.sqrt(square[np.arange(len(cell)), cell])
        return pd.DataFrame({"cell": cell.astype(np.int32), "distance": distance})

    placed = cut_lineage(
        cases.withColumn("p", nearest_pivot("embedding")).select("case_id", "embedding", "p.*")
    )
    sizes = placed.groupBy("cell").agg(
        F.max("distance").alias("radius"), F.count("*").alias("members")
    )
    # At most MAX_PIVOTS rows.
    size_rows = sizes.toArrow().to_pandas().set_index("cell")
    n_cells = len(pivots.value)
    radius = np.full(n_cells, -np.inf)
    radius[size_rows.index] = size_rows["radius"]
    members = np.zeros(n_cells)
    members[size_rows.index] = size_rows["members"]
    bounds = spark.sparkContext.broadcast((radius, members))

    @F.pandas_udf("array<int>")
    def useful_cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        radii, counts = bounds.value
        for vectors in batches:
            distance = np.sqrt(_squared_distances(_unit_rows(vectors, True), pivots.value))
            # Every member of a cell is within distance + radius: the cells closest by that
            # measure which together hold enough cases bound the k-th distance from above.
            upper = np.where(counts > 0, distance + radii, np.inf)
            by_upper = np.argsort(upper, axis=1, kind="stable")
            enough = (np.cumsum(counts[by_upper], axis=1) >= want).argmax(axis=1)
            rows = np.arange(len(upper))
            limit = upper[rows, by_upper[rows, enough]]
            if counts.sum() < want:
                limit[:] = np.inf
            limit = np.sqrt(limit**2 + 2 * SLACK) + 1e-9
            keep = (distance - radii <= limit[:, None]) & (counts > 0)
            yield pd.Series([np.flatnonzero(row).astype(np.int32) for row in keep])

    wanted_cells = cut_lineage(
        searches.select("rep", "embedding", F.explode(useful_cells("embedding")).alias("cell"))
    )
    # One row per cell again, so both tables are bounded by MAX_PIVOTS rows.
    blocks = sizes.select("cell", F.ceil(F.col("members") / block_rows).cast("int").alias("case_blocks"))
    chunks = wanted_cells.groupBy("cell").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("query_blocks")
    )
    plan = F.broadcast(blocks.join(chunks, "cell"))
    left = (
        wanted_cells.join(plan, "cell")
        .withColumn("qb", F.pmod(F.xxhash64("rep"), F.col("query_blocks")).cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("case_blocks") - 1)))
        .select("cell", "cb", "qb", F.col("rep").alias("rep"), F.col("embedding").alias("asked"))
    )
    right = (
        placed.join(plan, "cell")
        .withColumn("cb", F.pmod(F.xxhash64("case_id"), F.col("case_blocks")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        .select("cell", "cb", "qb", F.col("case_id").alias("case_id"), F.col("embedding").alias("known"))
    )

    def score(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({"rep": [], "case_id": [], "similarity": []})
        known = known.sort_values("case_id", kind="stable")
        reps, ids, parts = asked["rep"].to_numpy(), known["case_id"].to_numpy(), []
        for first, similarity in similarities(_unit_rows(asked["asked"], True), _unit_rows(known["known"])):
            rows, cols = _best(similarity, want)
            parts.append({"rep": reps[first + rows], "case_id": ids[cols], "similarity": similarity[rows, cols]})
        return pd.DataFrame({name: np.concatenate([part[name] for part in parts]) for name in parts[0]})

    keys = ["cell", "cb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, out_schema)


def nearest_cases(
    queries: DataFrame,
    index: DataFrame,
    query_id: str,
    case_id: str,
    k: int = 5,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, case_id, similarity_score)``: the exact ``k`` most cosine-similar cases.

    Order is similarity rounded to 6 places, then case id. Both inputs need ``embedding``.

    Equal vectors cannot be told apart by any query, so per distinct vector only the first
    ``k`` case ids can ever be returned and one search serves all equal queries: copies are
    merged on both sides first. The cases are then grouped into cells around sampled
    pivots, and the triangle inequality tells each query which cells can hold one of its
    ``k`` nearest cases. Cells and their queries are cut into blocks of bounded size; each
    pair of blocks is one matrix product that passes on ``k`` rows per query. No cell is
    ever skipped unless the bound proves that it cannot matter. Few queries go to the cases
    instead, which are then read once and neither sorted nor moved.
    """
    spark = queries.sparkSession
    query_type = queries.schema[query_id].dataType.simpleString()
    case_type = index.schema[case_id].dataType.simpleString()
    out_schema = f"rep {query_type}, case_id {case_type}, similarity double"
    if k <= 0:
        return spark.createDataFrame(
            [], f"{query_id} {query_type}, rank int, case_id {case_type}, similarity_score double"
        )
    want = k + 1 if exclude_self else k

    searches, n_searches = cut_and_count(
        queries.where(F.col("embedding").isNotNull())
        .groupBy("embedding")
        .agg(F.min(query_id).alias("rep"))
    )
    known = index.select(F.col(case_id).alias("case_id"), "embedding").where(F.col("embedding").isNotNull())
    if n_searches <= SENT_QUERIES:
        partial = _nearest_to_few(searches, known, want, out_schema)
    else:
        partial = _nearest_to_many(searches, known, want, out_schema, block_rows)
    order = Window.partitionBy("rep").orderBy(F.desc("similarity"), "case_id")
    best = partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= want)
    # At most k + 1 entries per distinct query vector.
    lists = best.groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("place", "case_id", "similarity"))).alias("found")
    )
    # A hash stands for the vector as the key, so that the table of hot keys stays small.
    answers = cut_lineage(
        searches.join(lists, "rep").select(
            F.xxhash64("embedding").alias("_vector"), F.col("embedding").alias("_same"), "found"
        )
    )
    asked = queries.select(F.col(query_id), "embedding", F.xxhash64("embedding").alias("_vector"))
    joined = lookup_join(asked, answers, "_vector", query_id, "inner").where("embedding = _same")
    found = F.col("found")
    if exclude_self:
        found = F.filter(found, lambda f: ~f["case_id"].eqNullSafe(F.col(query_id)))
    return joined.select(
        query_id, F.posexplode(F.slice(found, 1, k)).alias("pos", "f")
    ).select(
        query_id,
        (F.col("pos") + 1).alias("rank"),
        "f.case_id",
        half_up(F.greatest(F.col("f.similarity"), F.lit(0.0)), 4).alias("similarity_score"),
    )


def with_case_details(found: DataFrame, index: DataFrame, query_id: str, case_id: str) -> DataFrame:
    """Add the stored fields of each found case; a case found by very many queries is spread."""
    details = index.drop("embedding").withColumnRenamed(case_id, "case_id")
    return lookup_join(found, details, "case_id", query_id, "inner")


def pack_cases(detailed: DataFrame, query_id: str) -> DataFrame:
    """One row per query with its ordered array of cases (at most ``k`` entries)."""
    case = F.struct(
        "rank",
        "similarity_score",
        F.col("customer_message").alias("historical_customer_message"),
        F.col("brand_response").alias("historical_brand_response"),
        "intent",
        F.col("case_id").cast("string").alias("conversation_id"),
        "context",
        "timestamp",
    )
    return detailed.groupBy(query_id).agg(F.array_sort(F.collect_list(case)).alias("cases"))


def case_rows(conversations: DataFrame, min_fields: tuple[str, str] = ("customer_message", "brand_response")) -> DataFrame:
    """Rows worth indexing: both texts more than white space, with the context line."""
    message, reply = (strip(F.col(c)) for c in min_fields)
    context = F.concat(F.lit("Brand: "), F.coalesce("brand", F.lit("AmazonHelp")), F.lit(" | Turns: "),
                       F.coalesce("turns", F.lit(1)).cast("string"))
    return conversations.where((message != "") & (reply != "")).select(
        "conversation_id",
        message.alias("customer_message"),
        reply.alias("brand_response"),
        F.coalesce("intent", F.lit(OTHER)).alias("intent"),
        "turns",
        context.alias("context"),
        "timestamp",
    )


def judge_hits(found: DataFrame, query_id: str, truth: str = "true_intent", got: str = "intent") -> DataFrame:
    """Per query: rank of the first case with the true intent and the hits at 1, 3 and 5."""
    hit = F.col(truth) == F.col(got)
    first = F.min(F.when(hit, F.col("rank")))
    return found.groupBy(query_id, truth).agg(first.alias("first_hit")).select(
        query_id,
        truth,
        "first_hit",
        *[
            F.coalesce(F.col("first_hit") <= n, F.lit(False)).alias(f"hit_{n}")
            for n in (1, 3, 5)
        ],
    )


def retrieval_metrics(judged: DataFrame) -> DataFrame:
    """One row: recall at 1, 3 and 5 and the mean reciprocal rank."""
    return judged.agg(
        F.count("*").alias("queries"),
        *[half_up(F.avg(F.col(f"hit_{n}").cast("int")), 4).alias(f"recall_at_{n}") for n in (1, 3, 5)],
        half_up(F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))), 4).alias("mrr"),
    )


def hit_and_miss_examples(judged: DataFrame, query_id: str, n: int = 5) -> DataFrame:
    """The first ``n`` queries whose best case fits and the first ``n`` where it does not."""
    first = Window.partitionBy("hit_1").orderBy(query_id)
    return judged.withColumn("example", F.row_number().over(first)).where(F.col("example") <= n)


def index_status(index: DataFrame, min_confidence: float, min_similarity: float) -> DataFrame:
    """One row: indexed cases, their dimension and the thresholds in force."""
    return index.agg(
        F.count("*").alias("index_size"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
    ).select(
        "*",
        F.lit(min_confidence).alias("min_intent_confidence"),
        F.lit(min_similarity).alias("min_retrieval_similarity"),
    )
