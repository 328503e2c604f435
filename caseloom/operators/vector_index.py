"""A stored search structure: distinct vectors packed in binary blocks, built once and appended to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.numbers import half_up
from caseloom.operators.retrieval import similarities
from caseloom.operators.skew import lookup_join, number_rows
from caseloom.session import cut_and_count, cut_lineage

# Vectors in a block; a task holds a block of cases and one of queries at a time.
BLOCK_ROWS = 4096
# A vector keeps so many of its lowest case ids: a search can ask for as many results.
MAX_RESULTS = 100
# Blocks of queries that are sent to all tasks at once: PASS_BLOCKS * BLOCK_ROWS vectors at most.
PASS_BLOCKS = 16
BLOCK_SCHEMA = "block bigint, rows int, dimension int, ids array<array<string>>, vectors binary"


@dataclass
class VectorIndex:
    """Blocks below ``path``, one folder for each time that cases were added.

    A row is a block: distinct vectors as float32, row after row, and the lowest ``MAX_RESULTS`` case
    ids of each vector, as text.
    """

    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/blocks")

    def size(self) -> int:
        """Stored vectors, added up from the block rows."""
        return self.blocks().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def packed(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of ``vectors`` (position, ids, embedding)."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        rows = np.array(table.column("embedding").to_pylist(), np.float32)
        return pa.table({
            "block": table.column("block").slice(0, 1), "rows": pa.array([len(rows)], pa.int32()),
            "dimension": pa.array([rows.shape[1]], pa.int32()), "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.string()))),
            "vectors": pa.array([rows.tobytes()], pa.binary()),
        })

    placed = vectors.withColumn("block", F.floor((F.col("position") - 1) / block_rows))
    return placed.groupBy("block").applyInArrow(pack, BLOCK_SCHEMA)


def add_cases(spark: SparkSession, path: str, cases: DataFrame, case_id: str, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Pack ``cases`` (case_id, embedding) and append the blocks to the index at ``path``, a new one if there is none.

    The raw cases are read here and never again. Copies of a vector are merged within what is added
    at once; a vector that comes again later gets a row of its own, and searches see both. Rows
    without a vector are left out; vectors are stored in single precision.
    """
    order = Window.partitionBy("embedding").orderBy("_id")
    distinct = (
        cases.where(F.col("embedding").isNotNull())
        .select(F.col(case_id).alias("_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        .withColumn("_copy", F.row_number().over(order))
        .where(F.col("_copy") <= MAX_RESULTS)
        .groupBy("embedding")
        .agg(F.transform(F.array_sort(F.collect_list("_id")), lambda i: i.cast("string")).alias("ids"))
        .withColumn("_place", F.xxhash64("embedding"))
    )
    numbered = number_rows(distinct, [F.col("_place"), F.col("embedding")])
    packed(numbered.select("position", "ids", "embedding"), block_rows).write.parquet(f"{path}/blocks/{uuid.uuid4().hex}")
    return VectorIndex(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index at ``path``; fails when there is none."""
    index = VectorIndex(spark, path)
    try:
        index.blocks()
    except AnalysisException as error:
        raise FileNotFoundError(f"no vector index at {path}") from error
    return index


def search(
    queries: DataFrame, index: VectorIndex, query_id: str, case_type: str, k: int = 5, block_rows: int = BLOCK_ROWS, exclude_self: bool = False
) -> DataFrame:
    """``query_id, rank, case_id, similarity_score``: the exact ``k`` most similar cases of the stored index.

    Order is the cosine rounded to 6 places, then the case id, as of ``case_type``. Equal queries are
    answered once. Queries are packed like the cases, and their blocks are sent to all tasks, a
    bounded number in a pass; every pair of blocks is a matrix product that passes on the ``k`` best
    of a query and what equals the last of them. The work is the number of queries times the number
    of stored vectors, as for any exact search of vectors without structure; no row of the cases is
    read, sorted or copied for it. A query without a vector has no rows; an empty index finds nothing.
    """
    want = k + 1 if exclude_self else k
    if not 0 <= k <= want <= MAX_RESULTS:
        raise ValueError(f"at most {MAX_RESULTS} results")
    own = queries.select(query_id, F.col("embedding").cast("array<float>").alias("embedding"))
    asked, n_asked = cut_and_count(
        own.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min(query_id).cast("string").alias("_rep"))
    )
    numbered = number_rows(asked.withColumn("_place", F.xxhash64("embedding")), [F.col("_place"), F.col("embedding")])
    chunks = cut_lineage(packed(numbered.select("position", F.array("_rep").alias("ids"), "embedding"), block_rows))
    chunks = chunks.select("block", F.col("ids").alias("_asked"), F.col("vectors").alias("_rows"))

    def unit(content: pa.Scalar, dimension: int) -> np.ndarray:
        rows = np.frombuffer(content.as_buffer(), np.float32).reshape(-1, dimension).astype(float)
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(lengths == 0, 1.0, lengths)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dimension = batch.column("dimension")[row].as_py()
                a, b = (unit(batch.column(c)[row], dimension) for c in ("_rows", "vectors"))
                ids, asked_ids = batch.column("ids")[row].as_py(), batch.column("_asked")[row].as_py()
                for first, similarity in similarities(a, b):
                    n = min(want, similarity.shape[1])
                    # Everything as good as the n-th best: ids, which break ties, are compared later.
                    least = -np.partition(-similarity, n - 1, axis=1)[:, n - 1]
                    at, which = np.nonzero(similarity >= least[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([asked_ids[first + x][0] for x in at], pa.string()),
                            pa.array([ids[y] for y in which], pa.list_(pa.string())),
                            pa.array(similarity[at, which], pa.float64()),
                        ],
                        ["_rep", "_ids", "similarity"],
                    )

    n_blocks = -(-n_asked // block_rows)
    passes = []
    for first in range(0, n_blocks if k else 0, PASS_BLOCKS):
        last = min(first + PASS_BLOCKS, n_blocks) - 1
        turns = F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))).alias("block")
        pairs = index.blocks().select(turns, "dimension", "ids", "vectors").join(F.broadcast(chunks.where(F.col("block").between(first, last))), "block")
        passes.append(pairs.mapInArrow(multiply, "_rep string, _ids array<string>, similarity double"))
    if not passes:
        types = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, case_id {case_type}, similarity_score double"
        return queries.sparkSession.createDataFrame([], types)
    found = reduce(DataFrame.union, passes)
    cases = found.select("_rep", "similarity", F.explode(F.col("_ids").cast(f"array<{case_type}>")).alias("case_id"))
    order = Window.partitionBy("_rep").orderBy(F.desc("similarity"), "case_id")
    best = cases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)
    # At most k + 1 entries a query.
    lists = best.groupBy("_rep").agg(F.array_sort(F.collect_list(F.struct("rank", "case_id", "similarity"))).alias("_found"))
    answers = cut_lineage(asked.join(lists, "_rep").select(F.xxhash64("embedding").alias("_vector"), F.col("embedding").alias("_same"), "_found"))
    joined = lookup_join(own.withColumn("_vector", F.xxhash64("embedding")), answers, "_vector", query_id, "inner").where("embedding = _same")
    others = F.filter("_found", lambda f: ~f["case_id"].eqNullSafe(F.col(query_id))) if exclude_self else F.col("_found")
    return joined.select(query_id, F.posexplode(F.slice(others, 1, k)).alias("_at", "_f")).select(
        query_id, (F.col("_at") + 1).alias("rank"), "_f.case_id", half_up(F.greatest(F.col("_f.similarity"), F.lit(0.0)), 4).alias("similarity_score")
    )
