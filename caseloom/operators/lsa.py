"""Latent semantic embeddings: truncated SVD of the TF-IDF matrix."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.tfidf import TfidfModel, fit_tfidf
from caseloom.operators.words import lowered
from caseloom.session import checkpoint_dir, cut_lineage

# Rows of a matrix with a row per term are written in blocks of so many.
BLOCK_TERMS = 512
BLOCKS = pa.schema([("block", pa.int32()), ("rows", pa.binary())])
BLOCKS_DDL = "block int, rows binary"
# Sparse rows are taken in groups of about so many terms, and of so many rows at most. Each group costs a few
# microseconds for every term that it has, so it is large.
CHUNK = 1 << 22
GROUP_ROWS = 1 << 14
# Rows of a matrix that are gathered at a time; they stay in the processor's cache.
GATHERED = 256
# Directions that are weaker than the strongest by this factor are rounding errors.
NOTHING = 1e-10


@dataclass
class Basis:
    """A matrix with a row per term, which tasks read and the driver never holds.

    ``path`` is a table (block, rows) of blocks of float64 rows with ``width`` columns, in a folder that all
    executors share; a block of zeros may be missing. The matrix is these rows, times ``turn`` if there is
    one; that has a row and a column per component at most.
    """

    path: str
    n_terms: int
    width: int
    turn: np.ndarray | None = None

    def loader(self) -> Callable[[], np.ndarray]:
        """Reads the matrix; to be called in a task."""
        path, n_terms, width, turn = self.path, self.n_terms, self.width, self.turn
        return lambda: read_matrix(path, n_terms, width, turn)


def folder_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))


def read_matrix(path: str, n_terms: int, width: int, turn: np.ndarray | None) -> np.ndarray:
    system, root = folder_of(path)
    matrix = np.zeros((n_terms, width if turn is None else turn.shape[1]))
    for batch in dataset.dataset(root, BLOCKS, format="parquet", filesystem=system).to_batches(batch_size=16):
        for block, rows in zip(batch["block"].to_pylist(), batch["rows"]):
            part = np.frombuffer(rows.as_buffer(), dtype=float).reshape(-1, width)
            matrix[block * BLOCK_TERMS : block * BLOCK_TERMS + len(part)] = part if turn is None else part @ turn
    return matrix


def block_batch(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=BLOCKS)


def row_groups(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Slices of rows, and of their terms, with about ``CHUNK`` terms each; rows are not empty."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(lengths):
        last = max(int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1, first + 1)
        last = min(last, first + GROUP_ROWS)
        yield slice(first, last), slice(ends[first], ends[last])
        first = last


def _add_weighted(
    matrix: np.ndarray, rows: np.ndarray, weights: np.ndarray, starts: np.ndarray, targets: list[int], total: np.ndarray
) -> None:
    """Add the weighted sums of some rows of ``matrix`` to rows of ``total``.

    Run ``i`` of ``rows`` and ``weights``, from ``starts[i]`` on, goes to row ``targets[i]``. A run is a product of
    a vector with the few rows that are gathered for it, which is much faster than sums over one large table.
    """
    room = np.empty((GATHERED, matrix.shape[1]))
    ends = [*starts.tolist(), len(rows)]
    for i, target in enumerate(targets):
        for p in range(ends[i], ends[i + 1], GATHERED):
            q = min(p + GATHERED, ends[i + 1])
            gathered = np.take(matrix, rows[p:q], axis=0, out=room[: q - p], mode="clip")
            total[target] += weights[p:q] @ gathered


def rows_times(indices: np.ndarray, values: np.ndarray, lengths: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times ``matrix``; rows are not empty."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    products = np.zeros((len(lengths), matrix.shape[1]))
    _add_weighted(matrix, indices, values, starts, list(range(len(lengths))), products)
    return products


def add_transposed(
    indices: np.ndarray, values: np.ndarray, lengths: np.ndarray, products: np.ndarray, total: np.ndarray
) -> None:
    """Add the transposed sparse rows times ``products`` to ``total``, term by term."""
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(indices, kind="stable")
    terms, starts = np.unique(indices[order], return_index=True)
    _add_weighted(products, row_of[order], values[order], starts, terms.tolist(), total)


def sparse_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Indices, values, lengths and number of copies of the rows of a batch that have terms."""
    lengths = batch["indices"].value_lengths().to_numpy(zero_copy_only=False)
    some = lengths > 0
    copies = batch["n"].to_numpy(zero_copy_only=False).astype(float)
    flat = [batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values")]
    return *flat, lengths[some], copies[some]


def row_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`sparse_rows` of batches that together make a group or more."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        parts.append(sparse_rows(batch))
        if sum(len(p[0]) for p in parts) >= CHUNK or sum(len(p[2]) for p in parts) >= GROUP_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts = []
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def write_blocks(blocks: DataFrame, path: str) -> DataFrame:
    blocks.write.mode("overwrite").parquet(path)
    return blocks.sparkSession.read.schema(BLOCKS_DDL).parquet(path)


def drop_blocks(path: str) -> None:
    system, root = folder_of(path)
    system.delete_dir(root)


def _gram_times(features: DataFrame, load: Callable[[], np.ndarray], n_terms: int, path: str) -> DataFrame:
    """``X' X matrix`` for the rows ``(indices, values, n)`` of X, in one pass, as blocks at ``path``.

    A task adds up all its rows and passes on the blocks it met; those are summed per block.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = load()
        total = np.zeros_like(matrix)
        for indices, values, lengths, copies in row_tables(batches):
            for rows, terms in row_groups(lengths):
                group = indices[terms], values[terms], lengths[rows]
                products = rows_times(*group, matrix) * copies[rows, None]
                add_transposed(*group, products, total)
        for block in range(-(-n_terms // BLOCK_TERMS)):
            part = total[block * BLOCK_TERMS : (block + 1) * BLOCK_TERMS]
            if part.any():
                yield block_batch({block: part})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, rows in zip(batch["block"].to_pylist(), batch["rows"]):
                part = np.frombuffer(rows.as_buffer(), dtype=float)
                sums[block] = sums[block] + part if block in sums else part.copy()
        for block, part in sums.items():
            yield block_batch({block: part})

    parts = features.mapInArrow(add_up, BLOCKS_DDL)
    n = min(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_terms // BLOCK_TERMS))
    return write_blocks(parts.repartition(max(n, 1), "block").mapInArrow(combine, BLOCKS_DDL), path)


def _times(turn: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Multiplies blocks by ``turn``."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch["block"].to_pylist(), batch["rows"]):
                yield block_batch({block: np.frombuffer(rows.as_buffer(), dtype=float).reshape(-1, len(turn)) @ turn})

    return multiply


def _folded(pieces: DataFrame, width: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """All matrices of ``pieces`` (rows) joined to one of ``width`` columns and as many rows at most.

    They are joined in a tree: in each task, then in a few, then in one.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, width))
        for batch in batches:
            for rows in batch["rows"]:
                kept = join(kept, np.frombuffer(rows.as_buffer(), dtype=float).reshape(-1, width))
        yield pa.RecordBatch.from_pydict({"rows": pa.array([kept.tobytes()], pa.binary())})

    few = int(pieces.sparkSession.sparkContext.defaultParallelism**0.5)
    for n in (few, 1):
        pieces = pieces.mapInArrow(fold, "rows binary").repartition(n)
    return np.frombuffer(pieces.mapInArrow(fold, "rows binary").head()["rows"], dtype=float).reshape(-1, width)


def _stack(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([above, below]), mode="r")


def _add(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sum; a task without rows passes on a matrix without rows, on either side."""
    if len(left) and len(right):
        return left + right
    return left if len(left) else right


def _orthonormal(blocks: DataFrame, width: int) -> np.ndarray:
    """``turn`` that makes the columns of ``blocks`` orthonormal; fewer if they depend on each other.

    Tall-skinny QR: each block is reduced to its triangle, and triangles are stacked and reduced again. What
    the first pass leaves by rounding, the second takes away.
    """
    turn = np.eye(width)
    for _ in range(2):
        if turn.shape[1]:
            triangle = _folded(blocks.mapInArrow(_times(turn), BLOCKS_DDL).select("rows"), turn.shape[1], _stack)
            strengths, axes = np.linalg.svd(triangle, full_matrices=False)[1:]
            some = strengths > strengths.max(initial=0.0) * NOTHING
            turn = turn @ (axes[some].T / strengths[some])
    return turn


def singular_basis(
    features: DataFrame, n_terms: int, components: int, rounds: int = 5, extra: int = 10, seed: int = 42
) -> Basis:
    """Leading right singular vectors of the rows ``(indices, values, n)``, by randomised subspace iteration.

    ``n`` is the number of copies of a row. It takes ``rounds + 1`` passes over the data whatever the
    number of components, where a Lanczos solver needs a pass per vector and more. A task adds up
    terms x components numbers, and there are as many tasks as cores, so that not more than one such
    sum per core is shuffled. Only tables of components x components reach the driver.
    """
    spark = features.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/lsa-{uuid.uuid4().hex}"
    width = min(components + extra, n_terms)
    if width == 0:
        write_blocks(spark.createDataFrame([], BLOCKS_DDL), folder)
        return Basis(folder, n_terms, 0)
    rows = features.coalesce(spark.sparkContext.defaultParallelism)
    load = lambda: np.random.default_rng(seed).standard_normal((n_terms, width))
    basis, blocks = None, None
    for k in range(rounds):
        columns = basis.turn.shape[1] if basis else width
        blocks = _gram_times(rows, load, n_terms, f"{folder}/{k}")
        if basis:
            drop_blocks(basis.path)
        basis = Basis(f"{folder}/{k}", n_terms, columns, _orthonormal(blocks, columns))
        load = basis.loader()
    columns = basis.turn.shape[1]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = load()
        total = np.zeros((columns, columns))
        for indices, values, lengths, copies in row_tables(batches):
            for some, terms in row_groups(lengths):
                products = rows_times(indices[terms], values[terms], lengths[some], matrix)
                total += products.T @ (products * copies[some, None])
        yield pa.RecordBatch.from_pydict({"rows": pa.array([total.tobytes()], pa.binary())})

    best = np.zeros((0, 0))
    if columns:
        values, turn = np.linalg.eigh(_folded(rows.mapInArrow(squares, "rows binary"), columns, _add))
        order = np.argsort(values)[::-1][:components]
        best = turn[:, order[values[order] > max(values.max(), 0.0) * 1e-9]]
    write_blocks(blocks.mapInArrow(_times(basis.turn @ best), BLOCKS_DDL), f"{folder}/vectors")
    drop_blocks(basis.path)
    return Basis(f"{folder}/vectors", n_terms, best.shape[1])


def singular_vectors(features: DataFrame, n_terms: int, components: int, **settings: int) -> np.ndarray:
    """:func:`singular_basis` as one array, where that fits the caller."""
    counted = features if "n" in features.columns else features.withColumn("n", F.lit(1))
    return singular_basis(counted, n_terms, components, **settings).loader()()


@dataclass
class LsaModel:
    """TF-IDF vocabulary and the right singular vectors (terms x components).

    Both are bounded by ``max_features`` x ``components``, so they fit every task.
    """

    tfidf: TfidfModel
    basis: Basis

    def embed(
        self, docs: DataFrame, key: str, text: str = "text", normalise: bool = True
    ) -> DataFrame:
        """Add ``embedding`` (array of float) and ``n_known_terms``.

        A task reads the vectors from the shared folder once; nothing is broadcast.
        """
        load, make = self.basis.loader(), self.tfidf.weigher()

        @F.arrow_udf("struct<embedding: array<float>, n_known_terms: int>")
        def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            matrix, weigh = load(), make()
            for texts in batches:
                indices, values, lengths = weigh(texts)
                some = np.flatnonzero(lengths)
                out = np.zeros((len(lengths), matrix.shape[1]))
                for rows, terms in row_groups(lengths[some]):
                    out[some[rows]] = rows_times(indices[terms], values[terms], lengths[some[rows]], matrix)
                if normalise:
                    sizes = np.linalg.norm(out, axis=1, keepdims=True)
                    out /= np.where(sizes > 0, sizes, 1e-10)
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * np.int32(out.shape[1]))
                vectors = pa.ListArray.from_arrays(ends, pa.array(out.astype(np.float32).reshape(-1)))
                yield pa.StructArray.from_arrays([vectors, pa.array(lengths.astype(np.int32))], ["embedding", "n_known_terms"])

        return (
            docs.withColumn("_v", project(lowered(text)))
            .withColumns({"n_known_terms": F.col("_v.n_known_terms"), "embedding": F.col("_v.embedding")})
            .drop("_v")
        )

    def save(self, path: str, spark: SparkSession) -> None:
        self.tfidf.save(f"{path}/terms")
        write_blocks(spark.read.schema(BLOCKS_DDL).parquet(self.basis.path), f"{path}/components")
        shape = spark.createDataFrame([(self.basis.n_terms, self.basis.width)], "n_terms INT, width INT")
        shape.write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LsaModel:
        shape = spark.read.parquet(f"{path}/shape").head()
        # The full address of the folder, whatever the default file system is.
        files = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/components").inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else f"{path}/components"
        return cls(TfidfModel.load(spark, f"{path}/terms"), Basis(folder, shape["n_terms"], shape["width"]))


def fit_lsa(
    docs: DataFrame,
    key: str,
    text: str = "text",
    components: int = 300,
    min_df: int = 2,
    max_features: int = 35_000,
    tfidf: TfidfModel | None = None,
) -> LsaModel:
    """Fit on the uncentred TF-IDF matrix. Equal texts are taken as one row with their number.

    A vocabulary that was counted before can be given as ``tfidf``.
    """
    tfidf = tfidf or fit_tfidf(docs, key, text, min_df, max_features)
    copies = docs.groupBy(F.coalesce(F.col(text), F.lit("")).alias(text)).agg(F.count("*").alias("n"))
    # Written down once, since every pass reads it.
    features = cut_lineage(tfidf.transform(copies, text, text).select("indices", "values", "n"))
    return LsaModel(tfidf, singular_basis(features, tfidf.size, components))
