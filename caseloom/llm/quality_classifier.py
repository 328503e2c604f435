"""Quality scores from compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is built from blocks of good labelled texts, one from bad ones. A text is
cut into blocks that are compressed with either; the difference of the two sums, over their sum, is
the evidence, and a logistic curve fitted on other labelled texts makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caseloom.llm.common import slices, tidy

# Bounds of the labelled sample, chosen by the hash of the id from all labelled rows.
DICTIONARY_DOCS = 800
DICTIONARY_BLOCKS = 1200
CALIBRATION_DOCS = 12_000
BLOCK = 2048
DICTIONARY_BYTES = 112_640
LEVEL = 3


@dataclass
class CompressionModel:
    """Two dictionaries and the curve ``1 / (1 + exp(-(slope * x + offset)))``."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0


def dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary from ``blocks``; the first ``DICTIONARY_BYTES`` of them if they are too few to train one.

    A dictionary of under 8 bytes is none: :func:`compressor` then works without.
    """
    blocks = [b for b in blocks if b]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[:DICTIONARY_BYTES]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_dict_id=False)


def evidence(docs: DataFrame, columns: list[str], model: CompressionModel, text: str = "text") -> DataFrame:
    """``columns`` and ``evidence`` from -1 (bad) to 1 (good) for whole texts; 0 for no text."""
    fields = list(docs.select(*columns).schema)
    schema = StructType([*fields, StructField("evidence", DoubleType())])
    good, bad = model.good, model.bad

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_good, with_bad = compressor(good), compressor(bad)
        for batch in batches:
            for part in slices(batch, "_text"):
                values = []
                for content in part.column("_text").to_pylist():
                    a = b = 0
                    for start in range(0, len(content or b""), BLOCK):
                        block = content[start : start + BLOCK]
                        a += len(with_good.compress(block))
                        b += len(with_bad.compress(block))
                    values.append((b - a) / (a + b) if a + b else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields] + [pa.array(values, pa.float64())],
                    [f.name for f in fields] + ["evidence"],
                )

    return docs.select(*columns, F.col(text).cast("binary").alias("_text")).mapInArrow(tidy(weigh), schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method on standardised ``x``."""
    if not len(x):
        return 0.0, 0.0
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + ridge * weights
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1] - weights[0] * mean / scale)


def blocks_of(text: str) -> Column:
    """All blocks of a text, ``BLOCK`` characters each."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(BLOCK))
    return F.explode(F.transform(starts, lambda s: F.substr(F.col(text), s, F.lit(BLOCK))))


def fit_compression_model(
    docs: DataFrame, labels: DataFrame, learn: Column, dictionary_docs: int = DICTIONARY_DOCS,
    dictionary_blocks: int = DICTIONARY_BLOCKS, calibration_docs: int = CALIBRATION_DOCS,
) -> CompressionModel:
    """Learn from the rows of ``labels`` (doc_id, quality) that meet ``learn``.

    At most ``dictionary_docs`` documents a class give blocks for the dictionaries, of which at most
    ``dictionary_blocks`` of ``BLOCK`` characters each are taken, since a document may be of any length;
    at most ``calibration_docs`` others give the curve. All sets are the smallest by a hash. Several
    labels of one document count as the lowest, several texts of one as the least evidence. Without
    any label every score is 0.5.
    """
    known = (
        labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .select(F.col("doc_id").alias("_id"), "_quality", F.xxhash64("doc_id", F.lit("sample")).alias("_order"))
    )
    for_dictionary = F.pmod(F.xxhash64("_id", F.lit("role")), F.lit(3)) == 0
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def samples(quality: int) -> list[bytes]:
        chosen = known.where(for_dictionary & (F.col("_quality") == quality)).orderBy("_order", "_id").limit(dictionary_docs)
        cut = texts.join(F.broadcast(chosen), "_id").select("_id", blocks_of("_text").alias("_block"))
        rows = cut.orderBy(F.xxhash64("_id", "_block"), "_id", "_block").limit(dictionary_blocks).collect()
        return [r["_block"].encode("utf-8", "surrogatepass") for r in rows]

    model = CompressionModel(dictionary(samples(1)), dictionary(samples(0)))
    chosen = known.where(~for_dictionary).orderBy("_order", "_id").limit(calibration_docs)
    rows = (
        evidence(texts.join(F.broadcast(chosen), "_id"), ["_id", "_order", "_quality"], model, "_text")
        .groupBy("_order", "_id").agg(F.min("evidence").alias("evidence"), F.min("_quality").alias("_quality"))
        .orderBy("_order", "_id").collect()
    )
    model.slope, model.offset = logistic(
        np.array([r["evidence"] for r in rows]), np.array([float(r["_quality"]) for r in rows])
    )
    return model


def score_quality(docs: DataFrame, columns: list[str], model: CompressionModel) -> DataFrame:
    """``columns`` and ``score``, the probability of label 1, for the whole text of every row.

    Null and empty texts get the score of no evidence. Rows repeat as in the input; columns that
    are not named are left out. An empty table gives an empty result.
    """
    weighed = evidence(docs, columns, model)
    line = F.lit(model.slope) * F.col("evidence") + F.lit(model.offset)
    return weighed.select(*columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-line))).alias("score"))
