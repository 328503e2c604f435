"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.session import checkpoint_dir

# The white space that separates words: blank, and tab to carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"

# A task works on slices of a batch with about so many bytes of text, so that its arrays stay
# small whatever the number of rows Spark puts into a batch.
SLICE_BYTES = 2_000_000

# Frames up to this number of rows and, as they are stored, of bytes may be sent to all executors.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20

# A batch of rows on its way to Python has about so many bytes.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Unlike ``checkpoint()`` this runs the last stage once, and the copy has a known size.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast when its counted rows are few and the files behind it are small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Let the session's batches for Python be small, unless they are already.

    A task holds a batch in the JVM and in Python, on its way in and out, beside the work itself.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(64 << 20))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``function`` for ``mapInArrow``, which gives its memory back at the end of a task.

    Workers are kept for other tasks, and so would what their allocators hold for reuse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once per row, also if ``body`` has lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that each slice has about ``size`` bytes of ``column``, one row at least."""
    values, start, held = batch.column(column), 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
    for row, length in enumerate(lengths):
        if held and held + length > size:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``group`` before a row.

    As in :func:`number_within`, a range sort puts a large group into many partitions, and the sums
    of a group's parts are added to the sums inside them.
    """
    keys = [*group, *order]
    placed = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "sorted"
    )
    parts = placed.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("_earlier", F.sum("_sum").over(earlier)).where("_earlier is not null").drop("_sum"), "part-sums")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (
        placed.withColumn("_inside", F.sum(value).over(inside))
        # Only groups that go on from one partition in the next have a row here.
        .join(if_small(parts, parts.count()), ["_part", *group], "left")
        .withColumn(name, F.coalesce("_earlier", zero) + F.coalesce("_inside", zero))
        .drop("_part", "_earlier", "_inside")
    )


def number_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each ``group``, without holding a group in one task.

    One range-partitioned sort puts a large group into many partitions. A row's number is its
    place in its partition plus the rows of its group before it; the table of these offsets has
    at most (partitions + groups) rows. Use it only where the number of groups is bounded.
    """
    keys = [group, *order]
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()),
        "numbered",
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy("_part", group)
        .agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
        .select("_part", group, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(runs), ["_part", group]).withColumn(
        name, F.col("_seq") - F.col("_first") + F.col("_before")
    ).drop("_part", "_seq", "_first", "_before")
