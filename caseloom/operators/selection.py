"""The row at a given place of an order, found by narrowing ranges instead of sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, ByteType, DataType, DateType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType,
)

# So many rows are ranked in one task.
SMALL = 100_000
# A pass counts at most 2^12 ranges of numbers, or the next two bytes of texts.
RANGE_BITS = 12
PREFIX_BYTES = 2


def _comparable(column: str, kind: DataType) -> Column | None:
    """The column as whole numbers or bytes of the same order; None for other types."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.col(column).cast("bigint")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, TimestampNTZType):
        # As if it were in UTC, which keeps the order in every time zone of the session.
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp"))
    if isinstance(kind, StringType):
        return F.encode(column, "UTF-8")
    return F.col(column) if isinstance(kind, BinaryType) else None


def _shared_start(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def row_at(rows: DataFrame, columns: list[str], place: int, n_rows: int) -> Column:
    """Scalar struct of the row at the 1-based ``place`` by ``columns``, nulls first; null if there is none.

    The range that holds the place is narrowed, one column after the other, until it has few
    rows: a pass counts the rows per sub-range, combined in the tasks, so that only counts are
    shuffled and only they reach the driver. Only the last ``SMALL`` rows are ranked. ``rows`` should be a
    written table, as it is read several times. Columns are whole numbers, dates, times, texts or
    bytes; others are taken only where few rows are equal in the columns before them.
    """
    wanted = F.struct(*columns)
    if not 1 <= place <= n_rows:
        return rows.limit(0).agg(F.max(wanted)).scalar()
    for column in columns:
        value = _comparable(column, rows.schema[column].dataType)
        while n_rows > SMALL:
            if value is None:
                raise TypeError(f"{n_rows} rows are equal up to {column}, whose type has no ranges")
            n_null, least, most = rows.agg(F.count_if(value.isNull()), F.min(value), F.max(value)).head()
            if place <= n_null:
                rows, n_rows = rows.where(value.isNull()), n_null
                break
            if n_null:
                rows, place, n_rows = rows.where(value.isNotNull()), place - n_null, n_rows - n_null
                continue
            if least == most:
                break
            if isinstance(least, int):
                shift = max((most - least).bit_length() - RANGE_BITS, 0)
                cell = F.shiftright(value, shift)
            else:
                cell = F.substring(value, 1, _shared_start(bytes(least), bytes(most)) + PREFIX_BYTES)
            counts = rows.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect()
            for found, n_rows in sorted((c if isinstance(c, int) else bytes(c), n) for c, n in counts):
                if place <= n_rows:
                    break
                place -= n_rows
            rows = rows.where(cell == F.lit(found))
        if n_rows <= SMALL:
            return rows.agg(F.element_at(F.array_sort(F.collect_list(wanted)), int(place))).scalar()
    # All that is left is equal.
    return rows.agg(F.max(wanted)).scalar()
