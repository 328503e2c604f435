"""Readers. Schemas are declared, so no file is scanned to infer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.constants import OTHER
from caseloom.functions.text import strip
from caseloom.session import cut_and_count

# Holds the text of a JSON line that cannot be parsed, else null.
CORRUPT = "corrupt_record"


def _strings_to_null(df: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in texts})


def read_tweets_csv(spark: SparkSession, path: str, null_tokens: tuple[str, ...] = ("",)) -> DataFrame:
    """Message table from CSV. Texts hold line breaks, hence ``multiLine``.

    Pass the many spellings of a missing value as ``null_tokens`` where the data has them; by
    default only the empty string is missing, since "null" can be what a customer wrote.
    """
    reader = (
        spark.read.schema(schemas.TWEETS)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
    )
    return _strings_to_null(reader.csv(path), null_tokens)


def read_tweets_head(spark: SparkSession, path: str, n: int, null_tokens: tuple[str, ...] = ("",)) -> DataFrame:
    """The first ``n`` rows in file order: files by path, rows as they stand in them.

    Files are read one after the other until there are enough rows, and of each only as much as is
    needed; what comes later is never read. The files' paths alone are listed for it.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    found, missing, last = None, n, ""
    while missing > 0:
        head = listed.where(F.col("path") > last).orderBy("path").select("path").first()
        if head is None:
            break
        last = head["path"]
        # A text may hold line breaks, so a file is one partition and its rows come in order.
        rows, count = cut_and_count(read_tweets_csv(spark, last, null_tokens).limit(missing))
        found = rows if found is None else found.union(rows)
        missing -= count
    return spark.createDataFrame([], schemas.TWEETS) if found is None else found


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``ordinal``, which sorts rows as they stand in their files."""
    return df.withColumn(
        "ordinal",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def head_rows(df: DataFrame, n: int, order: str | list[str] = "ordinal", where: Column | None = None) -> DataFrame:
    """The first ``n`` rows that qualify, as one top-n step instead of a full sort."""
    qualified = df if where is None else df.where(where)
    keys = [order] if isinstance(order, str) else order
    return qualified.orderBy(*keys).limit(n)


def has_text(*columns: str) -> Column:
    """True where every column has more than white space."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & (strip(F.coalesce(c, F.lit(""))) != "")
    return cond


def of_known_intent(intent: str = "intent") -> Column:
    return F.coalesce(F.col(intent) != OTHER, F.lit(True))


def read_labelled_json(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Labelled conversations from JSON lines, one row per line; blank lines are skipped.

    A line that is no JSON object gives a row of nulls with its text in ``corrupt_record``. ``strict``
    fails on such a line and on a row without message or intent, whatever columns are selected.
    """
    df = (
        spark.read.schema(f"{schemas.LABELLED}, {CORRUPT} STRING")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    if not strict:
        return df
    missing = F.col("customer_message").isNull() | F.col("intent").isNull()
    name = F.coalesce("conversation_id", F.lit("a row without id"))
    # A filter stays in the plan when columns are pruned.
    sound = (
        F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("corrupt line: "), CORRUPT)).cast("boolean"))
        .when(missing, F.raise_error(F.concat(F.lit("missing message or intent in "), name)).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return df.where(sound)


def read_requests(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Support requests from JSON lines, as a table or as a stream."""
    if not stream:
        return spark.read.schema(schemas.REQUEST).json(path)
    reader = spark.readStream.schema(schemas.REQUEST)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)
