"""Session settings and the cutting of lineage."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="caseloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that a lost executor costs one stage only."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut_lineage`, with the number of rows (that meet ``where``) from the same job."""
    checkpoint_dir(df.sparkSession)
    seen = Observation()
    counter = F.count(F.lit(1)) if where is None else F.count_if(where)
    done = df.observe(seen, counter.alias("n")).checkpoint(eager=True)
    return done, int(seen.get["n"])


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table, which the optimizer sees as a local relation of known size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))


def spread_by_key(df: DataFrame, key: str) -> DataFrame:
    """Partition by ``key`` for work that is heavy per byte.

    The number of partitions is given, so that adaptive execution, which goes by bytes, does
    not fold them together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, F.col(key))
