import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import caseloom  # noqa: E402

cloudpickle.register_pickle_by_value(caseloom)


@pytest.fixture
def frame(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(rows, schema="doc_id bigint, text string"):
        names = [part.split()[0] for part in schema.split(",")]
        df = spark.createDataFrame([tuple(r) for r in rows], schema)
        clashing = {"shard", "slot", "score", "kept", "_id", "_key", "_text", "component_id", "n_tokens", "_row"} - set(names)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("other") for c in sorted(clashing)})

    return build
