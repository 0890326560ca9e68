"""Reliable checkpoints: the one way a plan is cut here.

The folder is the cluster's (`spark.checkpoint.dir`), so a lost executor loses nothing. Only a
local session without that setting gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a table that may be broadcast.
FEW_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set up on first use in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="broadsheet-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once; later uses all see the same rows in the same partitions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checked(df: DataFrame, row_bytes: int, most_bytes: int = FEW_BYTES) -> DataFrame:
    """`df`, whose rows take about so many bytes, marked for broadcast if all of it is at most
    `most_bytes`; else as it is. Counting it is a job."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def local_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows that the driver holds, as a relation of the plan."""
    fields = T.StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=fields.names), fields)
