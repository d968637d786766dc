"""Session helpers: the folder shared by all executors, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="leakscope-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, in the session's checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count shows that it is small; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, bytes_per_core: int = 64 * 1024 * 1024) -> DataFrame:
    """Deal out a small input over all cores before heavy work on its texts.

    A table smaller than ``bytes_per_core`` for each core often comes in fewer row
    groups than there are cores.  A larger one keeps its own partitions.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < bytes_per_core * cores else df


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table as part of the plan, so that reading it starts no job.

    ``schema`` is like ``"name string, n int"``.
    """
    fields = [f.split() for f in schema.split(",")]
    columns = [pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[n for n, _ in fields]))
