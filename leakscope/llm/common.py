"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows of a few numbers that may be broadcast: some 50 MB.
SENT_ROWS = 1 << 20
#: Bytes of an Arrow batch.
BATCH = 4 << 20


def ship(module: str) -> None:
    """Send the functions of a module to the executors by value: they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` bytes, as texts may be long: bounds what a task holds on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides, whatever Spark takes for their sizes.

    Spark sizes an exploded table like the one before the explode, and a stored one by its compressed files, and would
    send it through the driver if that is below its threshold.
    """
    return df.hint("merge")


def sent(df: DataFrame) -> DataFrame:
    """A stored table of few columns, sent to all executors if it has at most ``SENT_ROWS`` rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else dealt(df)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
