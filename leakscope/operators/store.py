"""A stored table of the latest finding of each id, kept up to date by batches of a stream.

A merge writes the batch's own rows as a delta and then a commit, so its cost is that of the batch.  After
``compact_after`` deltas, they are folded into the base, which is bucketed by finding id: the join of the base with the
deltas shuffles the deltas alone.  The commit with the highest number is the pointer to the current version; it
names the base, the deltas and the last batch of each writer, so a batch that comes again changes nothing, and
files without a commit are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .findings import LATEST_ORDER, check_positive

COMMIT = "number long, base string, deltas array<string>, buckets int, batches map<string,long>"


class FindingStore:
    """Latest findings below ``path``, which all executors reach; one process writes, any number read."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 32, compact_after: int = 8, order: Sequence[str] = LATEST_ORDER):
        self.spark, self.path, self.order = spark, path.rstrip("/"), tuple(order)
        self.buckets, self.compact_after = check_positive("buckets", buckets), check_positive("compact_after", compact_after)

    # --- versions

    def _folder(self, path: str):
        """The store's file system and a path of it."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def commit(self) -> dict | None:
        """The current version, None if there is none."""
        system, place = self._folder(f"{self.path}/commits")
        if not system.exists(place):
            return None
        names = sorted((f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()), reverse=True)
        for name in names:  # an unfinished commit has no mark
            if system.exists(self._folder(f"{self.path}/commits/{name}/_SUCCESS")[1]):
                return self.spark.read.schema(COMMIT).json(f"{self.path}/commits/{name}").first().asDict()
        return None

    def _commit(self, last: dict | None, **changes) -> None:
        row = {"number": 0, "base": None, "deltas": [], "buckets": self.buckets, "batches": {}} | (last or {}) | changes
        row["number"] = (last["number"] if last else 0) + 1
        rows = self.spark.createDataFrame([row], COMMIT)
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{row['number']:012d}")

    # --- rows

    def _fold(self, rows: DataFrame) -> DataFrame:
        """One row an id, the last write wins, occurrences added up."""
        cols = [c for c in rows.columns if c not in ("finding_id", "occurrence_count")]
        folded = rows.groupBy("finding_id").agg(
            F.max_by(F.struct(*cols), F.struct(*self.order)).alias("_row"), F.sum("occurrence_count").alias("occurrence_count")
        )
        return folded.select("finding_id", *[F.col("_row")[c].alias(c) for c in cols], "occurrence_count")

    def _base(self, name: str, schema: StructType, buckets: int) -> DataFrame:
        """The base as a bucketed table; its entry in the catalog is needed for the name's resolution only."""
        table = f"leakscope_base_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (finding_id) SORTED BY (finding_id) INTO {buckets} BUCKETS LOCATION '{self.path}/rows/{name}'"
        )
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def read(self) -> DataFrame | None:
        """The latest finding of each id with its ``occurrence_count``; None before the first commit."""
        last = self.commit()
        return None if last is None else self._rows(last)

    def _rows(self, last: dict) -> DataFrame:
        deltas = [self.spark.read.parquet(f"{self.path}/rows/{d}") for d in last["deltas"]]
        new = None
        if deltas:
            schema, new = deltas[0].schema, deltas[0]
            for d in deltas[1:]:
                new = new.unionByName(d)
            new = self._fold(new.repartition(last["buckets"], "finding_id"))
        if last["base"] is None:
            return new
        if new is None:
            schema = self.spark.read.parquet(f"{self.path}/rows/{last['base']}").schema
        base = self._base(last["base"], schema, last["buckets"])
        return base if new is None else self._newer(base, new)

    def _newer(self, base: DataFrame, new: DataFrame) -> DataFrame:
        cols = [c for c in base.columns if c not in ("finding_id", "occurrence_count")]
        b = base.select("finding_id", F.struct(*cols).alias("_b"), F.col("occurrence_count").alias("_nb"))
        n = new.select("finding_id", F.struct(*cols).alias("_n"), F.col("occurrence_count").alias("_nn"))

        def at(side: str) -> Column:
            return F.struct(*[F.col(side)[c] for c in self.order])

        row = F.when(F.col("_n").isNull() | (F.col("_b").isNotNull() & (at("_b") > at("_n"))), F.col("_b")).otherwise(F.col("_n"))
        both = b.join(n, "finding_id", "full").select("finding_id", row.alias("_row"), (F.coalesce("_nb", F.lit(0)) + F.coalesce("_nn", F.lit(0))).alias("occurrence_count"))
        return both.select("finding_id", *[F.col("_row")[c].alias(c) for c in cols], "occurrence_count")

    # --- writing

    def merge(self, findings: DataFrame, batch: int, *, writer: str = "default") -> bool:
        """Upsert a batch; False if this writer's batch, or a later one, is in the store already.

        A later write, by time and then the other columns of the order, replaces an earlier one of its id, whatever the order in which
        they arrive.  Findings without an id are left out.  Batch numbers are those of one stream's checkpoint: another stream is another ``writer``.
        """
        last = self.commit()
        if last and batch <= last["batches"].get(writer, -1):
            return False
        rows = findings.where("finding_id is not null").withColumn("occurrence_count", F.lit(1).cast("long"))
        name = f"delta-{uuid.uuid4().hex}"
        self._fold(rows).write.parquet(f"{self.path}/rows/{name}")
        self._commit(last, deltas=[*(last["deltas"] if last else []), name], batches={**(last["batches"] if last else {}), writer: batch})
        if last and len(last["deltas"]) + 1 >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold all deltas into a new base.  Readers of the version before go on until ``vacuum``."""
        last = self.commit()
        if last is None or not last["deltas"]:
            return
        name, table = f"base-{uuid.uuid4().hex}", f"leakscope_new_{uuid.uuid4().hex}"
        rows = self._rows(last)
        rows.write.bucketBy(last["buckets"], "finding_id").sortBy("finding_id").option("path", f"{self.path}/rows/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        self._commit(last, base=name, deltas=[])

    def vacuum(self) -> int:
        """Delete what the current version does not name; the number of folders deleted.  No merge and no reader of an older version may run."""
        last, gone = self.commit(), 0
        if last is None:
            return 0
        system, place = self._folder(f"{self.path}/rows")
        kept = {last["base"], *last["deltas"]}
        commits = self._folder(f"{self.path}/commits")[1]
        old = [f.getPath() for f in system.listStatus(place) if f.getPath().getName() not in kept]
        old += [f.getPath() for f in system.listStatus(commits) if f.getPath().getName() < f"{last['number']:012d}"]
        for p in old:
            gone += bool(system.delete(p, True))
        return gone


def upsert_stream(findings: DataFrame, store: FindingStore, checkpoint: str, *, writer: str = "default", catch_up: bool = True) -> StreamingQuery:
    """Merge each batch of a stream of findings into the store; a batch that is run again after a failure is merged once."""

    def save(batch: DataFrame, number: int) -> None:
        store.merge(batch, number, writer=writer)

    stream = findings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (stream.trigger(availableNow=True) if catch_up else stream.trigger(processingTime="10 seconds")).start()
