"""Structured Streaming over the traffic log and over captured exchanges.

Detectors are the batch functions; this module adds state and sinks.  Checkpoints
and results belong in a folder that all executors reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extras, traffic


def with_event_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds(ts))


def stage_counts(log: DataFrame) -> DataFrame:
    """Running count per stage; the state is one row per stage."""
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def severity_windows(log: DataFrame, *, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts per severity; a window is final when the watermark passes it."""
    findings = with_event_time(traffic.split_log(log)).withWatermark("event_time", delay)
    return extras.severity_windows(findings, width=width)


def with_open_windows(closed: DataFrame, log: DataFrame, *, width: str = "1 minute") -> DataFrame:
    """Windows that the stream has closed, and the counts so far of those still open, from the log of a catch-up run."""
    end = closed.agg(F.max(F.col("window_start") + F.expr(f"interval {width}"))).first()[0]
    rest = with_event_time(traffic.split_log(log))
    if end is not None:
        rest = rest.where(F.col("event_time") >= F.lit(end))
    return closed.unionByName(extras.severity_windows(rest, width=width).select(*closed.columns))


def distinct_findings(findings: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """The first finding of each id while its watermark state lives."""
    timed = with_event_time(findings).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["finding_id"])


def pair_exchanges(requests: DataFrame, responses: DataFrame, *, within: str = "5 minutes", delay: str = "10 minutes", unanswered: bool = False) -> DataFrame:
    """Requests with their responses, as each arrives, from two streams or two tables.

    ``requests`` and ``responses`` have ``exchange_id`` and ``event_time``.  A response belongs to a request of its id if it
    comes no earlier and at most ``within`` later.  Both sides have a watermark of ``delay``, so a request
    is kept for ``within`` and ``delay`` and a response for ``delay``, however long the stream runs.  With ``unanswered``, requests without a
    response come too, once none can follow.
    """
    left = requests.withWatermark("event_time", delay)
    right = responses.withColumnRenamed("event_time", "response_time").withColumnRenamed("exchange_id", "response_id").withWatermark("response_time", delay)
    matched = F.expr(f"exchange_id = response_id AND response_time >= event_time AND response_time <= event_time + interval {within}")
    return left.join(right, matched, "left_outer" if unanswered else "inner").drop("response_id")


def client_sessions(log: DataFrame, by: Sequence[str], *, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each key: rows at most ``gap`` apart; ``session_start, session_end`` (of the last row), ``n``.

    A session comes out when the watermark has passed its end by ``gap``; works on tables and streams.
    """
    timed = log.withWatermark("event_time", delay)
    found = timed.groupBy(*by, F.session_window("event_time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("session_end"))
    return found.select(*by, F.col("w.start").alias("session_start"), "session_end", "n")


def sliding_counts(log: DataFrame, by: Sequence[str], *, width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of each key in windows of ``width`` that begin every ``slide``; a window is final when the watermark passes it."""
    timed = log.withWatermark("event_time", delay)
    found = timed.groupBy(*by, F.window("event_time", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*by, F.col("w.start").alias("window_start"), "n")


def keep_late(stream: DataFrame, path: str, checkpoint: str, *, delay: str = "10 minutes", catch_up: bool = True) -> StreamingQuery:
    """Write rows in time to ``path/rows`` and late ones to ``path/late``, by batch, instead of losing the late ones without a word.

    A row is late if it lies more than ``delay`` before the latest time of the batches before its own.  That time is kept beside
    the rows (``path/seen``), and a batch that is run again replaces itself.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("latest timestamp").parquet(f"{path}/seen/batch={number - 1}").first()["latest"] if number > 0 else None
        late = F.lit(False) if seen is None else F.coalesce(F.col("event_time") < F.lit(seen) - F.expr(f"interval {delay}"), F.lit(False))
        marked = batch.withColumn("_late", late).persist()
        try:
            for name, test in (("rows", "not _late"), ("late", "_late")):
                marked.where(test).drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            latest = marked.agg(F.greatest(F.max("event_time"), F.lit(seen).cast("timestamp")).alias("latest"))
            latest.coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        finally:
            marked.unpersist()

    return _start(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save), catch_up)


def append_to(stream: DataFrame, path: str, checkpoint: str, *, catch_up: bool = True) -> StreamingQuery:
    """Append results to a parquet folder; ``catch_up`` stops at the end of the input."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _start(writer.option("path", path), catch_up)


def replace_at(stream: DataFrame, path: str, checkpoint: str, *, catch_up: bool = True) -> StreamingQuery:
    """Write the whole state after each batch, for small aggregates.

    Each batch goes to its own folder ``batch=N``, so a batch that is run again
    replaces itself; the folder with the highest number is current, the one before stays for its readers.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _drop(batch.sparkSession, f"{path}/batch={number - 2}")

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save)
    return _start(writer, catch_up)


def update_at(stream: DataFrame, path: str, checkpoint: str, *, catch_up: bool = True) -> StreamingQuery:
    """Write the groups that each batch changes, with their counts so far, to a folder of its own; see ``updated``.

    So open windows can be read at any time, and only the stream reads the log.  A batch that is run again replaces itself.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save), catch_up)


def updated(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each group that ``update_at`` wrote; one partial aggregate."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("last"))
    return last.select(*keys, "last.*")


def current(spark, path: str) -> DataFrame:
    """The state written last by :func:`replace_at`."""
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch").alias("batch"))
    return batches.join(F.broadcast(last), "batch").drop("batch")


def tail(stream: DataFrame, path: str, checkpoint: str, n: int = 200, *, catch_up: bool = True) -> StreamingQuery:
    """Keep the newest ``n`` log entries, ties by url and stage: each batch merges with what was kept before."""

    def save(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            spark = batch.sparkSession
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}"))
        rows.orderBy(F.col("ts").desc(), F.col("url").desc(), F.col("stage").desc()).limit(n).write.mode("overwrite").parquet(f"{path}/batch={number}")
        _drop(batch.sparkSession, f"{path}/batch={number - 2}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return _start(writer, catch_up)


def _drop(spark, path: str) -> None:
    """Delete a folder, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _start(writer, catch_up: bool) -> StreamingQuery:
    writer = writer.trigger(availableNow=True) if catch_up else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
