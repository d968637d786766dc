"""Sinks.  Every writer leaves one file per task; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import severity_summary
from ..operators.graph import merge_tables

MAX_OBJECT_ROWS = 100_000
STORE_TABLES = (
    "findings", "endpoints", "cwe_entries", "finding_cwe_map", "owasp_categories", "cwe_owasp_map", "mitigations",
)


def write_findings(findings: DataFrame, path: str, *, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Findings partitioned by severity, so a severity filter prunes files."""
    findings.write.mode(mode).partitionBy("severity").format(fmt).save(path)


def write_ndjson(rows: DataFrame, path: str, *, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def write_report(findings: DataFrame, path: str, *, target: str, mode: str = "overwrite") -> None:
    """A report folder that ``read_report`` reads: ``findings``, one JSON object a line, and ``summary``.

    The summary is one object with time, target, counts per source (``stats``) and per severity.  It is made
    from the counts alone, of which there are as many as sources and severities.
    """
    rows = findings.withColumnRenamed("finding_id", "id") if "id" not in findings.columns else findings
    rows.write.mode(mode).json(f"{path.rstrip('/')}/findings")
    severities = severity_summary(findings).select(F.lit("severity").alias("kind"), F.col("severity").alias("name"), "n")
    sources = findings.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("kind"), F.coalesce("source", F.lit("")).alias("name"), "n")
    counts = severities.unionByName(sources)

    def counted(kind: str):
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n")))))

    summary = counts.agg(counted("source").alias("stats"), counted("severity").alias("severities")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(target).alias("target"), "stats", "severities"
    )
    summary.write.mode(mode).json(f"{path.rstrip('/')}/summary")


def write_report_object(findings: DataFrame, path: str, *, target: str, max_rows: int = MAX_OBJECT_ROWS) -> None:
    """A report as one JSON object, for small results.  More than ``max_rows`` is refused."""
    if findings.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} findings; use write_report, which writes a folder")
    # Counts per severity come from the rows of the one object, which is small by the check above.
    report = findings.agg(F.collect_list(F.struct("*")).alias("findings")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(target).alias("target"), "findings"
    )
    report.coalesce(1).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Node and edge tables, partitioned by label."""
    nodes.write.mode(mode).partitionBy("label").parquet(f"{path.rstrip('/')}/nodes")
    edges.write.mode(mode).partitionBy("label").parquet(f"{path.rstrip('/')}/edges")


def write_store(tables: dict[str, DataFrame], path: str, *, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if name == "findings":
            writer = writer.partitionBy("severity")
        writer.parquet(f"{path.rstrip('/')}/{name}")


def merge_store(tables: dict[str, DataFrame], path: str, into: str) -> None:
    """The store at ``path`` with ``tables`` upserted, written to ``into``: a lost job leaves the old store whole."""
    from .readers import read_store

    spark = tables["findings"].sparkSession
    write_store(merge_tables(read_store(spark, path), tables), into, mode="errorifexists")


def write_vectors(vectors: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    vectors.write.mode(mode).parquet(path)
