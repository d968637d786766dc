"""Readers: reports, traffic logs, text files, browser snapshots, exchanges, diffs, stored tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V

REPORT_FINDING = (
    "id string, type string, severity string, source string, summary string, description string, "
    "snippet string, pattern string, url string, method string, client string, header string, "
    "field string, commit string, path string, location string, key string, original_length int, "
    "status int, timestamp bigint, ts bigint, timestamp_human string, metadata map<string,string>"
)
REPORT = (
    "timestamp string, target string, stats map<string,bigint>, severities map<string,bigint>, "
    f"findings array<struct<{REPORT_FINDING.replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint').replace(' map', ':map')}>>"
)
TRAFFIC_LOG = (
    "ts bigint, timestamp string, stage string, client string, method string, url string, severity string, "
    "type string, pattern string, description string, field string, header string, snippet string, original_length int"
)
BROWSER_STATE = (
    "localStorage map<string,string>, sessionStorage map<string,string>, "
    "cookies array<struct<name:string,secure:boolean,httpOnly:boolean>>, globals map<string,string>, error string"
)
EXCHANGE = (
    "ts bigint, client string, method string, url string, req_headers map<string,string>, req_body string, "
    "status int, resp_headers map<string,string>, resp_body string"
)
CAPTURED = EXCHANGE + ", set_cookies array<string>"
CORRUPT = "_corrupt_record"
NUL_WINDOW = 4096


class ReportError(ValueError):
    """A report that cannot be used: empty, not JSON, or without findings."""


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of audit reports: a folder of ``write_report``, or JSON objects with a ``findings`` list.

    Raises FileNotFoundError for a missing path and ReportError for an empty
    file, broken JSON or an object without ``findings``; an empty list only warns.
    """
    lines = spark.read.schema(f"{REPORT_FINDING}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    try:
        rows = lines.json(f"{path.rstrip('/')}/findings")
    except AnalysisException:  # not a folder of write_report
        pass
    else:
        # A broken line fails the job that meets it: the findings are not read twice for the test.
        broken = F.concat(F.lit(f"report is not valid JSON: {path}: "), F.substring(CORRUPT, 1, 80))
        return rows.where(F.when(F.col(CORRUPT).isNull(), True).otherwise(F.raise_error(broken).cast("boolean"))).drop(CORRUPT)
    reader = spark.read.schema(f"{REPORT}, {CORRUPT} string").option("multiLine", True)
    try:
        reports = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no report at {path}") from e
    state = reports.select(CORRUPT, F.size("findings").alias("n"), F.col("findings").isNull().alias("none")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count(CORRUPT).alias("broken"),
        F.count_if("none").alias("without"),
        F.sum(F.greatest("n", F.lit(0))).alias("findings"),
    ).first()
    if state.files == 0:
        raise ReportError(f"report is empty: {path}")
    if state.broken:
        raise ReportError(f"report is not valid JSON: {path}")
    if state.without:
        raise ReportError(f"report has no findings list: {path}")
    if not state.findings:
        warnings.warn(f"report has no findings: {path}")
    return reports.select(F.inline("findings"))


def read_report_summary(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp, target, stats, severities`` of a folder of ``write_report``."""
    return spark.read.schema(REPORT.split(", findings array")[0]).json(f"{path.rstrip('/')}/summary")


def _valid_lines(df: DataFrame) -> DataFrame:
    """Rows of NDJSON that parsed; malformed lines are skipped."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_traffic_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only NDJSON log; blank and malformed lines are skipped, no file is an empty log."""
    reader = spark.read.schema(f"{TRAFFIC_LOG}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    try:
        return _valid_lines(reader.json(path))
    except AnalysisException:
        return spark.createDataFrame([], TRAFFIC_LOG)


def stream_traffic_log(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """The same log as a stream over the files of a folder."""
    reader = spark.readStream.schema(f"{TRAFFIC_LOG}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _valid_lines(reader.json(path))


def read_text_files(spark: SparkSession, path: str, *, exclude: Sequence[str] = V.BINARY_SUFFIXES, glob: str | None = None) -> DataFrame:
    """``path, text`` of the text files below a folder.

    Dropped are excluded suffixes, by file name before anything is read, and files
    with a NUL in the first 4096 bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    kept = files.where(~F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in exclude) + ")$"))
    head = F.substring("content", 1, NUL_WINDOW).cast("string")
    return kept.where(F.locate("\0", head) == 0).select("path", F.col("content").cast("string").alias("text"))


def read_browser_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BROWSER_STATE).json(path).where(F.col("error").isNull())


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Captured exchanges, one JSON object a line; ``set_cookies`` lists the ``Set-Cookie`` headers, of which there may be several."""
    return spark.read.schema(CAPTURED).json(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """One unified diff per file; the commit is the file name without its suffix."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    return files.select(
        name.alias("commit"),
        F.unix_timestamp("_metadata.file_modification_time").alias("commit_ts"),
        F.col("value").alias("diff"),
    )


def read_tables(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables written by ``write_graph``."""
    tables = read_tables(spark, path, ["nodes", "edges"])
    return tables["nodes"].select("id", "label", "name", "attrs"), tables["edges"].select("src", "dst", "label")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from .writers import STORE_TABLES

    return read_tables(spark, path, STORE_TABLES)
