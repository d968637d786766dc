"""The findings table: one schema, ids, normalization, upsert, summaries, queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from ..session import local_table

# Column name and type of every finding, in order.
FINDING = dict.fromkeys(
    ("finding_id", "type", "severity", "source", "summary", "description", "snippet", "pattern", "url", "method",
     "client", "header", "field", "commit", "path", "location", "key"),
    "string",
) | {"original_length": "int", "status": "int", "ts": "bigint", "metadata": "map<string,string>", "scan_id": "string"}


# Decides which of several writes of an id is the last one, also within a second.
LATEST_ORDER = ("ts", "url", "method", "severity", "pattern", "client", "header", "field", "path", "commit")


def as_findings(df: DataFrame, **cols: Column | str) -> DataFrame:
    """Project to the finding schema; a column not named is null, the id is derived.

    Strings are column names, except in ``type``, ``severity`` and ``source``, where
    they are constants.
    """

    constants = ("type", "severity", "source")
    computed = {f"_f_{n}": c for n, c in cols.items() if isinstance(c, Column)}
    sql = {n: "NULL" for n in FINDING} | {"scan_id": "'default'"}
    for name, v in cols.items():
        if isinstance(v, Column):
            sql[name] = f"`_f_{name}`"
        elif v is not None:
            sql[name] = S.text_literal(v) if name in constants else f"`{v}`"
    sql["summary"] = "coalesce({})".format(
        ", ".join(f"nullif({sql[n]}, '')" for n in ("summary", "description", "type") if sql[n] != "NULL")
    )
    if "finding_id" not in cols:
        parts = ", ".join(f"coalesce({sql[n]}, '')" for n in ("type", "summary", "snippet"))
        sql["finding_id"] = f"sha1(concat_ws('|', {parts}))"
    wide = df.withColumns(computed) if computed else df
    return wide.selectExpr(*[f"CAST({sql[n]} AS {dtype}) AS `{n}`" for n, dtype in FINDING.items()])


def union_findings(frames: Sequence[DataFrame]) -> DataFrame:
    """All detectors in one table; columns that a detector lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalize(raw: DataFrame) -> DataFrame:
    """Loose records to findings, with the fallbacks of the report format.

    source: source, client, "mitm".  summary: summary, description, type.
    severity: INFO when missing.  ts: timestamp, ts.  Columns outside the finding
    schema become metadata, unless the record has a metadata map of its own.
    """
    have = set(raw.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    dtypes = dict(raw.dtypes)
    nested = ("map", "array", "struct")
    rest = [n for n in raw.columns if n not in FINDING and n not in ("id", "timestamp") and not dtypes[n].startswith(nested)]
    keys = ", ".join(S.text_literal(n) for n in rest)
    texts = ", ".join(f"CAST(`{n}` AS string)" for n in rest)
    extra = f"map_filter(map_from_arrays(array({keys}), array({texts})), (k, v) -> v IS NOT NULL)" if rest else "map()"
    meta = F.expr(f"CAST({extra} AS map<string,string>)")
    if dtypes.get("metadata", "").startswith("map"):
        meta = F.coalesce(F.col("metadata").cast("map<string,string>"), meta)
    summary = S.first_text(c("summary"), c("description"), c("type"))
    given = S.first_text(c("id") if "id" in have else c("finding_id"))
    passed = {n: n for n in ("description", "client", "header", "field", "commit", "path", "location", "key",
                             "original_length", "status", "pattern", "snippet", "url", "method") if n in have}
    stamps = [F.col(n).cast("bigint") for n in ("timestamp", "ts") if n in have]
    return as_findings(
        raw,
        **passed,
        type=c("type"),
        finding_id=F.coalesce(given, S.finding_id(c("type"), summary, c("snippet"))),
        severity=F.coalesce(c("severity"), F.lit("INFO")),
        source=S.first_text(c("source"), c("client"), F.lit("mitm")),
        summary=summary,
        ts=F.coalesce(*stamps) if stamps else None,
        metadata=meta,
        scan_id=F.coalesce(c("scan_id"), F.lit("default")),
    )


def latest(findings: DataFrame, order: Sequence[str] = LATEST_ORDER, key: str = "finding_id") -> DataFrame:
    """One row per id, the last write wins; ``occurrence_count`` says how many there were.

    The aggregate is partial on the map side, so an id that holds a third of all
    rows reaches its reducer as one row per task.
    """
    cols = [c for c in findings.columns if c != key]
    return (
        findings.groupBy(key)
        .agg(
            F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"),
            F.count(F.lit(1)).alias("occurrence_count"),
        )
        .select(key, "_row.*", "occurrence_count")
    )


def severity_summary(findings: DataFrame) -> DataFrame:
    """Counts per severity; the five known ones always appear, others as they occur."""
    known = local_table(findings.sparkSession, [(s, 0) for s in V.SEVERITY_RANK], "severity string, n bigint")
    found = findings.select(F.coalesce("severity", F.lit("INFO")).alias("severity"), F.lit(1).cast("bigint").alias("n"))
    return found.unionByName(known).groupBy("severity").agg(F.sum("n").alias("n"))


def source_stats(findings: DataFrame) -> DataFrame:
    """Findings per source, with one column per severity."""
    by = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in V.SEVERITY_RANK]
    return findings.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *by)


def severity_rollup(findings: DataFrame) -> DataFrame:
    return findings.rollup("source", "severity").agg(F.count(F.lit(1)).alias("n"))


def gate(findings: DataFrame) -> DataFrame:
    """2 if anything is CRITICAL, else 1 if anything is HIGH, else 0."""
    level = F.when(F.col("severity") == "CRITICAL", 2).when(F.col("severity") == "HIGH", 1).otherwise(0)
    return findings.agg(F.coalesce(F.max(level), F.lit(0)).alias("exit_code"))


def check_severity(severity: str | None) -> str | None:
    if severity is None:
        return None
    if severity.upper() not in V.SEVERITY_FILTERS:
        raise ValueError(f"severity {severity!r} is not one of {', '.join(V.SEVERITY_FILTERS)}")
    return severity.upper()


def check_positive(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be positive, got {value}")
    return value


def query_findings(
    findings: DataFrame,
    finding_cwe: DataFrame | None = None,
    *,
    severity: str | None = None,
    cwe_id: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest findings first, optionally of one severity and one weakness.

    ``cwe_id`` may carry the node prefix.  Needs the ``finding_cwe`` map when given.
    """
    severity, limit = check_severity(severity), check_positive("limit", limit)
    out = findings if severity is None else findings.where(F.col("severity") == severity)
    if cwe_id is not None:
        if finding_cwe is None:
            raise ValueError("a query by cwe_id needs the finding_cwe map")
        ids = finding_cwe.where(F.col("cwe_id") == cwe_id.removeprefix("cwe:")).select("finding_id")
        out = out.join(ids, "finding_id", "left_semi")
    return out.orderBy(F.col("ts").desc_nulls_last(), "finding_id").limit(limit)


def endpoints(findings: DataFrame) -> DataFrame:
    """Endpoints with the first and last time a finding was seen there."""
    return (
        findings.where(S.first_text("url").isNotNull())
        .groupBy("method", "url")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
        .select(S.endpoint_id("method", "url").alias("endpoint_id"), "url", "method", "first_seen", "last_seen", "n")
    )


def alerts(findings: DataFrame) -> DataFrame:
    """HIGH and CRITICAL findings, except keys expected in server-side authorization."""
    expected = (
        (F.col("type") == "api_key_in_header")
        & F.col("pattern").isin(*V.EXPECTED_SERVER_AUTH)
        & F.coalesce(F.col("description"), F.lit("")).contains("expected for server-side")
    )
    leak = F.col("type").isin("secret_in_response_header", "secret_in_response_body")
    loud = F.col("severity").isin("HIGH", "CRITICAL")
    return findings.where(leak | (loud & ~F.coalesce(expected, F.lit(False))))
