"""Browser-state operators over captured snapshots.

A snapshot has ``localStorage`` and ``sessionStorage`` maps, ``cookies`` as an
array of (name, secure, httpOnly), ``globals`` as a map of JSON texts, and
``error``; a snapshot with an error gives no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.scalars import any_contains
from .findings import as_findings

# JSON texts of values that do not count as exposed.
EMPTY_VALUES = ("null", '""', "false", "0", "0.0")


def usable(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("error").isNull()) if "error" in snapshots.columns else snapshots


def suspicious_storage(snapshots: DataFrame, client: str | None = None) -> DataFrame:
    """Storage entries whose key hints at a credential."""
    areas = F.array(
        *[
            F.struct(F.lit(area).alias("location"), F.map_entries(area).alias("entries"))
            for area in ("localStorage", "sessionStorage")
        ]
    )
    entries = (
        usable(snapshots)
        .select(_client(client), F.inline(areas))
        .select("client", "location", F.inline("entries"))
        .where(any_contains(F.lower("key"), V.STORAGE_KEY_PARTS))
    )
    return as_findings(
        entries,
        type="browser_storage",
        severity="MEDIUM",
        source="browser",
        snippet=F.lit(V.REDACTED),
        client="client",
        location="location",
        key="key",
        original_length=F.length("value"),
    )


def insecure_cookies(snapshots: DataFrame, client: str | None = None) -> DataFrame:
    """Cookies that lack the secure or the httpOnly flag; a missing flag counts as false."""
    cookies = usable(snapshots).select(_client(client), F.inline("cookies"))
    secure, http_only = F.coalesce("secure", F.lit(False)), F.coalesce("httpOnly", F.lit(False))
    return as_findings(
        cookies.where(~secure | ~http_only),
        type="cookie_insecure",
        severity="LOW",
        source="browser",
        client="client",
        key="name",
        metadata=F.create_map(
            F.lit("secure"), F.col("secure").cast("string"), F.lit("httpOnly"), F.col("httpOnly").cast("string")
        ),
    )


def exposed_globals(snapshots: DataFrame, client: str | None = None) -> DataFrame:
    """Global variables with a value other than null, empty text or false."""
    entries = usable(snapshots).select(_client(client), F.explode("globals").alias("key", "value"))
    text = F.when(F.col("value").startswith('"'), F.length("value") - 2).otherwise(F.length("value"))
    return as_findings(
        entries.where(F.col("value").isNotNull() & ~F.col("value").isin(*EMPTY_VALUES)),
        type="browser_global",
        severity="MEDIUM",
        source="browser",
        snippet=F.lit(V.REDACTED),
        client="client",
        key="key",
        original_length=text,
    )


def scan_browser(snapshots: DataFrame, client: str | None = None) -> DataFrame:
    return (
        suspicious_storage(snapshots, client)
        .unionByName(insecure_cookies(snapshots, client))
        .unionByName(exposed_globals(snapshots, client))
    )


def _client(client: str | None) -> Column:
    return (F.col(client).cast("string") if client else F.lit(None).cast("string")).alias("client")
