"""Web-content operators over captured pages.

A page has ``url``, a body column, ``status``, ``headers map`` and optionally
``set_cookies array``.  Assets and source maps are tables of ``url, status, content``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..catalog import Pattern
from ..functions import urls as U
from ..functions.scalars import col
from ..session import cut_lineage, local_table
from . import detect
from .findings import as_findings

CHUNK = 10_000
COMPACT_LEVELS = 16


# --- one page ---------------------------------------------------------------


def response_patterns(pages: DataFrame, patterns: Sequence[Pattern], *, body: str = "body", unescape: bool = False) -> DataFrame:
    """Secrets in page bodies.  ``unescape`` decodes html entities first."""
    if unescape:
        pages = pages.withColumn(body, detect.unescape_html(body))
    hits = detect.scan(pages, body, patterns, keep=["url"], cap=V.CAP_WEB)
    return _web(hits, "response_pattern")


def header_patterns(
    pages: DataFrame,
    patterns: Sequence[Pattern],
    *,
    headers: str = "headers",
    ignore: Sequence[str] = V.IGNORED_HEADERS,
) -> DataFrame:
    """Secrets in response headers, all patterns, without the noisy headers."""
    rows = pages.select("url", F.explode(headers).alias("header", "_value")).where(
        ~F.lower("header").isin(*[h.lower() for h in ignore])
    )
    rows = rows.withColumn("_length", F.length("_value"))
    hits = detect.scan(rows, "_value", patterns, keep=["url", "header", "_length"])
    return _web(hits, "header_pattern", header="header", original_length="_length")


def cookie_patterns(
    pages: DataFrame,
    patterns: Sequence[Pattern],
    *,
    cookies: str = "set_cookies",
    skip: Sequence[str] = V.SKIPPED_COOKIES,
) -> DataFrame:
    """Secrets in ``Set-Cookie`` values, without known session cookies."""
    rows = pages.select("url", F.explode(cookies).alias("_cookie"))
    rows = rows.withColumns(
        {"key": F.lower(F.trim(F.split_part("_cookie", F.lit("="), F.lit(1)))), "_length": F.least(F.length("_cookie"), F.lit(V.CAP_WEB))}
    ).where(~F.col("key").isin(*skip))
    hits = detect.scan(rows, "_cookie", patterns, keep=["url", "key", "_length"])
    return _web(hits, "cookie_pattern", key="key", original_length="_length")


def _web(hits: DataFrame, type_: str, **cols) -> DataFrame:
    fields = {"url": "url", "pattern": "pattern", "snippet": "snippet", "original_length": "original_length"}
    return as_findings(hits, type=type_, severity="HIGH", source="web", **{**fields, **cols})


# --- links ------------------------------------------------------------------


def links(pages: DataFrame, *, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Every ``src`` and ``href`` of a page, as written and resolved."""
    found = pages.select("url", *keep, F.explode(F.regexp_extract_all(body, F.lit(V.LINK_REGEX), 1)).alias("ref"))
    return found.select(F.col("url").alias("page_url"), *keep, "ref", U.join("url", "ref").alias("link"))


def is_asset(link="link") -> Column:
    c = col(link)
    test = F.lit(False)
    for suffix in V.ASSET_SUFFIXES:
        test = test | c.endswith(suffix)
    return test


def same_host_links(found: DataFrame, base_host: str | Column) -> DataFrame:
    """Links that stay on the base host or the local machine, or are relative."""
    host = F.lit(base_host) if isinstance(base_host, str) else base_host
    return found.where(U.same_host("link", host))


# --- assets and source maps -------------------------------------------------


def _report_per_reference(hits: DataFrame, references: DataFrame) -> DataFrame:
    """Hits of a shared resource repeated once for each reference to it.

    The references are counted before the join, so a resource that a third of all
    pages load is one row there.  The repetition is cut into chunks that are spread
    over the tasks before they are written out.
    """
    counted = references.groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
    chunks = hits.join(counted, "url").withColumn("_c", F.expr(f"explode(sequence(1L, (_n - 1) div {CHUNK} + 1))"))
    copies = F.expr(f"explode(array_repeat(1, int(least({CHUNK}, _n - (_c - 1) * {CHUNK}))))")
    return chunks.repartition("url", "_c").withColumn("_copy", copies).drop("_n", "_c", "_copy")


def asset_patterns(
    found: DataFrame,
    assets: DataFrame,
    patterns: Sequence[Pattern],
    *,
    content: str = "content",
    max_bytes: int | None = None,
    per_reference: bool = True,
) -> DataFrame:
    """Secrets in the scripts and maps that pages link to.

    Each asset is scanned once.  It is reported once per link to it, or once with
    the number of links in ``metadata`` when ``per_reference`` is False.
    ``max_bytes`` leaves larger assets out; by default none is.
    """
    references = found.where(is_asset()).select(F.col("link").alias("url"))
    served = assets.where((F.col("status") == 200) & detect.within_limits(content, max_bytes=max_bytes))
    hits = detect.scan(served, content, patterns, keep=["url"], cap=V.CAP_WEB)
    if per_reference:
        return _web(_report_per_reference(hits, references), "js_pattern")
    counted = references.groupBy("url").agg(F.count(F.lit(1)).alias("_links"))
    joined = hits.join(counted, "url")
    return _web(joined, "js_pattern", metadata=F.create_map(F.lit("links"), F.col("_links").cast("string")))


def source_map_refs(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """Source maps that a text names, as written and resolved."""
    refs = F.regexp_extract_all(body, F.lit(V.SOURCE_MAP_REGEX), 1)
    found = pages.where(F.col(body).contains("sourceMappingURL")).select("url", F.explode(refs).alias("ref"))
    return found.select(F.col("url").alias("page_url"), "ref", U.join("url", "ref").alias("link"))


def source_map_patterns(
    refs: DataFrame, maps: DataFrame, patterns: Sequence[Pattern], *, content: str = "content", per_reference: bool = True
) -> DataFrame:
    """Secrets in the sources embedded in source maps, with the index of the source.

    Reported once per reference to the map, or once with the number of references in ``metadata`` when ``per_reference`` is False.
    """
    parsed = F.from_json(content, "sourcesContent array<string>")
    sources = (
        maps.where(F.col("status") == 200)
        .select("url", F.posexplode(parsed["sourcesContent"]).alias("source_index", "_source"))
    )
    hits = detect.scan(sources, "_source", patterns, keep=["url", "source_index"], cap=V.CAP_WEB)
    references = refs.select(F.col("link").alias("url"))
    index = F.create_map(F.lit("source_index"), F.col("source_index").cast("string"))
    if not per_reference:
        joined = hits.join(references.groupBy("url").agg(F.count(F.lit(1)).alias("_links")), "url")
        return _web(joined, "sourcemap_pattern", metadata=F.map_concat(index, F.create_map(F.lit("links"), F.col("_links").cast("string"))))
    joined = _report_per_reference(hits, references)
    return _web(joined, "sourcemap_pattern", metadata=index)


# --- crawl frontier ---------------------------------------------------------


def crawl(
    edges: DataFrame,
    base_url: str,
    *,
    max_pages: int | None = None,
    same_host_only: bool = True,
    max_depth: int | None = None,
) -> DataFrame:
    """Urls reached from ``base_url`` over ``(src, dst)`` links, with their depth.

    Breadth first: each level joins the last level with the edges and drops what
    was visited.  Edges and levels are checkpointed, so nothing is computed twice.  The
    page budget takes nearer pages first, by url within a level.  By default there is neither a
    budget nor a greatest depth.
    """
    spark = edges.sparkSession
    if same_host_only:
        edges = edges.where(U.same_host("dst", U.host(F.lit(base_url))))
    edges = cut_lineage(edges.select("src", "dst").distinct())
    visited = local_table(spark, [(base_url, 0)], "url string, depth int")
    frontier, total, depth = visited, 1, 0
    while (max_depth is None or depth < max_depth) and (max_pages is None or total < max_pages):
        depth += 1
        reached = (
            edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("url"))
            .distinct()
            .join(visited, "url", "left_anti")
        )
        if max_pages is not None:
            reached = reached.orderBy("url").limit(max_pages - total)
        frontier = cut_lineage(reached.withColumn("depth", F.lit(depth)))
        n = frontier.count()
        if n == 0:
            return visited
        total += n
        visited = visited.unionByName(frontier)
        if depth % COMPACT_LEVELS == 0:
            visited = cut_lineage(visited)
    return visited


# --- probes -----------------------------------------------------------------


def exposed_paths(probes: DataFrame, *, paths: Sequence[str] = V.PROBE_PATHS) -> DataFrame:
    """Well-known sensitive paths, at the root or below a folder, that answered with content.

    On a site with three or more such answers that are all the same text, they
    are relabelled as a catch-all page.  ``probes`` has ``host, url, status, body``.
    """
    hits = probes.where(
        U.path("url").rlike("(?:" + "|".join(re.escape(p) for p in paths) + r")\z") & (F.col("status") == 200) & F.col("body").rlike(r"\S")
    ).select(
        "host",
        "url",
        "status",
        F.sha2("body", 256).alias("_body"),
        F.least(F.length("body"), F.lit(V.CAP_PROBE)).alias("original_length"),
    )
    sites = hits.groupBy("host").agg(
        ((F.count(F.lit(1)) >= 3) & (F.min("_body") == F.max("_body"))).alias("_catchall")
    )
    labelled = hits.join(sites, "host")
    return as_findings(
        labelled,
        type=F.when(F.col("_catchall"), "false_positive_catchall").otherwise("exposed_path"),
        severity="MEDIUM",
        source="web",
        url="url",
        status="status",
        snippet=F.lit(V.REDACTED),
        original_length="original_length",
    )


# --- status rows and the report wrapper -------------------------------------


def status_rows(pages: DataFrame) -> DataFrame:
    return as_findings(pages, type="status", source="web", url="url", status="status")


def real_issues(findings: DataFrame) -> DataFrame:
    """Everything but the status rows of pages that were served."""
    return findings.where((F.col("type") != "status") | (F.coalesce("status", F.lit(200)) >= 400))


def wrap(findings: DataFrame, *, hide_type: bool = False) -> DataFrame:
    """Report form of web findings; the inner record goes to ``metadata``.

    ``hide_type`` reports every type as ``crawler_issue``, which no weakness is
    mapped to; by default the inner type stays.
    """
    inner = {n: F.col(n).cast("string") for n in ("type", "pattern", "header", "key", "status", "snippet", "original_length")}
    pairs = [x for n, c in inner.items() for x in (F.lit(n), c)]
    details = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    summary = F.coalesce(F.nullif("description", F.lit("")), "type")
    type_ = F.lit("crawler_issue") if hide_type else F.col("type")
    passed = {"snippet": "snippet", "pattern": "pattern", "header": "header", "key": "key", "status": "status", "original_length": "original_length"}
    return as_findings(
        findings,
        type=type_,
        severity=F.coalesce("severity", F.lit("MEDIUM")),
        source="web",
        summary=summary,
        description="description",
        url="url",
        metadata=details,
        **({} if hide_type else passed),
    )


def captured_pages(exchanges: DataFrame) -> DataFrame:
    """Exchanges as pages for ``scan_pages``: ``url, status, headers, set_cookies, body``.

    Each ``Set-Cookie`` of a response is an element of ``set_cookies``; where that is missing, the header of that name counts as one.
    """
    cookies = F.map_values(F.map_filter("resp_headers", lambda k, _: F.lower(k) == "set-cookie"))
    given = F.col("set_cookies") if "set_cookies" in exchanges.columns else F.lit(None).cast("array<string>")
    return exchanges.select("url", "status", F.col("resp_headers").alias("headers"), F.coalesce(given, cookies, F.array().cast("array<string>")).alias("set_cookies"), F.col("resp_body").alias("body"))


def scan_pages(pages: DataFrame, patterns: Sequence[Pattern], *, body: str = "body", headers: str = "headers", cookies: str = "set_cookies") -> DataFrame:
    """Status, body, header and cookie checks of captured pages."""
    return (
        status_rows(pages)
        .unionByName(response_patterns(pages, patterns, body=body))
        .unionByName(header_patterns(pages, patterns, headers=headers))
        .unionByName(cookie_patterns(pages, patterns, cookies=cookies))
    )
