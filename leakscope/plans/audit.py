"""The two flows that most users run: audit sources into stored tables, and ask about findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Pattern, default_catalog
from ..knowledge import KnowledgeBase
from ..operators import browser, findings, graph, history, retrieve, traffic, web
from ..sources import writers


def collect_findings(
    patterns: Sequence[Pattern],
    *,
    diffs: DataFrame | None = None,
    exchanges: DataFrame | None = None,
    pages: DataFrame | None = None,
    scripts: DataFrame | None = None,
    source_maps: DataFrame | None = None,
    probes: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    log: DataFrame | None = None,
    max_commits: int | None = None,
) -> DataFrame:
    """Findings of the given sources in one table.

    ``scripts`` and ``source_maps`` (``url, status, content``) are scanned where a page names them, once each; ``probes`` are answers to the well-known paths.
    """
    parts = []
    if pages is None and (scripts is not None or source_maps is not None):
        raise ValueError("scripts and source maps need the pages that name them")
    if diffs is not None:
        parts.append(history.scan_diffs(diffs, patterns, max_commits=max_commits))
    if exchanges is not None:
        parts.append(traffic.scan_traffic(exchanges, patterns))
    if pages is not None:
        parts.append(web.real_issues(web.scan_pages(pages, patterns)))
    if scripts is not None:
        parts.append(web.asset_patterns(web.links(pages), scripts, patterns, per_reference=False))
    if source_maps is not None:
        parts.append(web.source_map_patterns(web.source_map_refs(pages), source_maps, patterns, per_reference=False))
    if probes is not None:
        parts.append(web.exposed_paths(probes))
    if snapshots is not None:
        parts.append(browser.scan_browser(snapshots))
    if log is not None:
        parts.append(traffic.split_log(log))
    if not parts:
        raise ValueError("give at least one source")
    return findings.normalize(findings.union_findings(parts).drop("finding_id"))


def audit(
    spark: SparkSession,
    path: str,
    *,
    target: str,
    patterns: Sequence[Pattern] | None = None,
    kb: KnowledgeBase | None = None,
    **sources,
) -> DataFrame:
    """Scan the sources and write report, graph and store below ``path``.

    The findings are written once; everything after that reads them from there, so
    the texts are scanned a single time.  Returns the gate code as one row.
    """
    kb = kb or KnowledgeBase()
    found = collect_findings(patterns or default_catalog(), **sources)
    writers.write_findings(found, f"{path}/findings")
    stored = spark.read.parquet(f"{path}/findings").select(*findings.FINDING)
    writers.write_report(stored, f"{path}/report", target=target)
    writers.write_graph(*graph.build_graph(stored, kb), f"{path}/graph")
    writers.write_store(graph.store_tables(stored, kb), f"{path}/store")
    return findings.gate(stored)


def ask(found: DataFrame, question: str, k: int = 5) -> DataFrame:
    """One row: the question, the number of contexts and the full prompt."""
    best = retrieve.keyword_topk_batch(found, [("q", question)], k)
    # An aggregate without a group gives one row, also when nothing matches.
    context = best.agg(*retrieve.contexts("rank"))
    context = context.select("n_contexts", F.when(F.col("n_contexts") > 0, F.array_join("_lines.line", "\n")).alias("context"))
    asked = context.withColumn("question", F.lit(question))
    return asked.select("question", "n_contexts", retrieve.prompt("context", "question").alias("prompt"))
