"""Version-history operators over a table of commit diffs.

A diff line table has ``commit, commit_ts, path, file_no, line_no, sign, line``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..catalog import Pattern, prefix_terms, spans_lines_safely
from ..functions.scalars import col, text_literal
from . import detect
from .findings import as_findings
from .top import top_per_key

BROADCAST_COMMITS = 100_000


def _sections(diffs: DataFrame, commit: str = "commit", commit_ts: str = "commit_ts", diff: str = "diff") -> DataFrame:
    """``commit, commit_ts, file_no, _section, path``, one row for each file of a diff."""
    sections = diffs.select(
        F.col(commit).alias("commit"),
        F.col(commit_ts).alias("commit_ts"),
        F.posexplode(F.split(F.concat(F.lit("\n"), F.col(diff)), "\ndiff --git ")).alias("file_no", "_section"),
    ).where(F.col("file_no") > 0)
    path = F.regexp_extract("_section", r"\n\+\+\+ b/([^\n]+)", 1)
    return sections.withColumn("path", F.when(path == "", F.lit("unknown")).otherwise(path))


def diff_lines(diffs: DataFrame, *, commit: str = "commit", commit_ts: str = "commit_ts", diff: str = "diff") -> DataFrame:
    """Unified diffs to lines.

    The text is cut at each ``diff --git`` header, so the path of a line comes
    from its own file section without ordering the lines of a commit.
    """
    sections = _sections(diffs, commit, commit_ts, diff)
    lines = sections.select(
        "commit",
        "commit_ts",
        "path",
        "file_no",
        F.posexplode(F.split("_section", "\n")).alias("line_no", "line"),
    )
    return lines.withColumn("sign", F.substring("line", 1, 1)).where(F.col("line_no") > 0)


def added(line="line") -> Column:
    """An added line, not the ``+++`` file header."""
    return col(line).startswith("+") & ~col(line).startswith("+++")


def removed(line="line") -> Column:
    return col(line).startswith("-") & ~col(line).startswith("---")


def pickaxe(lines: DataFrame, terms: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Commits where the number of occurrences of a term changes in some file.

    Lines without a term are dropped before the shuffle, and the sums are partial
    on the map side, so a commit of any size is one row per task.
    """
    if not terms:  # nothing to look for
        return lines.select("commit", "commit_ts", F.lit("").alias("term"), F.lit(0).alias("term_ord"), F.lit(0).cast("bigint").alias("files")).limit(0)
    holds = F.expr(
        "array("
        + ", ".join(
            f"CASE WHEN contains(line, {text_literal(t)}) THEN named_struct('term', {text_literal(t)}, 'term_ord', {i}) END"
            for t, _, i in terms
        )
        + ")"
    )
    hits = (
        lines.where(added() | removed())
        .select("commit", "commit_ts", "path", "line", F.explode(holds).alias("_t"))
        .where(F.col("_t").isNotNull())
        .select("commit", "commit_ts", "path", "line", "_t.*")
    )
    count = (F.length("line") - F.length(F.replace("line", F.col("term"), F.lit("")))) / F.length("term")
    change = F.when(F.col("line").startswith("+"), count).otherwise(-count).cast("bigint")
    return (
        hits.groupBy("commit", "commit_ts", "path", "term", "term_ord")
        .agg(F.sum(change).alias("change"))
        .where(F.col("change") != 0)
        .groupBy("commit", "commit_ts", "term", "term_ord")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def pickaxe_diffs(diffs: DataFrame, terms: Sequence[tuple[str, str, int]]) -> DataFrame:
    """:func:`pickaxe` over whole diffs; only diffs that hold a term are split into lines."""
    return pickaxe(diff_lines(diffs_with(diffs, [re.escape(t) for t, _, _ in terms])), terms)


def newest_per_term(found: DataFrame, n_terms: int, max_commits: int = 100) -> DataFrame:
    """The newest commits of each term; the budget is divided over the terms."""
    per_term = max(1, max_commits // max(1, n_terms))
    return top_per_key(found, ["term", "term_ord"], [F.col("commit_ts").desc(), F.col("commit")], per_term)


def within_budget(ranked: DataFrame, max_commits: int = 100) -> DataFrame:
    """Commits examined under a total budget, in term order and by recency.

    A commit that two terms reach uses the budget twice.
    """
    spent = ranked.orderBy("term_ord", "rank").limit(max_commits)
    return spent.groupBy("commit").agg(F.min("commit_ts").alias("commit_ts"))


def diffs_with(diffs: DataFrame, regexes: Sequence[str], *, diff: str = "diff") -> DataFrame:
    """Diffs whose text may match one of the regexes, tested before they are split into lines."""
    safe = all(spans_lines_safely(r) for r in regexes)
    return detect.candidates(diffs, diff, regexes) if safe else diffs


def examined_commits(
    lines: DataFrame, patterns: Sequence[Pattern], max_commits: int = 100, *, diffs: DataFrame | None = None
) -> DataFrame:
    """Commits that the terms of the catalog lead to, within the budget."""
    terms = prefix_terms(patterns)
    found = pickaxe(lines, terms) if diffs is None else pickaxe_diffs(diffs, terms)
    return within_budget(newest_per_term(found, len(terms), max_commits), max_commits)


def scan_history(
    lines: DataFrame,
    patterns: Sequence[Pattern],
    *,
    max_commits: int | None = None,
    dedupe: str | None = "finding",
    examined: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Secrets in added lines.

    All commits are scanned by default; ``max_commits`` restricts the scan to
    what the term search finds within that budget.  ``dedupe`` keeps the first
    hit per (commit, path, pattern), or per commit with ``"commit"``, where the
    path is that of the first file of the diff; None keeps every hit.  ``examined``
    gives the commits when they are known already, ``files`` the files ``(commit, file_no, path)`` to choose the first from, by
    default those of ``lines``.
    """
    if dedupe not in (None, "finding", "commit"):
        raise ValueError(f"dedupe must be 'finding', 'commit' or None, got {dedupe!r}")
    source = lines
    if max_commits is not None:
        chosen = (examined_commits(lines, patterns, max_commits) if examined is None else examined).select("commit")
        chosen = F.broadcast(chosen) if max_commits <= BROADCAST_COMMITS else chosen
        source = lines.join(chosen, "commit", "left_semi")
    keep = ["commit", "commit_ts", "path", "file_no", "line_no"]
    hits = detect.scan(source.where(added()), "line", patterns, keep=keep, cap=V.CAP_HISTORY)
    if dedupe == "finding":
        hits = _first(hits, ["commit", "path", "pattern"], ["file_no", "line_no"])
    elif dedupe == "commit":
        hits = _first(hits, ["commit"], ["ord", "file_no", "line_no", "path"])
        # Lines of a file are put together by hashing first: the choice of the least sorts its rows.
        files = source.select("commit", "file_no", "path").distinct() if files is None else files
        first_path = files.groupBy("commit").agg(F.min_by("path", F.struct("file_no", "path")).alias("path"))
        hits = hits.drop("path").join(first_path, "commit")
    short = F.substring("commit", 1, 12)
    return as_findings(
        hits,
        type="git_pattern",
        severity="HIGH",
        source="git",
        summary=F.concat("pattern", F.lit(" in git history")),
        description=F.concat("pattern", F.lit(" found in git history at "), "path", F.lit(" (commit "), short, F.lit(")")),
        snippet="snippet",
        pattern="pattern",
        commit=short,
        path="path",
        original_length="original_length",
        ts="commit_ts",
    )


def scan_diffs(
    diffs: DataFrame,
    patterns: Sequence[Pattern],
    *,
    max_commits: int | None = None,
    dedupe: str | None = "finding",
) -> DataFrame:
    """:func:`scan_history` over whole diffs; only diffs that may hold a secret are split into lines.

    ``dedupe="commit"`` needs the first path of a commit, which comes from the file headers of all diffs.
    """
    examined = None
    if max_commits is not None:
        examined = examined_commits(diff_lines(diffs), patterns, max_commits, diffs=diffs)
    files = None
    if dedupe == "commit":
        files = _sections(diffs).where(F.col("_section").contains("\n")).select("commit", "file_no", "path")
    lines = diff_lines(diffs_with(diffs, [p.regex for p in patterns]))
    return scan_history(lines, patterns, max_commits=max_commits, dedupe=dedupe, examined=examined, files=files)


def _first(hits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in hits.columns if c not in keys]
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_h")).select(*keys, "_h.*")
