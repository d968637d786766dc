"""URL filters: host and path rules, and trust and distrust that spread along links between hosts.

Hosts whose pages the rules allow are seeds of trust, hosts whose pages they block seeds of distrust, each by the share of
its pages.  Trust is a personalised PageRank from the trusted seeds along the links.  Distrust goes against
them, from the blocked seeds to those that link to them: a host gets the share of its own links that its targets' distrust
is reached by, so its distrust is the mass that a walk from it along its links, damped by each step, leaves on blocked seeds.

Both are compared on a scale that no number of linkers changes.  Distrust is a share already: each of many hosts that link to one blocked
host alone gets the same, and a hub with one bad link of many gets little.  Trust is taken relative to
the PageRank of all hosts (the share of a host's rank that stems from trusted seeds).  A host is blocked where its
distrust exceeds its relative trust by the threshold; rules come before that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The rules of the contract, as (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, action) of the longest rule that fits; null if none does."""
    found = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*found)


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted before the shuffle."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, rounds: int) -> DataFrame:
    """For each column of ``seeds(host, ...)``: ``score = seed + damping * sum of weight * score`` along ``edges(src, dst, weight)``.

    One stored table a round, with the scores before beside the new ones, until no score changes by more than ``tolerance`` of itself (or of 1,
    if it is less).  Sums are partial on the map side.  Not to get there in ``rounds`` is an error.
    """
    names = [c for c in seeds.columns if c != "host"]
    scores = seeds
    for _ in range(rounds):
        given = edges.join(scores.select(F.col("host").alias("src"), *names), "src").groupBy(F.col("dst").alias("host")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"got_{c}") for c in names])
        before = scores.select("host", *[F.col(c).alias(f"old_{c}") for c in names])
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        new = seeds.join(given, "host", "full").join(before, "host", "left")
        scores = stored(new.select("host", *[(zero(c) + damping * zero(f"got_{c}")).alias(c) for c in names], *[zero(f"old_{c}").alias(f"old_{c}") for c in names]), "scores")
        changes = [F.max(F.abs(F.col(c) - F.col(f"old_{c}")) / F.greatest(F.col(c), F.lit(1.0))) for c in names]
        if (scores.agg(F.greatest(*changes, F.lit(0.0))).first()[0] or 0.0) <= tolerance:
            return scores.select("host", *names)
    raise ArithmeticError(f"scores change by more than {tolerance} after {rounds} rounds")


def host_scores(judged: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 300) -> DataFrame:
    """``(host, trust, rank, distrust)`` from pages ``(host, action, html)``, for hosts of pages and of links.

    ``trust`` is the personalised PageRank from the allowed seeds, ``rank`` that from all hosts alike, ``distrust`` the blocked share of the host's
    pages and, for the share without a rule, the damped mean distrust of what it links to.
    """
    share = lambda action: F.avg(F.when(F.col("action") == action, 1.0).otherwise(0.0))
    own = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    found = stored(host_links(judged), "links")
    weight = (F.col("n") / F.col("all")).alias("weight")
    links = stored(found.join(found.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", weight), "weighted")
    named = links.select(F.col("dst").alias("host"), F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked"))
    seeds = stored(own.unionByName(named).groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")), "seeds")
    forward = _spread(seeds.select("host", F.col("allowed").alias("trust"), F.lit(1.0).alias("rank")), links, damping, tolerance, rounds)
    free = seeds.select(F.col("host").alias("src"), (1.0 - F.col("allowed") - F.col("blocked")).alias("free"))
    back = stored(links.join(free, "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * F.col("free")).alias("weight")), "back")
    return forward.join(_spread(seeds.select("host", F.col("blocked").alias("distrust")), back, damping, tolerance, rounds), "host")


def filter_urls(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, **spread
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (or null), verdict (``allow`` or ``block``).

    A null url, or one without ``://``, has empty host and path and is allowed.
    Null pages have no links.  Repeated rows stay and count again for their host's
    share.  Only hosts that the scores block are joined back, so one host with
    most of the pages costs no more than its rows.
    """
    rows = pages.select(F.col(id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(rows.select("host", F.col("found.action").alias("action"), "html"), **spread)
    bad = scores.where(F.col("distrust") - F.col("trust") / F.col("rank") >= threshold).select("host", F.lit("block").alias("judged"))
    return rows.drop("html").join(stored(bad, "blocked"), "host", "left").select(
        F.col("page_id").alias(id), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", "judged", F.lit("allow")).alias("verdict")
    )
