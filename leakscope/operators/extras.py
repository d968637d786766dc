"""Entropy tokens, hybrid retrieval, scan comparison, text index, path globs, time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .findings import check_positive
from .retrieve import check_query, keyword_scores, tokens
from .top import global_rank
from .vectors import TextModel, finding_similarity

ENTROPY_THRESHOLD = 3.5
TOKEN_REGEX = r"[A-Za-z0-9+/=_-]{20,}"


def entropy_tokens(df: DataFrame, text: str, *, keep: Sequence[str], threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Long tokens of high character entropy: position in the text, length, entropy.  The token is not shown."""
    found = df.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN_REGEX), 0)).alias("token_no", "_token"))
    measured = found.select(
        *keep, "token_no", F.length("_token").alias("original_length"), F.round(S.entropy("_token"), 6).alias("entropy")
    )
    return measured.where(F.col("entropy") >= threshold)


def hybrid_topk(findings: DataFrame, query: str, k: int = 5, *, c: int = 60, model: TextModel | None = None) -> DataFrame:
    """Keyword and vector ranks of all findings merged by reciprocal rank: ``id, score, lists``.

    Both lists are ranked as a whole, by score and then id.  Findings without a word of the query are in the vector list
    alone, those without a weighted word in the keyword list alone.
    """
    check_positive("k", k)
    words = keyword_scores(findings, query).where(F.col("score") > 0).select("id", F.col("score").cast("double").alias("s"))
    near = finding_similarity(findings, query, model=model).where(F.col("similarity").isNotNull()).select("id", F.col("similarity").alias("s"))
    lists = [global_rank(rows, [F.col("s").desc(), F.col("id")], rank="r").select("id", "r") for rows in (words, near)]
    merged = lists[0].unionByName(lists[1]).groupBy("id").agg(F.round(F.sum(1.0 / (c + F.col("r"))), 8).alias("score"), F.count(F.lit(1)).alias("lists"))
    return merged.orderBy(F.col("score").desc(), "id").limit(k)


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Finding ids of two scans as new, fixed or persisting; one partial aggregate, no join."""
    flags = before.select("finding_id", F.lit(True).alias("b"), F.lit(False).alias("a")).unionByName(
        after.select("finding_id", F.lit(False).alias("b"), F.lit(True).alias("a"))
    )
    seen = flags.groupBy("finding_id").agg(F.bool_or("b").alias("b"), F.bool_or("a").alias("a"))
    state = F.when(F.col("a") & F.col("b"), "persisting").when(F.col("a"), "new").otherwise("fixed")
    return seen.select("finding_id", state.alias("state"))


def scan_history(findings: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Unbroken stretches of scans that have a finding: ``finding_id, first_scan, last_scan, fixed_in, state``.

    Scans are all values of the column, in their order; ``fixed_in`` is the first scan without the finding, null while it lasts.  The first
    stretch of a finding is ``new``, later ones are ``returned``.  An id is one row with the set of its scans from the map side on; the driver
    holds the scans' names.  Null ids and scans are left out.
    """
    rows = findings.select("finding_id", F.col(scan).alias("scan")).where("finding_id is not null and scan is not null")
    names = [r[0] for r in rows.select("scan").distinct().orderBy("scan").collect()]
    if not names:
        return rows.select("finding_id", *[F.col("scan").alias(c) for c in ("first_scan", "last_scan", "fixed_in")], F.lit("").alias("state"))
    every = F.array(*[F.lit(n) for n in names])
    seen = rows.groupBy("finding_id").agg(F.collect_set("scan").alias("scans"))
    seen = seen.select("finding_id", F.array_sort(F.transform("scans", lambda s: F.array_position(every, s).cast("int"))).alias("at"))
    number = lambda i: F.get(F.col("at"), i)
    begins = F.filter("at", lambda s, i: (i == 0) | (number(i - 1) < s - 1))
    ends = F.filter("at", lambda s, i: (i == F.size("at") - 1) | (number(i + 1) > s + 1))
    stretches = seen.select("finding_id", F.posexplode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("nth", "s"))
    return stretches.select(
        "finding_id", F.get(every, F.col("s.a") - 1).alias("first_scan"), F.get(every, F.col("s.b") - 1).alias("last_scan"), F.get(every, F.col("s.b")).alias("fixed_in"),
        F.when(F.col("nth") == 0, "new").otherwise("returned").alias("state"),
    )


def text_index(findings: DataFrame) -> DataFrame:
    """Inverted index ``token, finding_id, tf`` over summary and snippet."""
    text = F.lower(F.concat_ws(" ", "summary", "snippet"))
    words = findings.select("finding_id", F.explode(F.split(text, r"[^\p{L}\p{N}_]+")).alias("token"))
    return words.where(F.length("token") > 2).groupBy("token", "finding_id").agg(F.count(F.lit(1)).alias("tf"))


def search_index(index: DataFrame, query: str, n_findings: int, k: int = 10) -> DataFrame:
    """Rank by the sum of tf * ln(N / df) over the words of the query.

    The words filter the index first; their document counts are a table of at
    most as many rows as the query has words.
    """
    check_positive("k", k)
    words = sorted(set(tokens(check_query(query))))
    hits = index.where(F.col("token").isin(words))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = hits.join(F.broadcast(df), "token")
    score = F.round(F.sum(F.col("tf") * F.ln(F.lit(float(n_findings)) / F.col("df"))), 6)
    return weighted.groupBy("finding_id").agg(score.alias("score")).orderBy(F.col("score").desc(), "finding_id").limit(k)


def glob_regex(glob: str) -> str:
    """A path glob as a regex: ``*`` stays inside a folder, ``**`` does not, ``?`` is one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "/_-" else glob[i]), i + 1
    return f"^{out}$"


def ignored_path(path, globs: Sequence[str]) -> Column:
    test = F.lit(False)
    for g in globs:
        test = test | S.col(path).rlike(glob_regex(g))
    return test


def severity_windows(findings: DataFrame, *, width: str = "1 minute", time: str = "event_time") -> DataFrame:
    """Findings per time window and severity; works on tables and on watermarked streams."""
    return (
        findings.groupBy(F.window(time, width), "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "severity", "n")
    )
