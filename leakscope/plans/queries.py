"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..catalog import catalog_table, default_catalog, parse_catalog_lines, prefix_terms, read_catalog
from ..functions import scalars as S
from ..functions import urls as U
from ..knowledge import KnowledgeBase
from ..operators import ann as AN
from ..operators import browser as B
from ..operators import detect as D
from ..operators import extras as X
from ..operators import findings as FN
from ..operators import graph as G
from ..operators import history as H
from ..operators import retrieve as R
from ..operators import search as SE
from ..operators import traffic as T
from ..operators import vectors as VE
from ..operators import web as W
from ..operators.store import FindingStore, upsert_stream
from ..session import local_table, shared_dir
from ..sources import readers, writers
from ..sources.diff_log import read_diff_log
from ..sources.text_lines import read_text_lines
from ..streaming import traffic_stream as TS
from . import audit as A
from . import views as VW

QUESTION = "Which api key was seen in a header for user 12 key"
QUESTIONS = (
    ("q1", "api key exposed in url for user 3"),
    ("q2", "plaintext password seen"),
    ("q3", "cookie or storage findings of the browser"),
    ("q4", "source map pattern for user 77"),
)
GLOBS = ("src1/**", "**/*7.txt", "src?/5*.txt")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def latest_findings(spark, d) -> DataFrame:
    return FN.latest(VW.log_findings(spark, d))


def enriched(spark, d) -> DataFrame:
    return G.with_cwe(VW.log_findings(spark, d), KnowledgeBase())


def diff_table(spark, d) -> DataFrame:
    return H.diff_lines(VW.commit_diffs(spark, d))


# --- sources ----------------------------------------------------------------


@query
def read_report(spark, d):
    """All findings written as a report folder and read back."""
    path = shared_dir(spark, "report")
    writers.write_report(VW.log_findings(spark, d), path, target="events")
    found = FN.normalize(readers.read_report(spark, path))
    return found.groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("first_id"), F.max("url").alias("last_url"))


@query
def audit_summary(spark, d):
    """The counts of a written report."""
    path = shared_dir(spark, "report")
    writers.write_report(VW.log_findings(spark, d), path, target="events")
    summary = readers.read_report_summary(spark, path)
    counts = [summary.select("target", F.lit(c).alias("kind"), F.explode(c).alias("name", "n")) for c in ("stats", "severities")]
    return counts[0].unionByName(counts[1])


@query
def text_files(spark, d):
    """Documents written as text files; those of one language are made binary by a NUL, and all are there once more as archives."""
    path = shared_dir(spark, "texts")
    docs = VW.documents(spark, d, "lang")
    text = F.when(F.col("lang") == "de", F.concat(F.lit("\0"), "text")).otherwise(F.col("text"))
    docs.select("lang", text.alias("value")).write.partitionBy("lang").text(path)
    docs.select("lang", F.col("text").alias("value")).write.mode("append").option("compression", "gzip").partitionBy("lang").text(path)
    found = read_text_lines(spark, path, glob="*.txt*")
    return D.scan(found, "line", default_catalog(), keep=["path"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("line_hits"))


@query
def pattern_catalog(spark, d):
    """Catalog rows parsed from ``KEY=REGEX`` lines, with the documents each one hits."""
    patterns = default_catalog()
    lines = local_table(spark, [(f" {p.raw_name} = {p.regex}",) for p in patterns] + [("# note = x",), ("",)], "value string")
    hits = D.scan(VW.documents(spark, d), "text", patterns, keep=["doc_id"], raw=True)
    counted = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("pattern", "raw_name")
    return parse_catalog_lines(lines).join(counted, "raw_name", "left").select("raw_name", "name", "regex", F.coalesce("docs", F.lit(0)).alias("docs"))


@query
def catalog_file(spark, d):
    """A catalog file with comments and an invalid regex, read and used for a scan."""
    path = shared_dir(spark, "catalog")
    lines = [(f" {p.raw_name} = {p.regex}",) for p in default_catalog()] + [("# note = x",), ("",), ("BROKEN=(",), ("EMPTY=",)]
    local_table(spark, lines, "value string").coalesce(1).write.text(path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        patterns = read_catalog(spark, path, missing="error")
    hits = D.scan(VW.documents(spark, d), "text", patterns, keep=["doc_id"], raw=True)
    counted = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("pattern", "raw_name")
    return catalog_table(spark, patterns).join(counted, "raw_name", "left").select("raw_name", "name", "regex", F.coalesce("docs", F.lit(0)).alias("docs"))


@query
def diff_lines(spark, d):
    lines = diff_table(spark, d)
    return lines.groupBy("commit", "path", "sign").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_nos"), F.max("file_no").alias("file_no"),
        F.sum(F.length("line")).alias("chars"),
    )


@query
def diff_log(spark, d):
    """Commits written as the text of a log with patches and read back; commit and time come from the text."""
    path = shared_dir(spark, "history")
    head = F.concat(F.lit("commit "), "commit", F.lit("\nAuthor: a <a@example.com>\nDate:   "), F.col("commit_ts").cast("string"), F.lit("\n\n    change\n\n"))
    VW.commit_diffs(spark, d).select(F.concat(head, "diff", F.lit("\n")).alias("value")).write.text(path)
    lines = read_diff_log(spark, path)
    return lines.groupBy("commit", "commit_ts", "path", "sign").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_nos"), F.max("file_no").alias("file_no"), F.sum(F.length("line")).alias("chars")
    )


# --- detection --------------------------------------------------------------


@query
def pattern_scan_docs(spark, d):
    hits = D.scan(VW.documents(spark, d), "text", default_catalog(), keep=["doc_id"], cap=V.CAP_WEB)
    return hits.select("doc_id", "pattern", "snippet", "original_length")


@query
def pattern_scan_lines(spark, d):
    hits = D.scan_lines(VW.documents(spark, d), "text", default_catalog(), keep=["doc_id"], cap=V.CAP_HISTORY)
    return hits.select("doc_id", "line_no", "pattern", "original_length")


@query
def first_pattern(spark, d):
    return D.scan(VW.assets(spark, d), "content", default_catalog(), keep=["url"], mode="first").select("url", "pattern")


@query
def pattern_occurrences(spark, d):
    found = D.occurrences(VW.assets(spark, d), "content", default_catalog(), keep=["url"])
    return found.select("url", "pattern", "occurrences", "original_length")


@query
def redact_text(spark, d):
    a = VW.answers(spark, d)
    return a.select("conv_id", "turn", S.sha1(D.redact("text")).alias("redacted_sha"), F.regexp_count(D.redact("text"), F.lit(r"\[REDACTED\]")).alias("marks"))


@query
def size_limits(spark, d):
    """Whole texts are scanned; the size limits only mark what a limited scan would leave out."""
    a = VW.assets(spark, d)
    inside = D.within_limits("content", max_bytes=8000, max_chars=6000)
    hits = D.scan(a.withColumn("inside", inside), "content", default_catalog(), keep=["url", "inside"])
    return hits.select("url", "inside", "pattern")


# --- web --------------------------------------------------------------------


@query
def web_response_pattern(spark, d):
    return W.response_patterns(VW.web_pages(spark, d), default_catalog()).select("url", "type", "severity", "pattern", "original_length", "finding_id")


@query
def web_response_unescaped(spark, d):
    return W.response_patterns(VW.web_pages(spark, d), default_catalog(), unescape=True).select("url", "pattern", "original_length")


@query
def web_header_pattern(spark, d):
    return W.header_patterns(VW.web_pages(spark, d), default_catalog()).select("url", "header", "pattern", "original_length", "severity")


@query
def web_cookie_pattern(spark, d):
    return W.cookie_patterns(VW.web_pages(spark, d), default_catalog()).select("url", "key", "pattern", "original_length", "severity")


@query
def extract_links(spark, d):
    return W.links(VW.pages(spark, d)).groupBy("page_url", "ref", "link").agg(F.count(F.lit(1)).alias("n"))


@query
def asset_links(spark, d):
    found = W.links(VW.pages(spark, d)).withColumn("is_asset", W.is_asset())
    return found.groupBy("page_url").agg(F.count_if("is_asset").alias("assets"), F.count_if(~F.col("is_asset")).alias("pages"))


@query
def asset_pattern(spark, d):
    found = W.links(VW.pages(spark, d))
    hits = W.asset_patterns(found, VW.assets(spark, d), default_catalog())
    return hits.groupBy("url", "type", "pattern", "original_length").agg(F.count(F.lit(1)).alias("n"))


@query
def asset_pattern_counted(spark, d):
    found = W.links(VW.pages(spark, d))
    hits = W.asset_patterns(found, VW.assets(spark, d), default_catalog(), per_reference=False)
    return hits.select("url", "pattern", F.col("metadata")["links"].cast("bigint").alias("links"))


@query
def sourcemap_refs(spark, d):
    return W.source_map_refs(VW.pages(spark, d))


@query
def sourcemap_pattern(spark, d):
    refs = W.source_map_refs(VW.pages(spark, d))
    hits = W.source_map_patterns(refs, VW.source_maps(spark, d), default_catalog())
    return hits.select("url", "type", "pattern", "original_length", F.col("metadata")["source_index"].cast("int").alias("source_index"))


@query
def sourcemap_counted(spark, d):
    """Each hit in a source map once, with the number of references to the map."""
    refs = W.source_map_refs(VW.pages(spark, d))
    hits = W.source_map_patterns(refs, VW.source_maps(spark, d), default_catalog(), per_reference=False)
    return hits.select("url", "pattern", F.col("metadata")["links"].cast("bigint").alias("links"), F.col("metadata")["source_index"].cast("int").alias("source_index"))


@query
def same_host_links(spark, d):
    found = W.links(VW.pages(spark, d))
    return W.same_host_links(found, U.host("page_url")).groupBy("page_url").agg(F.count(F.lit(1)).alias("n"))


@query
def crawl_reach(spark, d):
    pages = VW.table(spark, d, "pages")
    base = pages.agg(F.min_by("url", "page_id")).first()[0]
    return W.crawl(VW.link_graph(spark, d), base, max_pages=None, same_host_only=False)


def linked_pages(spark, d) -> DataFrame:
    """Pages that also link to two later pages of their host, as a tree in the order of their ids."""
    place = Window.partitionBy("host").orderBy("page_id")
    rows = VW.pages(spark, d).withColumn("host", U.host("url")).withColumn("n", F.row_number().over(place))
    children = rows.where("n > 1").select("host", F.floor(F.col("n") / 2).alias("n"), F.concat(F.lit('<a href="'), "url", F.lit('">c</a>')).alias("a"))
    anchors = children.groupBy("host", "n").agg(F.concat_ws("", F.sort_array(F.collect_list("a"))).alias("a"))
    return rows.join(anchors, ["host", "n"], "left").select("url", F.concat("body", F.coalesce("a", F.lit(""))).alias("body"))


@query
def crawl_links(spark, d):
    """Crawl over the links in the pages' texts, on the host of the first page and within a budget of pages."""
    base = VW.table(spark, d, "pages").agg(F.min_by("url", "page_id")).first()[0]
    edges = W.links(linked_pages(spark, d)).select(F.col("page_url").alias("src"), F.col("link").alias("dst"))
    return W.crawl(edges, base, max_pages=40)


@query
def exchange_file(spark, d):
    """Exchanges written as JSON lines and read back, checked as pages, each of several cookies by itself."""
    path = shared_dir(spark, "exchanges")
    VW.exchanges(spark, d).withColumn("set_cookies", F.concat("set_cookies", F.array(F.lit("lang=en")))).write.json(path)
    found = W.real_issues(W.scan_pages(W.captured_pages(readers.read_exchanges(spark, path)), default_catalog()))
    return W.wrap(found, hide_type=True).select(
        "url", "type", "summary", "severity", F.col("metadata")["type"].alias("inner_type"), F.col("metadata")["pattern"].alias("inner_pattern")
    )


@query
def audit_web(spark, d):
    """Findings of pages, their scripts and source maps, and probes, by type."""
    found = A.collect_findings(default_catalog(), pages=VW.web_pages(spark, d), scripts=VW.assets(spark, d), source_maps=VW.source_maps(spark, d), probes=VW.probes(spark, d))
    return found.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def probe_exposed_path(spark, d):
    found = W.exposed_paths(VW.probes(spark, d))
    return found.where(F.col("type") == "exposed_path").select("url", "status", "severity", "original_length")


@query
def probe_catchall(spark, d):
    return W.exposed_paths(VW.probes(spark, d)).groupBy(U.host("url").alias("host"), "type").agg(F.count(F.lit(1)).alias("n"))


@query
def web_status_issues(spark, d):
    found = W.real_issues(W.status_rows(VW.web_pages(spark, d)))
    return found.select("url", "type", "status")


@query
def web_wrap(spark, d):
    found = W.real_issues(W.scan_pages(VW.web_pages(spark, d), default_catalog()))
    return W.wrap(found, hide_type=True).select(
        "url", "type", "summary", "severity", F.col("metadata")["type"].alias("inner_type"), F.col("metadata")["pattern"].alias("inner_pattern")
    )


# --- traffic ----------------------------------------------------------------


@query
def traffic_bypass(spark, d):
    return VW.urls(spark, d).select("event_id", T.bypassed("url").alias("bypass"))


@query
def domain_match(spark, d):
    """Urls of the log, their hosts below a domain of each customer, against the domains of all customers and the fixed list."""
    log = VW.traffic_log(spark, d).select("event_id")
    host = F.concat(F.lit("https://X"), F.col("event_id") % 3, F.lit(".c"), F.col("event_id") % 1999, F.lit(".example.net/a?b=http://other.example/"))
    fixed = VW.pick(("https://eu.api.stripe.com/v1", "https://notstripe.com/", "/relative"), F.floor(F.col("event_id") / 11) % 3)
    urls = log.select("event_id", F.when(VW.every("event_id", 11), fixed).otherwise(host).alias("url"))
    key = F.col("c_custkey").cast("string")
    own = F.when(VW.every("c_custkey", 2), F.concat(F.lit("c"), key, F.lit(".example.net"))).otherwise(F.concat(F.lit("x1.C"), key, F.lit(".example.net")))
    domains = VW.table(spark, d, "customer").select(own.alias("domain"))
    listed = local_table(spark, [(x,) for x in (*V.BYPASS_DOMAINS, "net")], "domain string")
    return T.match_domains(urls, domains.unionByName(listed)).select("event_id", "domain")


@query
def traffic_ignore(spark, d):
    return VW.messages(spark, d).select("event_id", "kind", T.ignored("url").alias("ignored"))


@query
def url_redact(spark, d):
    return VW.urls(spark, d).select("event_id", U.redacted("url").alias("redacted"), U.host("url").alias("host"))


@query
def url_credentials(spark, d):
    return T.url_credentials(VW.exchanges(spark, d)).select("url", "type", "severity", "client", "method", "ts")


@query
def url_query_key(spark, d):
    return T.url_query_key(VW.exchanges(spark, d), default_catalog()).select("url", "type", "severity", "pattern", "description")


@query
def basic_auth(spark, d):
    return T.basic_auth(VW.exchanges(spark, d)).select("url", "type", "severity", "ts")


@query
def header_key_severity(spark, d):
    return T.header_key(VW.exchanges(spark, d), default_catalog()).select("url", "header", "pattern", "severity", "description")


@query
def plaintext_password(spark, d):
    return T.plaintext_password(VW.request_bodies(spark, d)).select("url", "field", "severity", "description")


@query
def hash_like(spark, d):
    return VW.request_bodies(spark, d).select("c_custkey", S.looks_hashed("value").alias("hashed"))


@query
def body_secret(spark, d):
    return T.body_secret(VW.request_bodies(spark, d), default_catalog()).select("url", "pattern", "severity", "description")


@query
def resp_header_secret(spark, d):
    return T.response_header_secret(VW.exchanges(spark, d), default_catalog()).select("url", "header", "pattern", "severity")


@query
def resp_body_secret(spark, d):
    return T.response_body_secret(VW.exchanges(spark, d), default_catalog()).select("url", "pattern", "severity", "original_length")


@query
def scan_traffic(spark, d):
    found = T.scan_traffic(VW.exchanges(spark, d), default_catalog())
    return found.select("ts", "type", "severity", "pattern", "header", "field", "original_length", "description")


@query
def alerts(spark, d):
    found = FN.alerts(T.scan_traffic(VW.exchanges(spark, d), default_catalog()))
    return found.groupBy("type", "severity", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query
def traffic_split(spark, d):
    found = T.split_log(VW.traffic_log(spark, d))
    return found.select("finding_id", "type", "severity", "source", "summary", "description", "pattern", "url", "method", "ts")


@query
def traffic_stamp(spark, d):
    return T.stamp(VW.log_findings(spark, d)).groupBy("stage", F.substring("timestamp", 1, 13).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


@query
def traffic_counts(spark, d):
    return T.stage_counts(VW.traffic_log(spark, d))


@query
def traffic_counters(spark, d):
    return T.counters(VW.messages(spark, d))


@query
def traffic_tail(spark, d):
    return T.newest(VW.traffic_log(spark, d), 200, tie="event_id").select("event_id", "ts", "stage", "url")


@query
def traffic_tail_per_client(spark, d):
    return T.newest_per_client(VW.traffic_log(spark, d), 200, tie="event_id").select("client", "event_id", "ts", "rank")


# --- browser ----------------------------------------------------------------


@query
def browser_storage(spark, d):
    return B.suspicious_storage(VW.browser_state(spark, d), "user").select("client", "location", "key", "original_length", "severity")


@query
def cookie_insecure(spark, d):
    found = B.insecure_cookies(VW.browser_state(spark, d), "user")
    return found.select("client", "key", "severity", F.col("metadata")["secure"].alias("secure"), F.col("metadata")["httpOnly"].alias("http_only"))


@query
def browser_global(spark, d):
    return B.exposed_globals(VW.browser_state(spark, d), "user").select("client", "key", "original_length", "severity")


# --- version history --------------------------------------------------------


@query
def diff_added(spark, d):
    return diff_table(spark, d).where(H.added()).groupBy("commit", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query
def prefix_hits(spark, d):
    """Search terms of the catalog with the number of changed lines that hold them."""
    terms = prefix_terms(default_catalog())
    lines = diff_table(spark, d).where(H.added() | H.removed())
    text = S.text_literal
    counts = lines.agg(*[F.expr(f"count_if(contains(line, {text(t)})) AS t{i}") for t, _, i in terms])
    rows = ", ".join(f"named_struct('term', {text(t)}, 'name', {text(n)}, 'lines', t{i})" for t, n, i in terms)
    return counts.select(F.expr(f"inline(array({rows}))"))


@query
def pickaxe(spark, d):
    found = H.pickaxe_diffs(VW.commit_diffs(spark, d), prefix_terms(default_catalog()))
    return found.select("commit", "commit_ts", "term", "files")


@query
def pickaxe_topn(spark, d):
    terms = prefix_terms(default_catalog())
    found = H.newest_per_term(H.pickaxe_diffs(VW.commit_diffs(spark, d), terms), len(terms), 100)
    return found.select("commit", "term", "rank")


@query
def pickaxe_budget(spark, d):
    diffs = VW.commit_diffs(spark, d)
    return H.examined_commits(H.diff_lines(diffs), default_catalog(), 20, diffs=diffs).select("commit")


@query
def git_pattern(spark, d):
    found = H.scan_diffs(VW.commit_diffs(spark, d), default_catalog(), dedupe=None)
    return found.select("finding_id", "commit", "path", "pattern", "original_length", "severity", "description")


@query
def git_pattern_pruned(spark, d):
    found = H.scan_diffs(VW.commit_diffs(spark, d), default_catalog(), max_commits=100)
    return found.select("commit", "path", "pattern", "original_length")


@query
def git_dedupe(spark, d):
    return H.scan_diffs(VW.commit_diffs(spark, d), default_catalog()).select("commit", "path", "pattern", "original_length")


@query
def git_dedupe_commit(spark, d):
    return H.scan_diffs(VW.commit_diffs(spark, d), default_catalog(), dedupe="commit").select("commit", "path", "pattern")


# --- findings ---------------------------------------------------------------


@query
def findings_all(spark, d):
    """Findings of all detectors in one table, counted by source and type."""
    patterns = default_catalog()
    parts = [
        H.scan_diffs(VW.commit_diffs(spark, d), patterns),
        T.scan_traffic(VW.exchanges(spark, d), patterns),
        W.real_issues(W.scan_pages(VW.web_pages(spark, d), patterns)),
        B.scan_browser(VW.browser_state(spark, d), "user"),
        T.split_log(VW.traffic_log(spark, d)),
    ]
    return FN.union_findings(parts).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_normalized(spark, d):
    raw = VW.traffic_log(spark, d).select(
        "event_id", "stage", "ts", "type", "severity", "client", "pattern", "url", "method",
        F.when(VW.every("event_id", 3), F.col("url")).alias("endpoint"),
        F.when(VW.every("event_id", 4), F.lit("")).otherwise(F.col("stage")).alias("summary"),
        "description",
    )
    found = FN.normalize(raw)
    return found.select("finding_id", "type", "severity", "source", "summary", "ts", F.size("metadata").alias("n_metadata"))


@query
def finding_ids(spark, d):
    f = VW.log_findings(spark, d)
    return f.groupBy("finding_id", "type", "summary").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_latest(spark, d):
    return latest_findings(spark, d).select("finding_id", "ts", "url", "severity", "pattern", "occurrence_count")


@query
def severity_summary(spark, d):
    return FN.severity_summary(VW.log_findings(spark, d))


@query
def severity_rollup(spark, d):
    return FN.severity_rollup(VW.log_findings(spark, d))


@query
def source_stats(spark, d):
    return FN.source_stats(VW.log_findings(spark, d))


@query
def gate_code(spark, d):
    return FN.gate(VW.log_findings(spark, d))


@query
def query_by_severity(spark, d):
    return FN.query_findings(latest_findings(spark, d), severity="high").select("finding_id", "severity", "ts")


@query
def query_by_cwe(spark, d):
    f = latest_findings(spark, d)
    pairs = G.with_cwe(f, KnowledgeBase()).select("finding_id", "cwe_id")
    return FN.query_findings(f, pairs, cwe_id="cwe:CWE-798").select("finding_id", "type", "ts")


@query
def store_stats(spark, d):
    return G.store_stats(G.store_tables(VW.log_findings(spark, d), KnowledgeBase()))


@query
def endpoints(spark, d):
    return FN.endpoints(VW.log_findings(spark, d))


# --- graph ------------------------------------------------------------------


@query
def enrich_cwe(spark, d):
    return enriched(spark, d).groupBy("type", "pattern", "cwe_id").agg(F.count(F.lit(1)).alias("n"))


@query
def enrich_owasp(spark, d):
    return G.with_owasp(enriched(spark, d), KnowledgeBase()).groupBy("cwe_id", "owasp_id").agg(F.count(F.lit(1)).alias("n"))


@query
def kb_cwe_owasp(spark, d):
    """Every weakness and category pair of the knowledge base with its findings."""
    kb = KnowledgeBase()
    n = enriched(spark, d).groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = kb.cwe_owasp(spark).join(kb.owasp_categories(spark).select("owasp_id", "name", "rank"), "owasp_id")
    return pairs.join(n, "cwe_id", "left").select("cwe_id", "owasp_id", "name", "rank", F.coalesce("n", F.lit(0)).alias("n"))


@query
def enrich_mitigation(spark, d):
    return G.with_mitigation(enriched(spark, d), KnowledgeBase()).groupBy("cwe_id", "mitigation_id").agg(F.count(F.lit(1)).alias("n"))


@query
def attack_vectors(spark, d):
    found = G.with_attack_vectors(enriched(spark, d), KnowledgeBase())
    return found.groupBy("vector_id", "attack_type", "vector_name").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_nodes(spark, d):
    return G.nodes(VW.log_findings(spark, d), KnowledgeBase()).select("id", "label", "name")


@query
def graph_edges(spark, d):
    return G.build_graph(VW.log_findings(spark, d), KnowledgeBase())[1]


@query
def graph_stats(spark, d):
    return G.graph_stats(*G.build_graph(VW.log_findings(spark, d), KnowledgeBase()))


@query
def graph_paths(spark, d):
    """Paths in a graph that was written and read back."""
    path = shared_dir(spark, "graph")
    writers.write_graph(*G.build_graph(VW.log_findings(spark, d), KnowledgeBase()), path)
    return G.finding_paths(readers.read_graph(spark, path)[1], KnowledgeBase())


@query
def graph_reach(spark, d):
    """Code examples that each finding reaches, over weakness, category and mitigation, by the fewest edges."""
    edges = G.build_graph(VW.log_findings(spark, d), KnowledgeBase())[1]
    start = edges.where("label = 'is_instance_of'").select(F.col("src").alias("id"))
    found = G.reachable(edges, start, 5, ["is_instance_of", "belongs_to", "fixed_by", "demonstrates"])
    return found.where(F.col("node").startswith("code_example:"))


@query
def graph_successors(spark, d):
    nodes, edges = G.build_graph(VW.log_findings(spark, d), KnowledgeBase())
    found = G.successors(nodes, edges, "finding:", "is_instance_of")
    return found.groupBy("dst", "dst_label", "dst_name").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_finding_attrs(spark, d):
    """What a finding node says about the place of the finding."""
    nodes = G.nodes(VW.log_findings(spark, d), KnowledgeBase()).where("label = 'Finding'")
    return nodes.select("id", *[F.col("attrs")[c].alias(c) for c in ("url", "method", "description", "severity", "occurrence_count", "metadata")])


@query
def norm_findings(spark, d):
    return G.store_tables(VW.log_findings(spark, d), KnowledgeBase())["findings"]


@query
def store_merge(spark, d):
    """A second scan upserted into the store of a first one."""
    found, kb = VW.log_findings(spark, d), KnowledgeBase()
    first, both = shared_dir(spark, "store"), shared_dir(spark, "store")
    writers.write_store(G.store_tables(found.where(F.col("ts") < VW.SCAN_A_END), kb), first)
    writers.merge_store(G.store_tables(found.where(F.col("ts") >= VW.SCAN_B_START), kb), first, both)
    return readers.read_store(spark, both)["findings"].select("finding_id", "severity", "source", "timestamp", "metadata")


@query
def norm_finding_cwe(spark, d):
    return G.store_tables(VW.log_findings(spark, d), KnowledgeBase())["finding_cwe_map"]


@query
def norm_owasp(spark, d):
    """Stored mitigations with the findings that they apply to."""
    tables = G.store_tables(VW.log_findings(spark, d), KnowledgeBase())
    n = tables["finding_cwe_map"].groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = tables["mitigations"].select("mitigation_id", "code_example", F.explode(F.split("applicable_to", ", ")).alias("cwe_id"))
    return pairs.join(F.broadcast(n), "cwe_id").groupBy("mitigation_id", "code_example").agg(F.sum("n").alias("findings"))


# --- retrieval --------------------------------------------------------------


@query
def keyword_topk(spark, d):
    return R.keyword_topk(latest_findings(spark, d), QUESTION, 10)


@query
def ask(spark, d):
    """The prompt for a question, with the best findings as context."""
    return A.ask(latest_findings(spark, d), QUESTION, 5)


@query
def keyword_topk_batch(spark, d):
    found = R.keyword_topk_batch(latest_findings(spark, d), QUESTIONS, 5)
    return found.select("query_id", "rank", "id", "severity", "score")


def questions(spark, d) -> DataFrame:
    """A question for each customer: words of its segment and address that findings may have, and some that they never have."""
    c = VW.table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    word = VW.pick(("password", "api key", "seen for", "Basic auth", "cookie cookie", "zebra", "storage user", "in header"), F.col("query_id") % 8)
    return c.select("query_id", F.concat(word, F.lit(" user "), (F.col("query_id") % 1000).cast("string"), F.lit(" no")).alias("text"))


@query
def keyword_topk_table(spark, d):
    """As many questions as customers, answered in one pass over the findings."""
    found = SE.keyword_topk_table(latest_findings(spark, d), questions(spark, d), 3)
    return found.select("query_id", "rank", "id", "severity", "score")


@query
def prompt_context(spark, d):
    found = R.keyword_topk_batch(latest_findings(spark, d), QUESTIONS, 5)
    asked = local_table(spark, QUESTIONS, "query_id string, question string")
    joined = F.broadcast(asked).join(R.join_contexts(found), "query_id", "left")
    return joined.select("query_id", "n_contexts", "context", F.length(R.prompt("context", "question")).alias("prompt_length"))


@query
def ensure_citation(spark, d):
    return VW.answers(spark, d).select("conv_id", "turn", S.sha1(R.with_citation("text", "ids")).alias("answer_sha"))


@query
def answer_postprocess(spark, d):
    done = R.finish_answers(VW.answers(spark, d))
    return done.select("conv_id", "turn", S.sha1("answer").alias("answer_sha"), "cited")


# --- vectors ----------------------------------------------------------------


def mean_vector(spark, d) -> list[float]:
    """Mean of all vectors; one row per dimension reaches the driver."""
    flat = VW.vectors(spark, d).select(F.posexplode("vector").alias("i", "x"))
    rows = flat.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    return [r.m for r in rows]


@query
def cosine_topk(spark, d):
    return VE.cosine_topk(VW.vectors(spark, d), mean_vector(spark, d), 20)


def vector_index(spark, d) -> tuple[str, int]:
    """A stored index, filled in two steps, and the number of vectors that a query visits at least: one in twelve."""
    path, rows = shared_dir(spark, "index"), VW.vectors(spark, d)
    AN.create_index(spark, path, 64, bits=8)
    AN.add_vectors(path, rows.where("id % 3 > 0"))
    AN.add_vectors(path, rows.where("id % 3 = 0"))
    return path, -(-AN.bucket_counts(spark, path).agg(F.sum("n")).first()[0] // 12)


def near_vectors(spark, d) -> DataFrame:
    """Queries: one vector in 50, moved a quarter of the way of its neighbour by id."""
    rows = VW.vectors(spark, d).select("id", F.col("vector").cast("array<double>").alias("vector"))
    other = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    moved = F.coalesce(F.zip_with("vector", "other", lambda x, y: x + y * 0.25), F.col("vector"))
    return rows.where("id % 50 = 0").join(other, "id", "left").select(F.col("id").alias("query_id"), moved.alias("vector"))


@query
def cosine_ann(spark, d):
    path, least = vector_index(spark, d)
    asked = spark.createDataFrame([(0, mean_vector(spark, d))], "query_id long, vector array<double>")
    return AN.search(spark, path, asked, 20, least=least).select("id", "similarity")


@query
def ann_topk(spark, d):
    """Approximate neighbours of many vectors, with the number of rows that each visited."""
    path, least = vector_index(spark, d)
    asked = near_vectors(spark, d)
    visited = AN.probes(spark, path, asked, least).groupBy("query_id").agg(F.sum("n").alias("visited"))
    return AN.search(spark, path, asked, 10, least=least).join(visited, "query_id")


@query
def ann_recall(spark, d):
    """How many of the exact first 1 and first 10 neighbours the index finds, and the share of rows it visits."""
    found, rows = ann_topk(spark, d), VW.vectors(spark, d)
    exact = VE.knn_join(rows, near_vectors(spark, d), 10).select("query_id", "id", F.col("rank").alias("true_rank"))
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    first = F.avg(F.when(F.col("true_rank") == 1, F.coalesce("hit", F.lit(0))))
    n, visited = rows.count(), found.groupBy("query_id").agg(F.max("visited").alias("v")).agg(F.avg("v")).first()[0] or 0.0
    return hits.agg(
        F.round(first, 6).alias("recall_at_1"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall_at_10"), F.round(F.lit(visited / max(1, n)), 6).alias("visited")
    )


@query
def vector_dim_check(spark, d):
    cut = F.when(VW.every("id", 50), F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    return VE.dimension_errors(VW.vectors(spark, d).withColumn("vector", cut), 64)


@query
def knn_join(spark, d):
    return VE.knn_join(VW.vectors(spark, d), VW.label_centroids(spark, d), 10)


@query
def text_vectors(spark, d):
    """The weighted buckets of each text: how many, the heaviest, and the length of the vector."""
    docs = VW.documents(spark, d)
    done = VE.text_vectors(docs, VE.fit_text_vectors(docs), keep=["doc_id"])
    top = F.array_max("vector")
    return done.select(
        "doc_id", F.size("vector").alias("dim"), F.size(F.filter("vector", lambda x: x > 0)).alias("buckets"),
        F.when(top > 0, F.array_position("vector", top) - 1).alias("top_bucket"), F.round(top, 6).alias("top_weight"),
        F.round(F.sqrt(VE.dot("vector", "vector")), 3).alias("norm"),
    )


@query
def finding_vector_topk(spark, d):
    return VE.finding_vector_topk(latest_findings(spark, d), QUESTION, 5)


# --- extensions -------------------------------------------------------------


@query
def entropy_tokens(spark, d):
    return X.entropy_tokens(VW.documents(spark, d), "text", keep=["doc_id"])


@query
def hybrid_topk(spark, d):
    return X.hybrid_topk(latest_findings(spark, d), QUESTION, 5)


@query
def scan_diff(spark, d):
    return X.scan_diff(*VW.two_scans(spark, d))


@query
def scan_history(spark, d):
    """Findings over scans of five days each: new, fixed and returned."""
    found = VW.log_findings(spark, d).withColumn("scan", F.floor((F.col("ts") - 1704067200) / 432000))
    return X.scan_history(found, "scan")


@query
def fts_rank(spark, d):
    f = latest_findings(spark, d)
    return X.search_index(X.text_index(f), QUESTION, f.count(), 20)


@query
def fts_stored(spark, d):
    """Two scans added to a stored index, the second twice, and searched."""
    path, scans = shared_dir(spark, "fts"), [latest_findings(spark, d).where(t) for t in ("severity IN ('CRITICAL', 'LOW')", "severity NOT IN ('CRITICAL', 'LOW')")]
    SE.add_scan(spark, path, scans[0], "first")
    SE.add_scan(spark, path, scans[1], "second")
    SE.add_scan(spark, path, scans[1], "second")
    SE.add_scan(spark, path, scans[1], "again")  # ids that are known
    return SE.search_stored(spark, path, QUESTION, 20)


@query
def ignore_globs(spark, d):
    lines = diff_table(spark, d).select("path").distinct()
    return lines.select("path", X.ignored_path("path", GLOBS).alias("ignored"))


@query
def severity_by_minute(spark, d):
    f = VW.log_findings(spark, d).withColumn("event_time", F.timestamp_seconds("ts"))
    out = X.severity_windows(f)
    return out.select(F.unix_seconds("window_start").alias("minute"), "severity", "n")


# --- streams ----------------------------------------------------------------


def write_log(spark, d) -> str:
    """The traffic log as NDJSON with blank and malformed lines, in event order; as many files as there are shuffle partitions."""
    path = shared_dir(spark, "log")
    log = VW.traffic_log(spark, d)
    record = F.to_json(F.struct(*[c for c in log.columns if c != "event_id"]))
    lines = F.when(VW.every("event_id", 500), F.array(record, F.lit(""), F.lit('{"ts": 17, "stage"'))).otherwise(F.array(record))
    log.repartitionByRange("ts").select(F.explode(lines).alias("value")).write.text(path)
    return path


@query
def traffic_log_file(spark, d):
    log = readers.read_traffic_log(spark, write_log(spark, d))
    return log.groupBy("stage", "client").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("ts_sum"))


@query
def stream_traffic_counts(spark, d):
    log = readers.stream_traffic_log(spark, write_log(spark, d), max_files=2)
    out = shared_dir(spark, "counts")
    TS.run_to_end(TS.replace_at(TS.stage_counts(log), out, out + "-checkpoint"))
    return TS.current(spark, out)


@query
def stream_severity_window(spark, d):
    """Counts by minute and severity of the log read as a stream, windows that are still open among them."""
    log, out = readers.stream_traffic_log(spark, write_log(spark, d)), shared_dir(spark, "windows")
    TS.run_to_end(TS.update_at(TS.severity_windows(log), out, out + "-checkpoint"))
    return TS.updated(spark, out, ["window_start", "severity"]).select(F.unix_seconds("window_start").alias("minute"), "severity", "n")


@query
def stream_dedupe(spark, d):
    log = readers.stream_traffic_log(spark, write_log(spark, d))
    out = shared_dir(spark, "distinct")
    TS.run_to_end(TS.append_to(TS.distinct_findings(T.split_log(log), delay="365 days"), out, out + "-checkpoint"))
    return spark.read.parquet(out).select("finding_id", "type")


@query
def stream_findings(spark, d):
    """The batch detectors on a stream of captured exchanges."""
    path, out = shared_dir(spark, "exchanges"), shared_dir(spark, "findings")
    VW.exchanges(spark, d).drop("page_id", "set_cookies").write.json(path)
    live = spark.readStream.schema(readers.EXCHANGE).json(path)
    TS.run_to_end(TS.append_to(T.scan_traffic(live, default_catalog()), out, out + "-checkpoint"))
    return spark.read.parquet(out).select("ts", "type", "severity", "pattern", "header", "field", "original_length", "description")


@query
def stream_tail(spark, d):
    log = readers.stream_traffic_log(spark, write_log(spark, d), max_files=1)
    out = shared_dir(spark, "tail")
    TS.run_to_end(TS.tail(log, out, out + "-checkpoint", 200))
    return TS.current(spark, out).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


def in_slices(frame: DataFrame, path: str, run, column: str = "slice", n: int = 3) -> None:
    """Write the rows to a folder slice by slice, and run what reads it after each."""
    for i in range(n):
        frame.where(F.col(column) == i).drop(column).write.mode("append").parquet(path)
        run()


def slice_of(ts: str) -> Column:
    """Three slices of the log by time."""
    return F.when(F.col(ts) < VW.SCAN_B_START, 0).when(F.col(ts) < VW.SCAN_A_END, 1).otherwise(2)


def live_table(spark, path: str, like: DataFrame) -> DataFrame:
    like.limit(0).write.parquet(path)
    return spark.readStream.schema(like.schema).parquet(path)


@query
def stream_upsert(spark, d):
    """The log as a stream in three parts, merged into a stored table; the last part is offered twice."""
    path, out = shared_dir(spark, "log"), shared_dir(spark, "store")
    log = VW.traffic_log(spark, d).where("stage = 'security_finding'").drop("event_id")
    store = FindingStore(spark, out, buckets=8, compact_after=2)
    stream = FN.normalize(T.split_log(live_table(spark, path, log)).drop("finding_id", "metadata"))
    in_slices(log.withColumn("slice", slice_of("ts")), path, lambda: TS.run_to_end(upsert_stream(stream, store, out + "-checkpoint")))
    store.merge(VW.log_findings(spark, d), 2)  # a replay: nothing changes
    return store.read().select("finding_id", "severity", "source", "url", "ts", "occurrence_count")


@query
def stream_pairs(spark, d):
    """Requests and responses of the live log, joined as they arrive; responses after five minutes belong to none."""
    paths, out = [shared_dir(spark, name) for name in ("requests", "responses")], shared_dir(spark, "pairs")
    log = VW.traffic_log(spark, d).select(F.col("event_id").alias("exchange_id"), "ts", "url")
    answered = F.col("ts") + F.col("exchange_id") * 37 % 400
    sides = [
        log.select("exchange_id", F.timestamp_seconds("ts").alias("event_time"), "url", slice_of("ts").alias("slice")),
        log.where("exchange_id % 7 <> 0").withColumn("ts", answered).select(
            "exchange_id", F.timestamp_seconds("ts").alias("event_time"), (200 + F.col("exchange_id") % 5).alias("status"), slice_of("ts").alias("slice")
        ),
    ]
    requests, responses = (live_table(spark, p, s.drop("slice")) for p, s in zip(paths, sides))
    pairs = TS.pair_exchanges(requests, responses)

    def run() -> None:
        TS.run_to_end(TS.append_to(pairs, out, out + "-checkpoint"))

    for i in range(3):
        sides[0].where(F.col("slice") == i).drop("slice").write.mode("append").parquet(paths[0])
        in_slices(sides[1].where(F.col("slice") == i).withColumn("slice", F.lit(0)), paths[1], run, n=1)
    found = spark.read.parquet(out)
    return found.select("exchange_id", "url", "status", F.unix_seconds("event_time").alias("asked"), F.unix_seconds("response_time").alias("answered"))


def closed_log(spark, d, *columns: str) -> DataFrame:
    """The log in slices, then an end mark that lets the watermark pass everything before it."""
    log = VW.traffic_log(spark, d).select(*columns, F.timestamp_seconds("ts").alias("event_time"), slice_of("ts").alias("slice"))
    end = spark.range(1).select(*[F.lit("end").alias(c) for c in columns], F.timestamp_seconds(F.lit(4102444800)).alias("event_time"), F.lit(3).alias("slice"))
    return log.unionByName(end)


@query
def stream_sessions(spark, d):
    """Sessions of each client and stage, rows at most an hour apart."""
    path, out = shared_dir(spark, "log"), shared_dir(spark, "sessions")
    log = closed_log(spark, d, "client", "stage")
    stream = TS.client_sessions(live_table(spark, path, log.drop("slice")), ["client", "stage"], gap="1 hour")
    in_slices(log, path, lambda: TS.run_to_end(TS.append_to(stream, out, out + "-checkpoint")), n=4)
    return spark.read.parquet(out).select("client", "stage", F.unix_seconds("session_start").alias("first"), F.unix_seconds("session_end").alias("last"), "n")


@query
def stream_sliding(spark, d):
    """Rows of each stage in hours that begin every quarter."""
    path, out = shared_dir(spark, "log"), shared_dir(spark, "sliding")
    log = closed_log(spark, d, "stage")
    stream = TS.sliding_counts(live_table(spark, path, log.drop("slice")), ["stage"])
    in_slices(log, path, lambda: TS.run_to_end(TS.append_to(stream, out, out + "-checkpoint")), n=4)
    return spark.read.parquet(out).select("stage", F.unix_seconds("window_start").alias("hour"), "n")


@query
def stream_late(spark, d):
    """Rows that arrive a slice after their own: in time or late, by the time seen before."""
    path, out = shared_dir(spark, "log"), shared_dir(spark, "late")
    log = VW.traffic_log(spark, d).select("event_id", F.timestamp_seconds("ts").alias("event_time"), (slice_of("ts") + VW.every("event_id", 97).cast("int")).alias("slice"))
    stream = live_table(spark, path, log.drop("slice"))
    in_slices(log, path, lambda: TS.run_to_end(TS.keep_late(stream, out, out + "-checkpoint", delay="2 days")), n=4)
    parts = [spark.read.schema("event_id long").parquet(f"{out}/{name}").select("event_id", F.lit(name == "late").alias("late")) for name in ("rows", "late")]
    return parts[0].unionByName(parts[1])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the traffic log, enriched and counted by severity and risk category."""
    found = G.with_owasp(enriched(spark, d), KnowledgeBase())
    return found.groupBy("severity", "cwe_id", "owasp_id").agg(F.count(F.lit(1)).alias("n")).orderBy(
        S.severity_rank("severity").desc(), "cwe_id", "owasp_id"
    )


QUERIES["flagship"] = flagship
