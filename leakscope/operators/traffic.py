"""Traffic operators.

An exchange has ``method, url, client, ts, req_headers map, req_body, status,
resp_headers map, resp_body``.  All operators are narrow: the same functions run
on a table and on a stream.  A traffic log has one row per logged event.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..catalog import Pattern
from ..functions import scalars as S
from ..functions import urls as U
from ..session import small
from . import detect
from .findings import as_findings
from .top import top_per_key


# --- classification of urls -------------------------------------------------


def bypassed(url="url") -> Column:
    """Whether a request must not go through the proxy.  An empty host never bypasses."""
    def either(items) -> str:
        return "|".join(re.escape(i) for i in items)

    host = U.host(url)
    named = rf"^(?:{either(V.LOCAL_HOSTS)})$|(?:^|\.)(?:{either(V.BYPASS_DOMAINS)})$|{either(V.BYPASS_HOST_PARTS)}"
    by_path = S.any_contains(F.lower(S.col(url)), V.BYPASS_URL_TOKENS)
    return F.coalesce((host != "") & (host.rlike(named) | by_path), F.lit(True))


def match_domains(rows: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``domain``: the longest of ``domains(domain)`` that the url's host is or lies below; null if none.

    Hosts, each once, are cut into the names that they lie below and meet the domains by equality, so the list may have any length.
    The hosts found are broadcast where a count shows that they are few; else Spark splits a frequent host's part of the join.
    Domains count in lower case; null and empty ones match nothing.
    """
    names = [c for c in rows.columns if c != "domain"]
    hosted = rows.select(*names, U.host(url).alias("_host"))
    listed = domains.select(F.lower("domain").alias("_domain")).where("_domain <> ''").distinct()
    hosts = hosted.select("_host").where("_host <> ''").distinct()
    labels = F.split("_host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = hosts.select("_host", F.explode(below).alias("_domain"))
    longest = suffixes.join(small(listed), "_domain").groupBy("_host").agg(F.max_by("_domain", F.length("_domain")).alias("domain"))
    return hosted.join(small(longest), "_host", "left").drop("_host")


def ignored(url="url", host_regex: str = V.IGNORE_HOST_REGEX) -> Column:
    """Whether an exchange is left out of the counters and the sample."""
    low = F.lower(F.coalesce(S.col(url), F.lit("")))
    return F.coalesce(U.host(url), F.lit("")).rlike(host_regex) | S.any_contains(low, V.IGNORE_URL_TOKENS)


# --- request checks ---------------------------------------------------------


def _request_finding(df: DataFrame, keep_userinfo: bool, **cols) -> DataFrame:
    passed = {c: c for c in ("client", "method", "ts") if c in df.columns}
    return as_findings(df, source="mitm", url=U.redacted("url", keep_userinfo), **passed, **cols)


def _base(df: DataFrame) -> list[str]:
    return [c for c in ("client", "method", "ts", "url") if c in df.columns]


def url_credentials(exchanges: DataFrame, *, keep_userinfo: bool = False) -> DataFrame:
    """Credentials embedded in the url.  The stored url drops them unless asked to keep them."""
    # A lone "@" or ":" before the host carries neither a user nor a password.
    embedded = ~U.userinfo("url").isin("", ":")
    return _request_finding(
        exchanges.where(embedded),
        keep_userinfo,
        type="url_embedded_credentials",
        severity="CRITICAL",
        description=F.lit("Credentials embedded in URL (user:pass@domain)"),
    )


def url_query_key(exchanges: DataFrame, patterns: Sequence[Pattern], *, keep_userinfo: bool = False) -> DataFrame:
    """The first pattern found in the query string."""
    queries = exchanges.select(*_base(exchanges), U.query("url").alias("_query")).where(F.col("_query") != "")
    hits = detect.scan(queries, "_query", patterns, keep=_base(exchanges), mode="first", raw=True)
    return _request_finding(
        hits,
        keep_userinfo,
        type="api_key_in_url",
        severity="CRITICAL",
        pattern="pattern",
        description=F.concat(
            F.lit("API key "),
            "pattern",
            F.lit(" exposed in URL query string (logged in browser history, proxy logs, server logs)"),
        ),
    )


def basic_auth(exchanges: DataFrame, *, headers: str = "req_headers", keep_userinfo: bool = False) -> DataFrame:
    h = F.col(headers)
    auth = F.coalesce(h["Authorization"], h["authorization"])
    return _request_finding(
        exchanges.where(auth.contains("Basic")),
        keep_userinfo,
        type="basic_auth_header",
        severity="CRITICAL",
        description=F.lit("Basic Authentication (base64 credentials) in header"),
    )


def header_key(
    exchanges: DataFrame, patterns: Sequence[Pattern], *, headers: str = "req_headers", keep_userinfo: bool = False
) -> DataFrame:
    """Keys in request headers; the severity depends on the header and the transport."""
    rows = exchanges.select(*_base(exchanges), F.explode(headers).alias("header", "_value")).where(
        F.lower("header").isin(*V.KEY_HEADERS)
    )
    hits = detect.scan(rows, "_value", patterns, keep=[*_base(exchanges), "header"], mode="first", raw=True)
    https = U.scheme("url") == "https"
    expected = https & (F.lower("header") == "authorization")
    text = (
        F.when(
            expected,
            F.concat(
                "pattern",
                F.lit(" in Authorization header over HTTPS (expected for server-side API calls, review if unexpected)"),
            ),
        )
        .when(~https, F.concat(F.lit("API key "), "pattern", F.lit(" transmitted over insecure HTTP (unencrypted)")))
        .otherwise(F.concat(F.lit("Potential "), "pattern", F.lit(" in header "), "header"))
    )
    return _request_finding(
        hits,
        keep_userinfo,
        type="api_key_in_header",
        severity=F.when(https, "HIGH").otherwise("CRITICAL"),
        pattern="pattern",
        header="header",
        description=text,
    )


def plaintext_password(
    exchanges: DataFrame, *, body: str = "req_body", keep: Sequence[str] = (), keep_userinfo: bool = False
) -> DataFrame:
    """Password fields whose value is longer than 3 and not hash-like, one row per occurrence."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(V.PASSWORD_FIELD_REGEX), 1).alias("field"),
        F.regexp_extract_all(body, F.lit(V.PASSWORD_FIELD_REGEX), 2).alias("value"),
    )
    base = [*_base(exchanges), *keep]
    # A field name must occur at all before the groups are extracted.
    rows = exchanges.where(F.lower(body).contains("pass") | F.lower(body).contains("pwd")).select(
        *base, F.inline(pairs).alias("field", "_value")
    )
    plain = rows.where((F.length("_value") > 3) & ~S.looks_hashed("_value")).drop("_value")
    return _request_finding(
        plain if "url" in plain.columns else plain.withColumn("url", F.lit(None).cast("string")),
        keep_userinfo,
        type="plaintext_password",
        severity="CRITICAL",
        field="field",
        description=F.concat(F.lit("Plaintext password in field '"), "field", F.lit("' (not hashed)")),
        **({"key": keep[0]} if keep else {}),
    )


def body_secret(
    exchanges: DataFrame, patterns: Sequence[Pattern], *, body: str = "req_body", keep_userinfo: bool = False
) -> DataFrame:
    hits = detect.scan(exchanges, body, patterns, keep=_base(exchanges), raw=True)
    return _request_finding(
        hits,
        keep_userinfo,
        type="secret_in_body",
        severity="HIGH",
        pattern="pattern",
        description=F.concat(F.lit("Potential "), "pattern", F.lit(" in request body")),
    )


# --- response checks --------------------------------------------------------


def response_header_secret(
    exchanges: DataFrame, patterns: Sequence[Pattern], *, headers: str = "resp_headers", keep_userinfo: bool = False
) -> DataFrame:
    rows = exchanges.select(*_base(exchanges), F.explode(headers).alias("header", "_value"))
    hits = detect.scan(rows, "_value", patterns, keep=[*_base(exchanges), "header"], mode="first", raw=True)
    return _request_finding(
        hits,
        keep_userinfo,
        type="secret_in_response_header",
        severity="CRITICAL",
        pattern="pattern",
        header="header",
        description=F.concat(F.lit("Secret "), "pattern", F.lit(" leaked in response header "), "header"),
    )


def is_text_response(headers: str = "resp_headers") -> Column:
    h = F.col(headers)
    kind = F.lower(F.coalesce(h["Content-Type"], h["content-type"], F.lit("")))
    return S.any_contains(kind, V.TEXT_CONTENT_TYPES)


def response_body_secret(
    exchanges: DataFrame,
    patterns: Sequence[Pattern],
    *,
    headers: str = "resp_headers",
    body: str = "resp_body",
    keep_userinfo: bool = False,
) -> DataFrame:
    """Secrets in textual response bodies; the whole body is scanned."""
    texts = exchanges.where(is_text_response(headers))
    hits = detect.scan(texts, body, patterns, keep=_base(exchanges), cap=V.CAP_RESPONSE_BODY, raw=True)
    return _request_finding(
        hits,
        keep_userinfo,
        type="secret_in_response_body",
        severity="CRITICAL",
        pattern="pattern",
        snippet="snippet",
        original_length="original_length",
        description=F.concat(F.lit("Secret "), "pattern", F.lit(" leaked in response body")),
    )


# What the pieces of an exchange are reported as, and whether only the first pattern counts.
_KINDS = {
    "query": ("api_key_in_url", True),
    "key_header": ("api_key_in_header", True),
    "request_body": ("secret_in_body", False),
    "response_header": ("secret_in_response_header", True),
    "response_body": ("secret_in_response_body", False),
}


def pieces(exchanges: DataFrame) -> DataFrame:
    """An exchange as its scannable texts: ``kind, header, text``."""

    def piece(kind: str, text: Column, when: Column, header: Column | None = None) -> Column:
        name = F.lit(None).cast("string") if header is None else header
        return F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("header"), text.alias("text")))

    def headers(kind: str, column: str, wanted) -> Column:
        entries = F.coalesce(F.map_entries(column), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(entries, lambda e: piece(kind, e["value"], wanted(e["key"]), e["key"]))

    single = F.array(
        piece("query", U.query("url"), U.query("url") != ""),
        piece("request_body", F.col("req_body"), F.col("req_body").isNotNull()),
        piece("response_body", F.col("resp_body"), F.col("resp_body").isNotNull() & is_text_response()),
    )
    everything = F.concat(
        single,
        headers("key_header", "req_headers", lambda k: F.lower(k).isin(*V.KEY_HEADERS)),
        headers("response_header", "resp_headers", lambda k: F.lit(True)),
    )
    return (
        exchanges.select(*_base(exchanges), F.explode(everything).alias("_p"))
        .where(F.col("_p").isNotNull())
        .select(*_base(exchanges), "_p.*")
    )


def pattern_findings(
    exchanges: DataFrame, patterns: Sequence[Pattern], *, keep_userinfo: bool = False
) -> DataFrame:
    """All catalog checks of an exchange in one pass over the table."""
    keep = [*_base(exchanges), "kind", "header"]
    texts = pieces(exchanges)
    first = F.col("kind").isin(*[k for k, (_, only_first) in _KINDS.items() if only_first])
    hits = detect.scan(texts, "text", patterns, keep=keep, raw=True, cap=V.CAP_RESPONSE_BODY, first_only=first)
    kind = F.col("kind")
    https = U.scheme("url") == "https"
    expected = https & (F.lower("header") == "authorization")
    type_ = F.lit(None).cast("string")
    for name, (finding, _) in _KINDS.items():
        type_ = F.when(kind == name, finding).otherwise(type_)
    text = (
        F.when(kind == "query", _text("API key ", " exposed in URL query string (logged in browser history, proxy logs, server logs)"))
        .when(
            (kind == "key_header") & expected,
            _text("", " in Authorization header over HTTPS (expected for server-side API calls, review if unexpected)"),
        )
        .when((kind == "key_header") & ~https, _text("API key ", " transmitted over insecure HTTP (unencrypted)"))
        .when(kind == "key_header", F.concat(_text("Potential ", " in header "), "header"))
        .when(kind == "request_body", _text("Potential ", " in request body"))
        .when(kind == "response_header", F.concat(_text("Secret ", " leaked in response header "), "header"))
        .otherwise(_text("Secret ", " leaked in response body"))
    )
    high = (kind == "request_body") | ((kind == "key_header") & https)
    body = kind == "response_body"
    return _request_finding(
        hits,
        keep_userinfo,
        type=type_,
        severity=F.when(high, "HIGH").otherwise("CRITICAL"),
        pattern="pattern",
        header="header",
        snippet=F.when(body, F.col("snippet")),
        original_length=F.when(body, F.col("original_length")),
        description=text,
    )


def _text(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("pattern"), F.lit(after))


def scan_traffic(exchanges: DataFrame, patterns: Sequence[Pattern], *, keep_userinfo: bool = False) -> DataFrame:
    """All request and response checks.

    The catalog runs in one pass over the exchanges; the three checks without a
    catalog read only the url, the request headers and the request body.
    """
    kw = {"keep_userinfo": keep_userinfo}
    return (
        pattern_findings(exchanges, patterns, **kw)
        .unionByName(url_credentials(exchanges, **kw))
        .unionByName(basic_auth(exchanges, **kw))
        .unionByName(plaintext_password(exchanges, **kw))
    )


# --- the traffic log --------------------------------------------------------


def stamp(findings: DataFrame) -> DataFrame:
    """Findings as log records: the stage and the readable time beside the epoch."""
    return findings.withColumns(
        {"stage": F.lit(V.STAGE_FINDING), "timestamp": S.human_time("ts")}
    )


def split_log(log: DataFrame) -> DataFrame:
    """Log rows as findings: a proxied request is INFO, a security finding keeps its
    fields, a bypassed request is only counted (see :func:`stage_counts`)."""
    proxied = F.col("stage") == V.STAGE_PROXIED
    request = F.concat(
        F.lit("Proxied request via MITM: "),
        S.shown("method"),
        F.lit(" "),
        S.shown("url"),
        F.lit(" (client="),
        S.shown("client"),
        F.lit(")"),
    )
    rows = log.where(F.col("stage").isin(V.STAGE_PROXIED, V.STAGE_FINDING))
    description = F.when(proxied, request).otherwise(F.col("description"))
    summary = F.when(~proxied, F.coalesce("description", F.lit("MITM security finding")))
    only_finding = {c: F.when(~proxied, F.col(c)) for c in ("pattern", "field", "header") if c in log.columns}
    return as_findings(
        rows,
        type=F.when(proxied, F.lit("mitm_proxied_request")).otherwise(F.col("type")),
        severity=F.when(proxied, F.lit("INFO")).otherwise(F.col("severity")),
        source=S.first_text("client", F.lit("mitm")),
        summary=S.first_text(summary, description),
        description=description,
        client="client",
        method="method",
        url="url",
        ts="ts",
        **only_finding,
    )


def stage_counts(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(F.col("stage") == V.STAGE_PROXIED).alias("proxied"),
        F.count_if(F.col("stage") == V.STAGE_BYPASSED).alias("bypassed"),
        F.count_if(F.col("stage") == V.STAGE_FINDING).alias("security_findings"),
    )


def counters(messages: DataFrame, *, kind: str = "kind", url: str = "url") -> DataFrame:
    """Requests, responses and ignored messages; ignored ones count on the request side only."""
    skip = ignored(url)
    return messages.agg(
        F.count_if((F.col(kind) == "request") & ~skip).alias("requests"),
        F.count_if((F.col(kind) == "response") & ~skip).alias("responses"),
        F.count_if((F.col(kind) == "request") & skip).alias("ignored"),
    )


def newest(log: DataFrame, n: int = 200, *, tie: str | None = None) -> DataFrame:
    """The newest ``n`` entries, as kept for the traffic sample; of one time by ``tie``, or by all columns."""
    return log.orderBy(*_newest_first(log, tie)).limit(n)


def _newest_first(log: DataFrame, tie: str | None) -> list[Column]:
    rest = [tie] if tie else [c for c, kind in log.dtypes if c != "ts" and "map<" not in kind]
    return [F.col("ts").desc(), *[F.col(c).desc() for c in rest]]


def newest_per_client(log: DataFrame, n: int = 200, *, tie: str | None = None) -> DataFrame:
    return top_per_key(log, ["client"], _newest_first(log, tie), n)
