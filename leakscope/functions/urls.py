"""URL split and join as column expressions.

A regex split is used because ``parse_url`` gives nulls or errors for hosts and
paths that occur in captured traffic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

# RFC 3986 appendix B: scheme, authority, path, query, fragment.
URL_REGEX = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# The host alone, behind user and password and before the port.
HOST_REGEX = r"^(?:[^:/?#]+:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@\[\]]*)"


def _part(url, group: int) -> Column:
    return F.regexp_extract(col(url), URL_REGEX, group)


def scheme(url) -> Column:
    return F.lower(_part(url, 1))


def netloc(url) -> Column:
    return _part(url, 2)


def path(url) -> Column:
    return _part(url, 3)


def query(url) -> Column:
    return _part(url, 4)


def fragment(url) -> Column:
    return _part(url, 5)


def userinfo(url) -> Column:
    return F.regexp_extract(netloc(url), r"^(.*)@", 1)


def hostport(url) -> Column:
    return F.regexp_replace(netloc(url), r"^.*@", "")


def host(url) -> Column:
    """Lower-case host without port and brackets; empty for a relative url."""
    return F.lower(F.translate(F.regexp_extract(col(url), HOST_REGEX, 1), "[]", ""))


def origin(url) -> Column:
    return F.concat(_part(url, 1), F.lit("://"), netloc(url))


def redacted(url, keep_userinfo: bool = False) -> Column:
    """Scheme, host and path only.  ``keep_userinfo`` also keeps ``user:pass@``."""
    where = netloc(url) if keep_userinfo else hostport(url)
    return F.concat(scheme(url), F.lit("://"), where, path(url))


def same_host(url, base_host) -> Column:
    """Relative urls, the base host and the local machine pass."""
    h = host(url)
    return (netloc(url) == "") | (h == col(base_host)) | h.isin("localhost", "127.0.0.1")


def _without_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` of a rooted path."""
    segments = F.split(F.substring(p, 2, 2**31 - 1), "/")
    resolved = F.aggregate(
        segments,
        F.lit(""),
        lambda acc, s: F.when(s == "..", F.regexp_replace(acc, r"/[^/]*$", ""))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.lit("/"), s)),
    )
    ends_open = p.rlike(r"/\.\.?$")
    resolved = F.when(ends_open, F.concat(resolved, F.lit("/"))).otherwise(resolved)
    resolved = F.when(resolved == "", F.lit("/")).otherwise(resolved)
    return F.when(p.rlike(r"/\.\.?(/|$)"), resolved).otherwise(p)


def join(base, ref) -> Column:
    """Resolve a reference against the url of the page that holds it."""
    b, r = col(base), col(ref)
    ref_path = F.regexp_extract(r, r"(?s)^([^?#]*)", 1)
    ref_rest = F.regexp_extract(r, r"(?s)^[^?#]*(.*)$", 1)
    base_path = path(b)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    merged = F.regexp_replace(F.concat(folder, ref_path), r"/{2,}", "/")
    up_to_query = F.regexp_replace(b, r"(?s)#.*$", "")
    up_to_path = F.regexp_replace(b, r"(?s)[?#].*$", "")
    return (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
        .when(r == "", b)
        .when(r.startswith("//"), F.concat(_part(b, 1), F.lit(":"), r))
        .when(r.startswith("#"), F.concat(up_to_query, r))
        .when(r.startswith("?"), F.concat(up_to_path, r))
        .when(r.startswith("/"), F.concat(origin(b), _without_dots(ref_path), ref_rest))
        .otherwise(F.concat(origin(b), _without_dots(merged), ref_rest))
    )
