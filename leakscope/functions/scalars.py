"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_literal(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(items) -> Column:
    """An array literal of texts, built as one expression."""
    return F.expr("array(" + ", ".join(text_literal(i) for i in items) + ")")


def sha1(c) -> Column:
    return F.sha1(col(c))


def title(c) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def first_text(*cols) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def shown(c) -> Column:
    """Text form in descriptions, where a missing value reads ``None``."""
    return F.coalesce(col(c).cast("string"), F.lit("None"))


def severity_rank(c) -> Column:
    names = list(V.SEVERITY_RANK)
    by_rank = sorted(names, key=V.SEVERITY_RANK.get)
    return F.greatest(F.array_position(text_array(by_rank), F.upper(F.coalesce(col(c), F.lit("")))), F.lit(1)).cast("int")


def human_time(c) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(start + F.make_dt_interval(secs=col(c).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def looks_hashed(c) -> Column:
    """bcrypt or argon2 prefix, 64 or 128 hex digits, or base64 text longer than 40."""
    v = col(c)
    n = F.length(v)
    hashed = (
        v.rlike(r"^\$2[aby]\$")
        | v.startswith("$argon2")
        | (n.isin(64, 128) & v.rlike(r"^[0-9a-fA-F]+$"))
        | ((n > 40) & v.rlike(r"^[A-Za-z0-9+/=]+$"))
    )
    return F.coalesce((n >= 8) & hashed, F.lit(False))


def any_contains(c, parts) -> Column:
    """True if the text holds one of the literals."""
    return col(c).rlike("|".join(re.escape(p) for p in parts))


def finding_id(type_, summary, snippet) -> Column:
    parts = [F.coalesce(col(c), F.lit("")) for c in (type_, summary, snippet)]
    return F.sha1(F.concat_ws("|", *parts))


def endpoint_id(method, url) -> Column:
    return F.sha1(F.concat_ws("|", F.coalesce(col(method), F.lit("")), col(url)))


def entropy(c) -> Column:
    """Shannon entropy of the characters of a text, in bits."""
    t = col(c)
    n = F.length(t)
    return F.aggregate(
        F.array_distinct(F.split(t, "")),
        F.lit(0.0),
        lambda acc, ch: acc - _p_log_p((n - F.length(F.replace(t, ch, F.lit("")))) / n),
    )


def _p_log_p(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)
