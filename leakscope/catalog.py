"""Pattern catalog: the ordered list of named regexes that every detector runs.

The catalog is configuration.  It is small, lives on the driver, and reaches the
executors as literals of the plan, so each regex is compiled once per task.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import values as V
from .session import local_table

MAX_CATALOG_ROWS = 10_000


@dataclass(frozen=True)
class Pattern:
    """One catalog entry; ``raw_name`` is the key, ``name`` the display name."""

    ord: int
    raw_name: str
    regex: str

    @property
    def name(self) -> str:
        return self.raw_name.replace("_", " ").title()

    @property
    def guard(self) -> str | None:
        return literal_guard(self.regex)


# Names and regexes, in order.  Every regex is valid in Java and in RE2.
DEFAULT_ENTRIES = (
    ("AWS_ACCESS_KEY_ID", r"AKIA[0-9A-Z]{16}"),
    ("OPENAI_API_KEY", r"sk-[a-zA-Z0-9]{20,}"),
    ("STRIPE_SECRET_KEY", r"sk_live_[0-9a-zA-Z]{24,}"),
    ("GITHUB_TOKEN", r"ghp_[0-9a-zA-Z]{36}"),
    ("GENERIC_API_KEY", r"""(?i)api[_-]?key['"]?\s*[:=]\s*['"]?[a-zA-Z0-9_-]{20,}"""),
    ("GENERIC_SECRET", r"""(?i)secret['"]?\s*[:=]\s*['"]?[a-zA-Z0-9_-]{20,}"""),
    ("PRIVATE_KEY", r"-----BEGIN (RSA|PRIVATE|OPENSSH|EC) (PRIVATE )?KEY-----"),
    ("GITHUB_PAT", r"(?:ghp|gho)_[A-Za-z0-9_]{36}"),
    ("GOOGLE_API_KEY", r"AIza[0-9A-Za-z_-]{35}"),
    ("STRIPE_TEST_KEY", r"sk_test_[0-9a-zA-Z]{24,}"),
    ("GROQ_API_KEY", r"gsk_[A-Za-z0-9]{40,}"),
    ("HUGGINGFACE_TOKEN", r"hf_[A-Za-z0-9]{30,}"),
    ("REPLICATE_API_TOKEN", r"r8_[A-Za-z0-9]{37,}"),
    ("SLACK_TOKEN", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("GITHUB_OAUTH_TOKEN", r"gho_[0-9a-zA-Z]{36}"),
    ("GITLAB_PAT", r"glpat-[A-Za-z0-9_-]{20,}"),
    ("SENDGRID_API_KEY", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    ("MAILGUN_API_KEY", r"key-[0-9a-f]{32}"),
    ("SQUARE_TOKEN", r"sq0[a-z]{3}-[A-Za-z0-9_-]{22,}"),
    ("SHOPIFY_ACCESS_TOKEN", r"shpat_[0-9a-fA-F]{32}"),
    ("JSON_WEB_TOKEN", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("MONGODB_URL", r"mongodb(?:\+srv)?://[^\s:@/]+:[^\s:@/]+@[^\s]+"),
    ("POSTGRES_URL", r"postgres(?:ql)?://[^\s:@/]+:[^\s:@/]+@[^\s]+"),
    ("MYSQL_URL", r"mysql://[^\s:@/]+:[^\s:@/]+@[^\s]+"),
    ("REDIS_URL", r"redis://[^\s:@/]*:[^\s:@/]+@[^\s]+"),
    ("NOTION_SECRET", r"secret_[A-Za-z0-9]{43}"),
    ("NOTION_TOKEN", r"ntn_[A-Za-z0-9]{40,}"),
    ("PYPI_TOKEN", r"pypi-[A-Za-z0-9_-]{16,}"),
    ("BEARER_TOKEN", r"(?i)bearer\s+[a-zA-Z0-9._~+/-]{20,}"),
    ("GOOGLE_OAUTH_TOKEN", r"ya29\.[A-Za-z0-9_-]{20,}"),
    ("GENERIC_TOKEN", r"""(?i)token['"]?\s*[:=]\s*['"]?[a-zA-Z0-9_-]{20,}"""),
)
FALLBACK_NAMES = ("GENERIC_API_KEY", "GENERIC_SECRET", "PRIVATE_KEY")


def make_catalog(entries) -> list[Pattern]:
    """Patterns from ``(name, regex)`` pairs; a later entry of the same name replaces the earlier."""
    merged = dict(entries)
    return [Pattern(i, name, regex) for i, (name, regex) in enumerate(merged.items())]


def default_catalog() -> list[Pattern]:
    return make_catalog(DEFAULT_ENTRIES)


def fallback_catalog() -> list[Pattern]:
    return make_catalog((n, r) for n, r in DEFAULT_ENTRIES if n in FALLBACK_NAMES)


def literal_guard(regex: str) -> str | None:
    """A literal that every match starts with, or None.

    Testing ``contains`` on it first skips the regex for most texts.  Only plain
    leading characters count, and an alternation outside brackets rules it out.
    """
    depth, in_class, escaped = 0, False, False
    for c in regex:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return None
    lead = re.match(r"[A-Za-z0-9_\- :/]*", regex).group(0)
    if len(lead) < len(regex) and regex[len(lead)] in "?*{":
        lead = lead[:-1]
    return lead if len(lead) >= 2 else None


def spans_lines_safely(regex: str) -> bool:
    """True if a match inside one line is also a match inside the whole text."""
    return not re.search(r"\^|\$|\\[AZzbBG]|\(\?[=!<]|\(\?[a-z]*[mx]", regex.replace("[^", "["))


def prefilter_regex(regex: str) -> str | None:
    """A regex for a linear-time engine that matches wherever this one does, or None.

    White space is widened by the one character that only Java counts; constructs
    whose meaning differs between the engines have no equivalent.
    """
    if re.search(r"\$|\\[bBAZzGRXhHvVpPNk1-9]|\(\?[=!<>]|[*+?}]\+|&&|\(\?[a-z]*[mxudU]", regex):
        return None
    out, i, in_class, negated = "", 0, False, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            pair = regex[i : i + 2]
            if pair == "\\s" and not negated:
                pair = r"\s\x0B" if in_class else r"[\s\x0B]"
            out, i = out + pair, i + 2
            continue
        if c == "[" and not in_class:
            in_class, negated = True, regex[i + 1 : i + 2] == "^"
        elif c == "]" and in_class:
            in_class, negated = False, False
        out, i = out + c, i + 1
    return out


def valid_regex(spark: SparkSession, regex: str) -> bool:
    """Whether the Java engine compiles the regex; asked on the driver, without a job."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
        return True
    except (Py4JJavaError, PySparkException):
        return False


def read_catalog(spark: SparkSession, path: str | None, missing: str = "fallback") -> list[Pattern]:
    """Read ``KEY=REGEX`` lines; ``#`` lines, blank lines and invalid regexes are left out.

    A missing file gives the fallback patterns (``missing="fallback"``) or an error.
    """
    try:
        lines = spark.read.text(path).limit(MAX_CATALOG_ROWS + 1).collect() if path else None
    except AnalysisException:
        if missing != "fallback":
            raise
        lines = None
    if lines is None:
        return fallback_catalog()
    if len(lines) > MAX_CATALOG_ROWS:
        raise ValueError(f"catalog has more than {MAX_CATALOG_ROWS} lines")
    entries = []
    for row in lines:
        key, eq, regex = row.value.strip().partition("=")
        if key.startswith("#") or not eq or not regex.strip():
            continue
        if valid_regex(spark, regex.strip()):
            entries.append((key.strip(), regex.strip()))
        else:
            warnings.warn(f"invalid regex left out of the catalog: {key.strip()}")
    return make_catalog(entries)


def parse_catalog_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """The same rules for a catalog held as a table of lines: ``raw_name, name, regex``."""
    line = F.trim(F.col(col))
    kv = F.split(line, "=", 2)
    return (
        lines.where(~line.startswith("#") & line.contains("="))
        .select(F.trim(kv[0]).alias("raw_name"), F.trim(kv[1]).alias("regex"))
        .where(F.col("regex") != "")
        .withColumn("name", F.initcap(F.replace("raw_name", F.lit("_"), F.lit(" "))))
    )


def prefix_terms(patterns: list[Pattern]) -> list[tuple[str, str, int]]:
    """Literal search terms of the catalog as ``(term, pattern name, order)``.

    Each regex gives at most one term by the first rule that fits; a term found
    twice keeps its first place and its last pattern.
    """
    found: dict[str, str] = {}
    for p in patterns:
        term = next((t for start, t in V.PREFIX_TERMS if p.regex.startswith(start)), None)
        term = term or next((t for part, t in V.CONTAINED_TERMS if part in p.regex), None)
        term = term or next((t for part, t in V.CONTAINED_TERMS_LOWER if part in p.regex.lower()), None)
        term = term or next((t for part, t in V.CONTAINED_TERMS_LAST if part in p.regex), None)
        if term:
            found[term] = p.name
    return [(term, name, i) for i, (term, name) in enumerate(found.items())]


def catalog_table(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = [(p.ord, p.raw_name, p.name, p.regex) for p in patterns]
    return local_table(spark, rows, "ord int, raw_name string, name string, regex string")
