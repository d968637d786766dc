"""Pattern detection: the one scan that every detector calls.

A scan has two steps and no shuffle.  A filter first tests each text for all
patterns at once: one automaton of the whole catalog runs over Arrow batches, so
its cost does not grow with the number of patterns.  The few texts that pass get
the exact test, where each regex is a literal of the plan.  A matched value is
never emitted; only its pattern, its length and the redaction mark are.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..catalog import Pattern, prefilter_regex, spans_lines_safely
from ..functions.scalars import col, text_array, text_literal

HIT_COLUMNS = ("ord", "pattern", "snippet", "original_length")


def might_match(text, regexes: Sequence[str]) -> Column | None:
    """Whether any regex may match, by one linear pass; never false for a match.

    None, with a warning, if a regex has no equivalent for the automaton: then all texts go through the exact regexes.  Text that is not valid
    UTF-8 passes, as the two engines decode it differently.
    """
    wide = [prefilter_regex(r) for r in regexes]
    if not wide:
        return None
    if None in wide:
        warnings.warn(f"no fast filter: {regexes[wide.index(None)]!r} has no equivalent in linear time")
        return None
    combined = "|".join(f"(?:{r})" for r in wide)
    try:
        pc.match_substring_regex(pa.array([""]), combined)
    except pa.ArrowInvalid as e:
        warnings.warn(f"no fast filter: {e}")
        return None

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as compute

        return compute.match_substring_regex(texts, combined)

    t = col(text)
    return test(t) | ~F.is_valid_utf8(t)


def candidates(df: DataFrame, text: str, regexes: Sequence[str]) -> DataFrame:
    """Rows whose text may match; all rows when that cannot be tested."""
    test = might_match(text, regexes)
    return df if test is None else df.where(test)


def _test(name: str, pattern: Pattern) -> str:
    """Unanchored search as SQL, with the cheap literal test first where the regex has one."""
    found = f"{name} RLIKE {text_literal(pattern.regex)}"
    return f"contains({name}, {text_literal(pattern.guard)}) AND {found}" if pattern.guard else found


def _indexes_of(name: str, patterns: Sequence[Pattern]) -> list[str]:
    """Per pattern its position where the text matches, else null.

    The catalog is written as SQL text: one expression instead of a few per pattern.
    """
    return [f"CASE WHEN {_test(name, p)} THEN {i} END" for i, p in enumerate(patterns)]


def all_indexes(name: str, patterns: Sequence[Pattern]) -> Column:
    return F.expr(f"array({', '.join(_indexes_of(name, patterns))})")


def first_index(name: str, patterns: Sequence[Pattern]) -> Column:
    """Position of the first pattern in catalog order that matches, or null."""
    return F.expr(f"coalesce({', '.join(_indexes_of(name, patterns))})")


def _entry(values: Sequence[str], index: Column) -> Column:
    return F.element_at(text_array(values), index + 1)


def _regex(patterns: Sequence[Pattern]) -> Column:
    return _entry([p.regex for p in patterns], F.col("_i"))


def _match_length(patterns: Sequence[Pattern]) -> Column:
    found = F.call_function("regexp_extract", F.col("_text"), _regex(patterns), F.lit(0))
    return F.length(found)


def _indexes(df: DataFrame, text: str, patterns: Sequence[Pattern], keep: Sequence[str], index: Column) -> DataFrame:
    """``keep``, the text and ``_i``, one row per entry of the array ``index`` that is not null.

    The regexes sit inside an explode of an array literal, as the optimizer would
    move a plain condition on them in front of the candidate test.
    """
    rows = candidates(df.select(*keep, col(text).alias("_text")), "_text", [p.regex for p in patterns])
    return rows.select("*", F.explode(index).alias("_i")).where(F.col("_i").isNotNull())


def scan(
    df: DataFrame,
    text: str,
    patterns: Sequence[Pattern],
    *,
    keep: Sequence[str],
    mode: str = "all",
    cap: int | None = None,
    raw: bool = False,
    first_only: Column | None = None,
) -> DataFrame:
    """``keep`` plus one row per (row, matching pattern), or per row in mode ``first``.

    ``first_only`` switches single rows to mode ``first``.
    """
    if mode not in ("all", "first"):
        raise ValueError(f"mode must be 'all' or 'first', got {mode!r}")
    first = F.array(first_index("_text", patterns))
    every = all_indexes("_text", patterns)
    if mode == "all" and first_only is not None:
        chosen = F.array(F.when(first_only, first).otherwise(every))
        found = _indexes(df, text, patterns, keep, chosen).withColumnRenamed("_i", "_is")
        found = found.select("*", F.explode("_is").alias("_i")).where(F.col("_i").isNotNull())
    else:
        found = _indexes(df, text, patterns, keep, every if mode == "all" else first)
    length = _match_length(patterns)
    return found.select(
        *keep,
        F.expr(f"element_at(array({', '.join(str(p.ord) for p in patterns)}), _i + 1)").alias("ord"),
        _entry([p.raw_name if raw else p.name for p in patterns], F.col("_i")).alias("pattern"),
        F.lit(V.REDACTED).alias("snippet"),
        (length if cap is None else F.least(length, F.lit(cap))).alias("original_length"),
    )


def scan_lines(
    df: DataFrame,
    text: str,
    patterns: Sequence[Pattern],
    *,
    keep: Sequence[str],
    cap: int | None = None,
    sep: str = "\n",
) -> DataFrame:
    """Every (line, pattern) hit with its ``line_no``.

    Texts without any hit are dropped before they are split: a match inside a
    line is a match inside the text, unless a regex uses anchors.
    """
    if all(spans_lines_safely(p.regex) for p in patterns):
        df = candidates(df, text, [p.regex for p in patterns])
    lines = df.select(*keep, F.posexplode(F.split(col(text), sep)).alias("line_no", "_line"))
    return scan(lines, "_line", patterns, keep=[*keep, "line_no"], cap=cap)


def occurrences(df: DataFrame, text: str, patterns: Sequence[Pattern], *, keep: Sequence[str]) -> DataFrame:
    """Number of matches per (row, pattern) and the length of the first one."""
    every = all_indexes("_text", patterns)
    found = _indexes(df, text, patterns, keep, every)
    return found.select(
        *keep,
        F.expr(f"element_at(array({', '.join(str(p.ord) for p in patterns)}), _i + 1)").alias("ord"),
        _entry([p.name for p in patterns], F.col("_i")).alias("pattern"),
        F.regexp_count("_text", _regex(patterns)).alias("occurrences"),
        _match_length(patterns).alias("original_length"),
    )


def scan_with_table(df: DataFrame, text: str, catalog: DataFrame, *, keep: Sequence[str], max_patterns: int = 1000) -> DataFrame:
    """Scan with a catalog that is a table ``(ord, name, regex)``.

    The table is read into literals, so it is checked to be small first.
    """
    rows = catalog.select("ord", "raw_name", "regex").orderBy("ord").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"catalog table has more than {max_patterns} patterns")
    return scan(df, text, [Pattern(*r) for r in rows], keep=keep)


def redact(text, regexes: Sequence[str] = V.REDACTION_REGEXES) -> Column:
    """Replace every match of each regex in turn by the redaction mark."""
    out = col(text)
    for regex in regexes:
        out = F.regexp_replace(out, regex, V.REDACTED)
    return out


def redact_keeping_citations(text, regexes: Sequence[str] = V.REDACTION_REGEXES) -> Column:
    """Redaction that leaves ``[Source: id]`` spans alone, as an id looks like a token.

    The text is cut before and after each span by marks that cannot survive in it.
    """
    mark = "\u0001"
    marked = F.regexp_replace(F.replace(col(text), F.lit(mark), F.lit("")), r"(\[Source: [^\]]*\])", f"{mark}$1{mark}")
    parts = F.transform(
        F.split(marked, mark),
        lambda s: F.when(s.rlike(r"^\[Source: [^\]]*\]$"), s).otherwise(redact(s, regexes)),
    )
    return F.array_join(parts, "")


def unescape_html(text) -> Column:
    """Decode the five basic entities, for scans of html source."""
    out = col(text)
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def within_limits(text, *, max_bytes: int | None = None, max_chars: int | None = None) -> Column:
    """Whether a text is inside the size limits; None sets no limit."""
    ok = F.lit(True)
    if max_bytes is not None:
        ok = ok & (F.octet_length(col(text)) <= max_bytes)
    if max_chars is not None:
        ok = ok & (F.length(col(text)) <= max_chars)
    return ok
