"""Version history as text: the output of a log with patches, in files of any size.

A file is read by as many tasks as it has splits.  What a line belongs to (commit, time, file of the patch) may stand in an
earlier split.  So a first pass takes from each split only what it hands on to the next, a running fold
over these summaries, one row a split, says what each split begins with, and the second pass fills it in.
Lines are never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a line belongs to: commit, its date, file of the patch, number of the file in the commit and of the line in the file.
PLACE = "commit string, date string, path string, file_no int, line_no int"
SUMMARY = f"file string, block long, has_commit boolean, has_date boolean, has_file boolean, {PLACE}"


def _last(mask: np.ndarray) -> np.ndarray:
    """For each place the last one up to it at which the mask holds; -1 if none."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    return values.take(pa.array(at, pa.int64(), mask=at < 0))


class _Split:
    """The lines of a split, batch by batch, and what is known at the end of the last one."""

    def __init__(self, key):
        self.key, self.commit, self.date, self.path = key, None, None, None
        self.has_commit = self.has_date = self.has_file = False
        self.file_no, self.line_no = 0, -1

    def add(self, lines: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        """What each line belongs to, as far as this split tells; ``*_open`` marks what an earlier one has to."""
        begins = {n: pc.starts_with(lines, p).to_numpy(zero_copy_only=False) for n, p in (("commit", "commit "), ("date", "Date:"), ("file", "diff --git "))}
        at = {n: _last(m) for n, m in begins.items()}
        own = {n: at[n] >= 0 for n in at}
        at["date"], at["file"] = (np.where(at[n] > at["commit"], at[n], -1) for n in ("date", "file"))
        own["date"], own["file"] = own["commit"] | (at["date"] >= 0), own["commit"] | (at["file"] >= 0)
        commit = _taken(pc.list_element(pc.split_pattern(pc.if_else(pa.array(begins["commit"]), lines, "commit ?"), " ", max_splits=2), 1), at["commit"])
        date = _taken(pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(lines, 5)), at["date"])
        heads = pc.if_else(pa.array(begins["file"]), lines, "")
        named = [pc.struct_field(pc.extract_regex(heads, p), "path") for p in (r'^diff --git .* "?b/(?P<path>.*?)"?$', r'^diff --git "?a/(?P<path>.*?)"?$')]
        path = _taken(pc.coalesce(*named), at["file"])
        path = pc.if_else(pa.array((at["file"] >= 0)), pc.fill_null(path, "unknown"), path)
        files, number = np.cumsum(begins["file"]), np.arange(len(lines))
        file_no = np.where(own["commit"], files - files[np.maximum(at["commit"], 0)], files + self.file_no)
        line_no = np.where(at["file"] >= 0, number - at["file"], np.where(own["commit"], -1, self.line_no + number + 1 if self.in_file() else -1))
        commit = pc.if_else(pa.array(own["commit"]), commit, self.commit)
        date = pc.if_else(pa.array(own["date"]), date, self.date)
        path = pc.if_else(pa.array(own["file"]), path, self.path)
        out = {
            "commit": commit, "date": date, "path": path, "file_no": file_no.astype(np.int32), "line_no": line_no.astype(np.int32),
            "commit_open": ~(own["commit"] | self.has_commit), "date_open": ~(own["date"] | self.has_date), "file_open": ~(own["file"] | self.has_file),
        }
        if len(lines):
            self.has_commit |= bool(own["commit"][-1])
            self.has_date |= bool(own["date"][-1])
            self.has_file |= bool(own["file"][-1])
            self.commit, self.date, self.path = commit[-1].as_py(), date[-1].as_py(), path[-1].as_py()
            self.file_no, self.line_no = int(file_no[-1]), int(line_no[-1])
        return out

    def in_file(self) -> bool:
        """Whether line numbers go on: within a file of a patch, or not known to be outside of one."""
        return self.path is not None or not self.has_file

    def summary(self) -> tuple:
        return (*self.key, self.has_commit, self.has_date, self.has_file, self.commit, self.date, self.path, self.file_no, self.line_no)


def _splits(batches: Iterator[pa.RecordBatch]):
    """Pieces of batches that lie in one split, each with the state of its split."""
    split = None
    for batch in batches:
        block, file = batch.column("block").to_numpy(), batch.column("file")
        cuts = np.flatnonzero((block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(batch) > 1 else []
        bounds = [0, *cuts, len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                key = (file[a].as_py(), int(block[a]))
                if split is None or split.key != key:
                    if split is not None:
                        yield split, None
                    split = _Split(key)
                yield split, batch.slice(a, b - a)
    if split is not None:
        yield split, None


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for split, piece in _splits(batches):
        if piece is None:
            rows.append(split.summary())
        else:
            split.add(piece.column("line"))
    if rows:
        names = [c.split(" ")[0] for c in SUMMARY.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c.split(" ")[1]]) for v, c in zip(zip(*rows), SUMMARY.split(", "))], names=names)


def _fold(table: pa.Table) -> pa.Table:
    """What each split of a file begins with, from the summaries of those before it."""
    out, held = [], {"commit": None, "date": None, "path": None, "file_no": 0, "line_no": -1}
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append({"file": row["file"], "block": row["block"], **held})
        after = dict(held)
        if row["has_commit"]:
            after["commit"] = row["commit"]
        if row["has_date"]:
            after["date"] = row["date"]
        if row["has_file"]:
            after["path"] = row["path"]
        after["file_no"] = row["file_no"] if row["has_commit"] else held["file_no"] + row["file_no"]
        after["line_no"] = row["line_no"] if row["has_file"] else held["line_no"] + row["line_no"] + 1 if held["path"] is not None else -1
        held = after
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("commit", pa.string()), ("date", pa.string()), ("path", pa.string()), ("file_no", pa.int32()), ("line_no", pa.int32())])
    return pa.Table.from_pylist(out, schema)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of patches, and lines of which this split cannot tell."""
    for split, piece in _splits(batches):
        if piece is None:
            continue
        found = split.add(piece.column("line"))
        named = found["line_no"] > 0
        keep = pa.array((found["file_open"] | named) & (pc.binary_length(piece.column("line")).to_numpy(zero_copy_only=False) > 0))
        rows = pa.RecordBatch.from_arrays([*piece.columns, *[x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()]], names=[*piece.schema.names, *found])
        yield rows.filter(keep)


def read_diff_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all patches: ``commit, commit_ts, path, file_no, line_no, sign, line``.

    The text is that of a log with patches: a line ``commit ID``, header lines with ``Date:`` and seconds since 1970
    or an ISO time, an indented message, and sections that begin with ``diff --git``.  Commit and time come from the text, null
    where it has none, and ``unknown`` stands for a path that cannot be read.  Empty lines, which part commits, are left out.
    """
    # A split is a range of a file; a task may have several, each from its first line on.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    starts = lines.mapInArrow(_summaries, SUMMARY).groupBy("file").applyInArrow(_fold, f"file string, block long, {PLACE}")
    marks = "commit_open boolean, date_open boolean, file_open boolean"
    rows = lines.mapInArrow(_placed, f"file string, block long, line string, {PLACE}, {marks}")
    first = small(starts.select("file", "block", *[F.col(c).alias(f"_{c}") for c in ("commit", "date", "path", "file_no", "line_no")]))
    joined = rows.join(first, ["file", "block"])
    date = F.when(F.col("date_open"), F.col("_date")).otherwise(F.col("date"))
    full = joined.withColumn("date_", date).select(
        F.when(F.col("commit_open"), F.col("_commit")).otherwise(F.col("commit")).alias("commit"),
        F.coalesce(F.expr("try_cast(date_ AS long)"), F.unix_seconds(F.expr("try_cast(date_ AS timestamp)"))).alias("commit_ts"),
        F.when(F.col("file_open"), F.col("_path")).otherwise(F.col("path")).alias("path"),
        (F.col("file_no") + F.when(F.col("commit_open"), F.col("_file_no")).otherwise(0)).alias("file_no"),
        (F.col("line_no") + F.when(F.col("file_open"), F.col("_line_no") + 1).otherwise(0)).alias("line_no"),
        F.substring("line", 1, 1).alias("sign"), "line",
    )
    return full.where(F.col("path").isNotNull() & (F.col("line_no") > 0))
