"""Lines of text files of any size: a file is read by as many tasks as it has splits, and a line is a row."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..session import small

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _binary(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Files with a NUL in their first ``window`` bytes, from the lines of their first splits."""
    file, offset, found = None, 0, set()
    for batch in batches:
        names, lines = batch.column("path"), batch.column("line")
        cuts = (np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist() if len(batch) > 1 else []
        bounds = [0, *cuts, len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            if names[a].as_py() != file:
                file, offset = names[a].as_py(), 0
            if offset < window and file not in found:
                own = lines.slice(a, b - a)
                sizes = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                starts = offset + np.cumsum(sizes) - sizes
                at = pc.find_substring(own.cast(pa.binary()), b"\0").to_numpy(zero_copy_only=False)
                if ((at >= 0) & (starts + at < window)).any():
                    found.add(file)
                offset = int(starts[-1] + sizes[-1])
    if found:
        yield pa.RecordBatch.from_pydict({"path": pa.array(sorted(found), pa.string())})


def read_text_lines(spark: SparkSession, path: str, *, exclude: Sequence[str] = V.BINARY_SUFFIXES, glob: str | None = None, window: int = 4096, max_bytes: int | None = None) -> DataFrame:
    """``path, line`` of the text files below a folder.

    Left out are files of an excluded suffix, in any case, and files with a NUL in their first ``window`` bytes, which are looked for
    in each file's first split alone (splits are far larger than the window).
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    named = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.col("_metadata.file_size").alias("_size"))
    if exclude:
        named = named.where(~F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in exclude) + ")$"))
    if max_bytes is not None:
        named = named.where(F.col("_size") <= max_bytes)
    first = named.where(F.col("block") == 0).select("path", "line")
    binary = first.mapInArrow(lambda batches: _binary(batches, window), "path string")
    return named.select("path", "line").join(small(binary), "path", "left_anti")
