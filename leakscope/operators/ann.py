"""Approximate cosine search in a stored index of sign-projection buckets.

Each vector lies in the bucket of the signs of ``bits`` projections.  A projection adds up the vector's
components, as whole numbers, with signs taken from a checksum of the projection's and the component's number,
so any engine finds the same bucket.  The index is a folder of files sorted by bucket, with the number of rows of
each bucket beside it; vectors are added without touching what is there.

A query visits buckets in the order of the projections whose signs differ, weighed by how far the query lies
from the plane, until they hold ``least`` vectors.  Only visited buckets are read; within them the search is exact.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table
from .findings import check_positive
from .top import top_per_key
from .vectors import ROWS_PER_BLOCK, _best, _column, _matrix, _result, require_dimension

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Components are taken as floor(SCALE * x).
SCALE = 1024
#: Projections, and so buckets as a power of two, that an index may have: the counts are held by the driver.
MAX_BITS = 16
#: Queries of a bucket that meet a block of its rows at once.
QUERIES_PER_BLOCK = 50_000


def projections(bits: int, dim: int) -> np.ndarray:
    """A matrix of 1 and -1, ``bits`` by ``dim``: 1 where the SHA-1 of ``bit:component`` begins with 0 to 7."""
    sign = lambda b, j: 1 if hashlib.sha1(f"{b}:{j}".encode()).hexdigest()[0] < "8" else -1
    return np.array([[sign(b, j) for j in range(dim)] for b in range(bits)], dtype=np.int64)


def _margins(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.floor(matrix * SCALE).astype(np.int64) @ planes.T


def bucket_of(vector: Column, planes: np.ndarray) -> Column:
    """Bucket number: bit b is set if projection b is not negative."""

    @F.arrow_udf("int")
    def code(vectors: pa.Array) -> pa.Array:
        signs = _margins(_matrix(vectors, planes.shape[1]), planes) >= 0
        return pa.array((signs << np.arange(len(planes))).sum(axis=1), pa.int32())

    return code(vector)


def create_index(spark: SparkSession, path: str, dim: int, bits: int = 8) -> None:
    """An empty index at a new folder."""
    if not 1 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be 1 to {MAX_BITS}, got {bits}")
    check_positive("dim", dim)
    spark.createDataFrame([(dim, bits)], "dim int, bits int").coalesce(1).write.parquet(f"{path}/shape")


def _shape(spark: SparkSession, path: str) -> np.ndarray:
    row = spark.read.parquet(f"{path}/shape").first()
    return projections(row["bits"], row["dim"])


def add_vectors(path: str, vectors: DataFrame, *, id_col: str = "id", vec_col: str = "vector") -> None:
    """Append vectors of new ids; null vectors are left out, another dimension is an error.

    The counts name the addition that they belong to and are written last, so vectors of an addition that failed are not seen.
    """
    planes = _shape(vectors.sparkSession, path)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector")).where("vector is not null")
    rows = require_dimension(rows, planes.shape[1]).withColumn("bucket", bucket_of(F.col("vector"), planes))
    addition = uuid.uuid4().hex
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2^bits rows
    # Sorted by bucket, so that a search skips the pages of all others; many rows of one bucket go to several files.
    dealt = rows.withColumn("_order", F.xxhash64("id")).repartitionByRange("bucket", "_order").sortWithinPartitions("bucket").drop("_order")
    dealt.withColumn("addition", F.lit(addition)).write.mode("append").partitionBy("addition").parquet(f"{path}/vectors")
    found = vectors.sparkSession.createDataFrame([(addition, r["bucket"], r["n"]) for r in counts], "addition string, bucket int, n long")
    found.coalesce(1).write.mode("append").parquet(f"{path}/counts")


def bucket_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each addition and bucket."""
    return spark.read.schema("addition string, bucket int, n long").parquet(f"{path}/counts")


def probes(spark: SparkSession, path: str, queries: DataFrame, least: int) -> DataFrame:
    """``query_id, vector, bucket, n``: the buckets that a query visits, until they hold ``least`` rows, and their rows."""
    planes = _shape(spark, path)
    held = bucket_counts(spark, path).groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()
    codes, sizes = np.array([r["bucket"] for r in held], np.int64), np.array([r["n"] for r in held], np.int64)
    signs = (codes[:, None] >> np.arange(len(planes))) & 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _margins(_matrix(batch.column("vector"), planes.shape[1]), planes)
            for i, m in enumerate(margins):
                cost = np.where(signs != (m >= 0), np.abs(m), 0).sum(axis=1)
                order = np.lexsort((codes, cost))
                before = np.cumsum(sizes[order]) - sizes[order]
                order = order[before < least]
                one = batch.slice(i, 1).take(pa.array([0] * len(order), pa.int32()))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(codes[order], pa.int32()), pa.array(sizes[order])], names=["query_id", "vector", "bucket", "n"])

    kinds = dict(queries.dtypes)
    rows = queries.select("query_id", "vector").where("vector is not null")
    return rows.mapInArrow(visit, f"query_id {kinds['query_id']}, vector {kinds['vector']}, bucket int, n long")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, *, least: int) -> DataFrame:
    """``query_id, id, similarity, rank``: the best ``k`` among the rows of the visited buckets, ties by id.

    ``queries`` has ``query_id, vector``.  Rows and queries of a bucket meet in blocks of bounded size.
    """
    check_positive("k", k)
    visited = probes(spark, path, queries, max(k, least))
    counts = visited.groupBy("bucket", "n").count().collect()  # at most 2^bits rows
    rows = spark.read.parquet(f"{path}/vectors") if counts else None
    if rows is None:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id long, similarity double, rank int")
    known = [r["addition"] for r in bucket_counts(spark, path).select("addition").distinct().collect()]  # one for each addition
    rows = rows.where(F.col("addition").isin(known) & F.col("bucket").isin([r["bucket"] for r in counts])).select("id", "vector", "bucket")
    blocks = [(r["bucket"], ceil(r["n"] / ROWS_PER_BLOCK), ceil(r["count"] / QUERIES_PER_BLOCK)) for r in counts]
    blocks = F.broadcast(local_table(spark, blocks, "bucket int, _rows bigint, _queries bigint"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n))
    left = rows.join(blocks, "bucket").select("id", "vector", "bucket", own("_rows", "id").alias("_part"), each("_queries").alias("_qpart"))
    right = visited.join(blocks, "bucket").select("query_id", "vector", "bucket", own("_queries", "query_id", "vector").alias("_qpart"), each("_rows").alias("_part"))
    left, right = left.groupBy("bucket", "_part", "_qpart"), right.groupBy("bucket", "_part", "_qpart")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, qids = _column(a, "id"), _column(b, "query_id")
        if not len(a) or not len(b):
            return pa.table({"query_id": qids[:0], "id": ids[:0], "similarity": pa.array([], pa.float64())})
        qmat = _matrix(b.column("vector"))
        return pa.Table.from_batches([_best(ids, _matrix(a.column("vector"), qmat.shape[1]), qids, qmat, k)])

    found = left.cogroup(right).applyInArrow(meet, _result(rows, queries))
    return top_per_key(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
