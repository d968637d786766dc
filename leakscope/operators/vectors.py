"""Vector operators: exact and approximate cosine search, batch search, text vectors.

Vectors are ``array<float>`` columns.  A single query runs as a column expression.
A batch of queries runs as a matrix product per Arrow batch inside the tasks, and
a batch emits only its best ``k`` per query.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .findings import check_positive
from .top import top_per_key

# Executors get the search functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = 1e-12
MAX_BROADCAST_QUERIES = 4096
ROWS_PER_BLOCK = 50_000
#: Scores that a task holds at once.
SCORES = 1 << 21


def dot(a, b) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(vector, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed query; null for a zero vector."""
    norm = sqrt(sum(float(x) * float(x) for x in query)) + EPS
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.try_divide(dot(vector, q), F.sqrt(dot(vector, vector)) * F.lit(norm))


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int = 10, *, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The ``k`` most similar vectors: ``id, similarity`` (6 digits, ties by id)."""
    check_positive("k", k)
    sims = vectors.select(F.col(id_col).alias("id"), F.round(cosine(vec_col, query), 6).alias("similarity"))
    return sims.orderBy(F.col("similarity").desc_nulls_last(), "id").limit(k)


def dimension_errors(vectors: DataFrame, dim: int, *, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Vectors of another dimension, with the expected and the found size."""
    return vectors.where(F.size(vec_col) != dim).select(
        F.col(id_col).alias("id"), F.lit(dim).alias("expected"), F.size(vec_col).alias("got")
    )


def require_dimension(vectors: DataFrame, dim: int, *, vec_col: str = "vector") -> DataFrame:
    """The same vectors; the job fails on the first one of another dimension."""
    message = F.concat(F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(vec_col).cast("string"))
    bad = F.raise_error(message).cast(dict(vectors.dtypes)[vec_col])
    return vectors.withColumn(vec_col, F.when(F.size(vec_col) == dim, F.col(vec_col)).otherwise(bad))


# --- batch search -----------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    expected = dim if dim is not None else int(sizes[0]) if n else 0
    if (sizes != expected).any():
        raise ValueError(f"vector dimension mismatch: expected {expected}, got {sizes[sizes != expected][0]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, dim or 0))


def _best(ids: pa.Array, mat: np.ndarray, qids: pa.Array, qmat: np.ndarray, k: int) -> pa.RecordBatch:
    """Best k rows per query by rounded similarity, ties by id; as many queries at once as make ``SCORES`` scores."""
    id_type, qid_type = ids.type, qids.type
    ids, qids = np.array(ids.to_pylist()), qids.to_pylist()
    norms = np.linalg.norm(mat, axis=1)
    safe = np.where(norms == 0, 1.0, norms)
    step = max(1, SCORES // max(1, len(mat)))
    out_q, out_id, out_s = [], [], []
    for j, qid in enumerate(qids):
        at = j % step
        if at == 0:
            some = qmat[j : j + step]
            sims = (some @ mat.T) / safe / (np.linalg.norm(some, axis=1) + EPS)[:, None]
            sims = np.where(norms == 0, -np.inf, np.round(sims, 6))
        s = sims[at]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            rows = np.flatnonzero(s >= cut)
        else:
            rows = np.arange(len(s))
        rows = rows[np.lexsort((ids[rows], -s[rows]))][:k]
        rows = rows[np.isfinite(s[rows])]
        out_q += [qid] * len(rows)
        out_id += ids[rows].tolist()
        out_s += s[rows].tolist()
    return pa.record_batch(
        [pa.array(out_q, qid_type), pa.array(out_id, id_type), pa.array(out_s, pa.float64())],
        names=["query_id", "id", "similarity"],
    )


def _result(v: DataFrame, q: DataFrame) -> str:
    return f"query_id {dict(q.dtypes)['query_id']}, id {dict(v.dtypes)['id']}, similarity double"


def knn_join(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    id_col: str = "id",
    vec_col: str = "vector",
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Exact top ``k`` of every query: ``query_id, id, similarity, rank``.

    ``queries`` has ``query_id, vector``.  A counted, small set of queries goes to every task.  A larger one is cut into blocks that meet blocks
    of vectors, each of bounded size, so neither side is ever held whole.
    """
    check_positive("k", k)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    q = queries.select("query_id", "vector")
    rows = q.limit(max_broadcast + 1).toArrow()
    found = _knn_small(v, q, rows, k) if len(rows) <= max_broadcast else _knn_blocks(v, q, k, max_broadcast)
    return top_per_key(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _knn_small(v: DataFrame, q: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    schema = _result(v, q)
    if not len(rows):
        return v.sparkSession.createDataFrame([], schema)
    qids, qmat = _column(rows, "query_id"), _matrix(rows.column("vector"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _best(b.column(0), _matrix(b.column(1), qmat.shape[1]), qids, qmat, k)

    return v.mapInArrow(search, schema)


def _knn_blocks(v: DataFrame, q: DataFrame, k: int, queries_per_block: int) -> DataFrame:
    nv = max(1, ceil(v.count() / ROWS_PER_BLOCK))
    nq = max(1, ceil(q.count() / queries_per_block))
    last = F.lit(-1).cast("bigint")

    def numbered(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select(
            "*",
            F.pmod(F.xxhash64(key), F.lit(n_own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other) + last)).alias(other),
        )

    left = numbered(v, "id", "_vb", nv, "_qb", nq).groupBy("_vb", "_qb")
    right = numbered(q, "query_id", "_qb", nq, "_vb", nv).groupBy("_vb", "_qb")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, qids = _column(a, "id"), _column(b, "query_id")
        if not len(a) or not len(b):
            return pa.table({"query_id": qids[:0], "id": ids[:0], "similarity": pa.array([], pa.float64())})
        qmat = _matrix(b.column("vector"))
        return pa.Table.from_batches([_best(ids, _matrix(a.column("vector"), qmat.shape[1]), qids, qmat, k)])

    return left.cogroup(right).applyInArrow(search, _result(v, q))


# --- approximate search -----------------------------------------------------


def unit_vectors(vectors: DataFrame, *, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    raw = vectors.select(F.col(id_col).alias("id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("_raw"))
    return Normalizer(inputCol="_raw", outputCol="unit", p=2.0).transform(raw).drop("_raw")


def fit_ann(units: DataFrame, *, bucket_length: float = 0.5, tables: int = 8, seed: int = 7):
    """Random-projection buckets over unit vectors, where L2 distance orders like cosine."""
    lsh = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    return lsh.fit(units)


def cosine_ann(vectors: DataFrame, query: Sequence[float], k: int = 10, *, id_col: str = "id", vec_col: str = "vector", **params) -> DataFrame:
    """Approximate top ``k``: only vectors that share a bucket with the query are compared."""
    check_positive("k", k)
    units = unit_vectors(vectors, id_col=id_col, vec_col=vec_col)
    norm = sqrt(sum(float(x) * float(x) for x in query)) + EPS
    key = Vectors.dense([float(x) / norm for x in query])
    near = fit_ann(units, **params).approxNearestNeighbors(units, key, k, distCol="_d")
    return near.select("id", F.round(1 - F.col("_d") * F.col("_d") / 2, 6).alias("similarity"))


# --- text vectors -----------------------------------------------------------

#: What stands between words.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


@dataclass(frozen=True)
class TextModel:
    """Weight of each bucket of words: ``ln((n + 1) / (df + 1))``, df the number of the n texts with a word of the bucket."""

    weights: tuple[float, ...]


def word_bucket(word: str, dim: int) -> int:
    """The bucket of a word: its SHA-1, so that every engine finds the same."""
    return int(hashlib.sha1(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim


def _bucket_counts(words: pa.Array, dim: int) -> np.ndarray:
    """How many words of each bucket a list of words has, one row a list; empty words do not count."""
    lists = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    bucket = np.array([word_bucket(w, dim) if w else dim for w in coded.dictionary.to_pylist()], dtype=np.int64)
    out = np.zeros((len(words), dim + 1))
    if len(coded):
        np.add.at(out, (np.repeat(np.arange(len(words)), lists), bucket[coded.indices.to_numpy()]), 1)
    return out[:, :dim]


def _words(text) -> Column:
    return F.split(F.lower(F.coalesce(col(text).cast("string"), F.lit(""))), BETWEEN_WORDS)


def fit_text_vectors(texts: DataFrame, text: str = "text", dim: int = 384) -> TextModel:
    """Weights over all texts; each task adds up its own, so ``dim`` numbers a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(dim, np.int64)
        for b in batches:
            df += (_bucket_counts(b.column(0), dim) > 0).sum(axis=0)
            n += len(b)
        if n:
            yield pa.record_batch([pa.array(np.arange(dim, dtype=np.int32)), pa.array(df), pa.array([n] * dim, pa.int64())], names=["bucket", "df", "n"])

    rows = texts.select(_words(text).alias("words")).mapInArrow(count, "bucket int, df long, n long")
    found = rows.groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).orderBy("bucket").collect()
    return TextModel(tuple(log((r["n"] + 1) / (r["df"] + 1)) for r in found) or (0.0,) * dim)


def text_vector(text, model: TextModel) -> Column:
    """Weighted word counts by bucket, scaled to length 1; all zero for a text without weighted words."""
    weights = np.array(model.weights)

    @F.arrow_udf("array<double>")
    def vector(words: pa.Array) -> pa.Array:
        found = _bucket_counts(words, len(weights)) * weights
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        found = found / np.where(norms > 0, norms, 1)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())

    return vector(_words(text))


def text_vectors(texts: DataFrame, model: TextModel, *, keep: Sequence[str], text: str = "text") -> DataFrame:
    return texts.select(*keep, text_vector(text, model).alias("vector"))


def finding_text() -> Column:
    return F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))


def finding_similarity(findings: DataFrame, query: str, *, dim: int = 384, model: TextModel | None = None) -> DataFrame:
    """``id, similarity`` of each finding's summary and snippet to a query; null where either has no weighted word.

    A model that was fitted before (``fit_text_vectors``) can serve many questions.
    """
    texts = findings.select(F.col("finding_id").alias("id"), finding_text().alias("text"))
    model = model or fit_text_vectors(texts, dim=dim)
    asked = findings.sparkSession.createDataFrame([(query,)], "text string").select(text_vector("text", model).alias("vector")).first().vector
    return text_vectors(texts, model, keep=["id"]).select("id", F.round(cosine("vector", asked), 6).alias("similarity"))


def finding_vector_topk(findings: DataFrame, query: str, k: int = 5, *, dim: int = 384, model: TextModel | None = None) -> DataFrame:
    """The ``k`` findings whose summary and snippet are most like the query, ties by id."""
    check_positive("k", k)
    return finding_similarity(findings, query, dim=dim, model=model).orderBy(F.col("similarity").desc_nulls_last(), "id").limit(k)
