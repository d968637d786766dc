"""Exact inner-product search by a pivot-distance index.

Vectors are turned into integers.  One more coordinate, ``sqrt(M - |x|^2)`` with M the
greatest squared length (zero for queries), makes the largest inner product the smallest
distance: ``d^2 = |q|^2 + M - 2 q.x``.  Each vector is kept under its nearest pivot, sorted
by the distance to it.  A query goes outwards from its own distance, annulus by
annulus, and stops where ``|d(q,p) - d(x,p)|`` exceeds the distance of its k-th best row,
as the triangle inequality rules out all that follows.

Vectors whose squared integer length reaches 2^53 are not exact as doubles.  They are few as a rule and
stay out of the index: pairs with one of them are scored by doubles with an error bound, and
those that may be among the first k by whole numbers of any size (``_long_pairs``).

Pivots are a sample of documented size; every vector is searched and every answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

#: Rows of an annulus, which are scored together.
ANNULUS = 256
#: Squared integer length from which doubles are not exact.
EXACT = 2.0**53
#: Candidates and queries that are scored together if one of a pair is long.
SLICE = 1 << 11, 1 << 8


def _finite(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``(vec_id, x, v)``: v is floor(scale * x) for each component; see ``integer_vectors``."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    out = rows.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite)
    return out.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))


def _whole(rows: DataFrame, scale: int) -> DataFrame:
    return rows.withColumn("v", F.transform("x", lambda c: F.floor(F.lit(scale) * c)))


def integer_vectors(rows: DataFrame, id: str, vector: str, scale: int = 1024) -> DataFrame:
    """``(vec_id, v)``: v is floor(scale * x) for each component, of vectors whose squared integer length is below 2^53.

    Rows without an id, null vectors, and those that hold a null or a component that is not finite take no part.
    """
    return _whole(_finite(rows, id, vector), scale).select("vec_id", "v").where(_square() < EXACT)


def long_vectors(rows: DataFrame, id: str, vector: str, scale: int = 1024) -> DataFrame:
    """``(vec_id, x)`` of the other finite vectors, as they came: their whole numbers may exceed a long."""
    return _whole(_finite(rows, id, vector), scale).where(_square() >= EXACT).select("vec_id", "x")


def _square() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)


def _matrix(column, dim: int):
    """Rows of a list column as a matrix of doubles; shorter vectors are filled up with zeros."""
    import numpy as np

    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _distance(lengths, other_lengths, products, longest: float, extra: bool):
    """Distances to pivots; ``extra`` tells that the left side has the additional coordinate too."""
    import numpy as np

    there = np.sqrt(np.maximum(longest - other_lengths, 0))
    own = np.sqrt(np.maximum(longest - lengths, 0))[:, None] * there if extra else 0.0
    full = longest if extra else lengths[:, None]
    return np.sqrt(np.maximum(full + longest - 2 * (products + own), 0))


def build_index(vectors: DataFrame, pivots: int = 64) -> tuple[DataFrame, dict]:
    """Index table ``(pivot, distance, vec_id, v)`` sorted by distance, and what a search needs of it."""
    import numpy as np

    dim, longest = vectors.agg(F.max(F.size("v")), F.max(_square())).first()
    dim, longest = dim or 0, longest or 0.0
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    points = np.zeros((max(1, len(chosen)), dim))
    for i, r in enumerate(chosen):
        points[i, : len(r["v"])] = r["v"]
    norms = (points**2).sum(axis=1)

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            d = _distance((x**2).sum(axis=1), norms, x @ points.T, longest, True)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), batch.column("vec_id"), batch.column("v")], names=["pivot", "distance", "vec_id", "v"])

    rows = vectors.mapInArrow(assign, "pivot int, distance double, vec_id long, v array<bigint>")
    # Cut by (pivot, distance, id): a pivot with most of the rows is spread over many tasks.
    index = stored(rows.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id"), "pivots")
    return index, {"dim": dim, "longest": longest, "points": points, "norms": norms}


def _search(index: DataFrame, facts: dict, ids, queries, best, k: int, own_pivot: bool) -> DataFrame:
    """Up to k rows ``(q, vec_id, score)`` of each task for each query (q is its number in the block).

    ``best`` are scores that k rows are known to reach.  ``own_pivot``: look only at the
    annulus around the query under its nearest pivot, for a first bound.
    """
    import numpy as np

    dim, longest, points, norms = (facts[x] for x in ("dim", "longest", "points", "norms"))
    lengths = (queries**2).sum(axis=1)
    to_pivots = _distance(lengths, norms, queries @ points.T, longest, False)
    nearest = to_pivots.argmin(axis=1)
    sent = index.sparkSession.sparkContext.broadcast((ids, queries, lengths, to_pivots, nearest, best))
    slack = 1e-6 * (1 + np.sqrt(longest))

    def search(batches):
        import numpy as np
        import pyarrow as pa

        ids, queries, lengths, to_pivots, nearest, best = sent.value
        bound, found = best.copy(), {}

        def take(q, scores, names):
            have = found.get(q)
            if have is not None:
                scores, names = np.concatenate([have[0], scores]), np.concatenate([have[1], names])
            if len(scores) > k:
                top = np.lexsort((names, -scores))[:k]
                scores, names = scores[top], names[top]
            found[q] = scores, names
            if len(scores) == k:
                bound[q] = max(bound[q], scores.min())

        for batch in batches:
            pivot, distance, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "distance", "vec_id"))
            x = _matrix(batch.column("v"), dim)
            order = np.lexsort((distance, pivot))
            pivot, distance, names, x = pivot[order], distance[order], names[order], x[order]
            cuts = np.flatnonzero(np.diff(pivot, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                p, d = int(pivot[a]), distance[a:b]
                asked = np.flatnonzero(nearest == p) if own_pivot else range(len(ids))
                for q in asked:
                    at, own = int(np.searchsorted(d, to_pivots[q, p])), to_pivots[q, p]
                    left, right = at, at  # rows [left, right) are done
                    while left > 0 or right < b - a:
                        radius = np.sqrt(max(lengths[q] + longest - 2 * bound[q], 0)) + slack if np.isfinite(bound[q]) else np.inf
                        inner = own - d[left - 1] if left > 0 else np.inf
                        outer = d[right] - own if right < b - a else np.inf
                        if min(inner, outer) > radius:
                            break
                        lo, hi = (max(0, left - ANNULUS), left) if inner <= outer else (right, min(b - a, right + ANNULUS))
                        left, right = min(left, lo), max(right, hi)
                        scores = x[a + lo : a + hi] @ queries[q]
                        good = np.flatnonzero((scores >= bound[q]) & (names[a + lo : a + hi] != ids[q]))
                        if len(good):
                            take(q, scores[good], names[a + lo : a + hi][good])
                        if own_pivot and right - left >= 2 * ANNULUS:
                            break
        for q, (scores, names) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), q, dtype=np.int64)), pa.array(names.astype(np.int64)), pa.array(scores.astype(np.int64))], names=["q", "vec_id", "score"])

    rows = index.mapInArrow(search, "q long, vec_id long, score long")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _integers(x, scale: int) -> list[int]:
    """floor(scale * x) as whole numbers of any size."""
    import math

    return [math.floor(y) if math.isfinite(y := scale * c) else math.floor(c) * scale for c in x]


def _sortable(score: int) -> str:
    """A text that sorts as the number: sign, number of digits, digits."""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if score >= 0 else "0" + text.translate(str.maketrans("0123456789", "9876543210"))


def _sortable_column(score: Column) -> Column:
    digits = F.regexp_replace(score.cast("string"), "-", "")
    text = F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
    return F.when(score >= 0, F.concat(F.lit("1"), text)).otherwise(F.concat(F.lit("0"), F.translate(text, "0123456789", "9876543210")))


def _long_pairs(candidates: DataFrame, ids, queries: list[list[int]], k: int, scale: int) -> DataFrame:
    """Up to k rows ``(q, vec_id, score, key)`` of each task for each query, from candidates ``(vec_id, x)``.

    Doubles give a score up to an error of (components + 8) / 2^52 of the sum of the absolute
    products.  Only candidates whose upper bound reaches the k-th best lower bound are scored by whole
    numbers.  ``key`` sorts as the score; ``score`` is null if it does not fit a long.
    """
    sent = candidates.sparkSession.sparkContext.broadcast((ids, queries))

    def search(batches):
        import numpy as np
        import pyarrow as pa

        ids, queries = sent.value
        dim = max([len(v) for v in queries], default=0)
        asked = np.zeros((len(queries), dim))
        exact = np.zeros((len(queries), dim), dtype=object)
        for j, v in enumerate(queries):
            asked[j, : len(v)] = [_double(c) for c in v]
            exact[j, : len(v)] = v
        found, bound = {}, np.full(len(queries), -np.inf)
        for batch in batches:
            for at in range(0, len(batch), SLICE[0]):
                part = batch.slice(at, SLICE[0])
                names, rows = part.column("vec_id").to_numpy(), part.column("x").to_pylist()
                x = np.zeros((len(rows), dim))
                with np.errstate(all="ignore"):
                    for i, r in enumerate(rows):
                        x[i, : len(r)] = np.floor(scale * np.array(r[:dim], dtype=np.float64))
                    for lo in range(0, len(queries), SLICE[1]):
                        block = asked[lo : lo + SLICE[1]]
                        about, error = x @ block.T, (np.abs(x) @ np.abs(block).T) * ((dim + 8) * 2.0**-52)
                        upper, lower = about + error, about - error
                        for j in range(len(block)):
                            q = lo + j
                            other = names != ids[q]
                            least, floor = lower[other, j], bound[q]
                            if len(least) > k and np.isfinite(least).all():
                                floor = max(floor, np.partition(least, len(least) - k)[len(least) - k])
                            near = np.flatnonzero(other & ~(upper[:, j] < floor))
                            if not len(near):
                                continue
                            have = found.get(q, [])
                            whole = {}  # equal vectors are scored once
                            for i in near:
                                key = tuple(rows[i][:dim])
                                if key not in whole:
                                    whole[key] = sum(a * b for a, b in zip(_integers(key, scale), exact[q]))
                                have.append((-whole[key], int(names[i])))
                            found[q] = have = sorted(have)[:k]
                            if len(have) == k:
                                bound[q] = max(bound[q], np.nextafter(_double(-have[-1][0]), -np.inf))
        out = [(q, name, -s if -(2**63) <= -s < 2**63 else None, _sortable(-s)) for q, best in found.items() for s, name in best]
        kinds = [("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return candidates.mapInArrow(search, "q long, vec_id long, score long, key string")


def _double(n: int) -> float:
    """The nearest double; infinite beyond the largest."""
    try:
        return float(n)
    except OverflowError:
        return float("inf") if n > 0 else float("-inf")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query by ``key``, ties to the smaller id."""
    best = Window.partitionBy("q").orderBy(F.desc("key"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def topk(
    rows: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, pivots: int = 64, block: int = 8192
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products, ties to the smaller id.

    A row is no candidate for a query of its own id.  Repeated candidates count each;
    repeated queries (equal id and vector) are one.  Vectors of different lengths are
    filled up with zeros.  See ``integer_vectors`` for rows that take no part.  Queries are
    sent to the index in blocks of about ``block``, a bounded size; each block is one pass, and
    two if there are long vectors.  Ranks are exact for all; a score beyond a long is null.
    """
    import numpy as np

    index, facts = build_index(stored(integer_vectors(rows, id, vector, scale), "vectors"), pivots)
    asked = stored(integer_vectors(queries, id, vector, scale).distinct(), "queries")
    long = stored(long_vectors(rows, id, vector, scale), "long")
    has_long = not long.isEmpty()
    blocks = max(1, -(-asked.count() // block))
    spark = index.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def named(hits, ids):
        names = spark.createDataFrame([(j, int(v)) for j, v in enumerate(ids)], "q long, query_id long")
        return hits.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    for i in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        if not got:
            continue
        ids = np.array([r["vec_id"] for r in got], dtype=np.int64)
        block_vectors = np.zeros((len(got), facts["dim"]))
        for j, r in enumerate(got):
            n = min(len(r["v"]), facts["dim"])
            block_vectors[j, :n] = r["v"][:n]
        best = np.full(len(got), -np.inf)
        near = _search(index, facts, ids, block_vectors, best, k, True)
        for r in near.where(F.col("rank") == k).select("q", "score").collect():
            best[r["q"]] = r["score"]
        hits = _search(index, facts, ids, block_vectors, best, k, False)
        if has_long:
            others = _long_pairs(long, ids, [list(r["v"]) for r in got], k, scale)
            hits = _first(hits.select("q", "vec_id", "score", _sortable_column(F.col("score")).alias("key")).unionByName(others), k)
        out = out.unionByName(named(hits, ids))

    asked = stored(long_vectors(queries, id, vector, scale).distinct(), "long_queries")
    blocks = -(-asked.count() // block)
    for i in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        once = sorted({(r["vec_id"], tuple(_integers(r["x"], scale))) for r in got})
        if once:
            ids = np.array([v for v, _ in once], dtype=np.int64)
            hits = _first(_long_pairs(_finite(rows, id, vector), ids, [list(v) for _, v in once], k, scale), k)
            out = out.unionByName(named(hits, ids))
    return out


SQL = """
WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
