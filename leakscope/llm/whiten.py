"""Whitening of vectors by shifted Cholesky QR.

Rows are centred by exact integer sums.  A pass over them adds up the Gram matrix of the centred rows;
its Cholesky factor, with a small shift that keeps it positive, is a first triangular factor R.  The next
pass puts the rows through the triangular solve with R, which makes their columns nearly orthonormal, and
adds up their Gram matrix again, whose factor mends the rest, and so on until the Gram matrix is the identity
but for a millionth, which one more factor squares away.  The product of the factors is the R of the QR
decomposition of the centred rows.  Its singular value decomposition gives the components and variances, with
the accuracy of working on the rows and not on their covariance.

Only matrices of the vectors' dimension leave the tasks: their entries are summed up by Spark, and the driver
holds one of them.  Rows are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship

ship(__name__)

#: Unit roundoff of doubles; a pivot of an orthonormalised column below this is rounding noise.
ROUNDOFF, NOISE = 2.0**-53, 1e-13
#: Distance from the identity after which one more factor is enough, and passes after which not reaching it is an error.
NEAR, PASSES = 1e-6, 12
#: Whole numbers below this are exact as doubles, and sums and products below the other as 64-bit integers.
EXACT, WIDE = 2**53, 2**62


@dataclass
class Whitening:
    """A fitted whitening: rows, exact sums, unit components (one a row), their variances, the total variance."""

    n: int
    sums: list[int]
    components: object
    variances: object
    total: float
    scale: int
    offset: int


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _whole(column, scale: int, offset: int):
    """Matrix of floor(scale * c) + offset; of Python integers if they are not exact as doubles."""
    import math

    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not flat.size or np.abs(flat).max() * scale + abs(offset) < EXACT:
        return (np.floor(flat * scale) + offset).astype(np.int64)
    return np.array([[math.floor(c) * scale + math.floor((c - math.floor(c)) * scale) + offset for c in row] for row in flat.tolist()], dtype=object)


def _largest(x) -> int:
    return max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0


def _spread(x, n: int, sums: list[int]):
    """n * x - sums, exact."""
    import numpy as np

    small = n * _largest(x) + max(map(abs, sums)) < WIDE
    return (x if small else x.astype(object)) * n - np.array(sums, dtype=np.int64 if small else object)


def _centred(x, n: int, sums: list[int]):
    import numpy as np

    return _spread(x, n, sums).astype(np.float64) / n


def _solved(rows, factors):
    """Rows through the triangular solves with the factors, one after the other; columns of noise become zero."""
    import numpy as np

    for r, dead in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = 0 if dead[j] else (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def factor(gram, shift: float):
    """Upper triangular R with R'R = gram + shift, and which columns are noise: they get a row of the identity."""
    import numpy as np

    d = len(gram)
    rest, r, dead = gram + shift * np.eye(d), np.eye(d), np.zeros(d, bool)
    least = NOISE * max(rest.diagonal().max(initial=0), 0)
    for j in range(d):
        dead[j] = not rest[j, j] > (0 if shift else least)
        if not dead[j]:
            r[j, j:] = rest[j, j:] / np.sqrt(rest[j, j])
            rest[j + 1 :, j + 1 :] -= np.outer(r[j, j + 1 :], r[j, j + 1 :])
    return r, dead


def gram_matrix(rows: DataFrame, matrix, d: int):
    """Sum over all Arrow batches of M'M, where ``matrix`` makes M (rows by ``d``) of the batch's vector column."""
    import numpy as np

    def add(batches):
        import numpy as np
        import pyarrow as arrow

        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                m = matrix(batch.column("v"))
                total += m.T @ m
        i, j = np.triu_indices(d)
        if total.any():
            yield arrow.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "g": total[i, j]})

    sums = rows.mapInArrow(add, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros((d, d))
    out[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["g"].to_numpy()
    return out + np.triu(out, 1).T


def _vectors(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Usable vectors of the most frequent length (of several the greatest), as ``v``, and that length; 0 if there are none."""
    usables = rows.withColumn("_v", F.col(vector)).where(usable(F.col("_v")))
    sizes = usables.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return usables.where(F.size("_v") == d), d


def fit(rows: DataFrame, vector: str = "embedding", scale: int = 1, offset: int = 0) -> Whitening | None:
    """Fitted on all usable vectors of the most frequent length, entries taken as floor(scale * c) + offset; None if there are none.

    Components of no variance (fewer independent rows than dimensions, constant entries) are left out.
    """
    import numpy as np

    bounded_batches(rows.sparkSession)
    vectors, d = _vectors(rows, vector)
    if not d:
        return None
    vectors = vectors.select(F.col("_v").alias("v"))

    def add(batches):
        import numpy as np
        import pyarrow as arrow

        n, sums = 0, [0] * d
        for batch in batches:
            x = _whole(batch.column("v"), scale, offset)
            own = x.sum(axis=0) if _largest(x) * len(x) < WIDE else x.astype(object).sum(axis=0)
            n, sums = n + len(x), [a + int(b) for a, b in zip(sums, own)]
        if n:
            yield arrow.RecordBatch.from_pydict({"i": arrow.array(range(d), arrow.int32()), "n": arrow.array([n] * d), "s": arrow.array(sums, arrow.decimal128(38, 0))})

    found = vectors.mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    gram = gram_matrix(vectors, lambda c: _centred(_whole(c, scale, offset), n, sums), d)
    trace = float(np.trace(gram))
    factors = [factor(gram, 11 * (n * d + d * (d + 1)) * ROUNDOFF * trace)]
    near = False
    while not near and not all(factors[-1][1]):
        if len(factors) == PASSES:
            raise ArithmeticError(f"rows are not orthonormal after {PASSES} passes")
        gram = gram_matrix(vectors, lambda c: _solved(_centred(_whole(c, scale, offset), n, sums), factors), d)
        factors.append(factor(gram, 0.0))
        live = ~factors[-1][1]
        near = np.abs(gram - np.eye(d))[np.ix_(live, live)].max(initial=0) < NEAR
    whole = np.eye(d)
    for r, dead in factors:
        whole = r @ whole
    whole[factors[-1][1]] = 0  # columns that are noise have no row in R
    _, sizes, components = np.linalg.svd(whole)
    kept = sizes > sizes.max() * d * 4 * ROUNDOFF
    components, variances = components[kept], sizes[kept] ** 2 / n
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)]) if len(components) else np.zeros(0)
    return Whitening(n, sums, components * signs[:, None], variances, trace / n, scale, offset)


def whiten(rows: DataFrame, model: Whitening | None, components: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, deviation, whitened)`` for each row of a usable vector of the model's length.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, a decimal (null beyond 38 digits); ``whitened`` the
    centred vector along the first ``components``, each over the square root of its variance.  Null ids and repeated rows are
    rows like others.  A model of None gives no rows.
    """
    kind = dict(rows.dtypes)[id]
    d = len(model.sums) if model else -1
    own = rows.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")) & (F.size("v") == d))

    def project(batches):
        import numpy as np
        import pyarrow as arrow

        for batch in batches:
            if not len(batch):
                continue
            axes = (model.components[:components] / np.sqrt(model.variances[:components])[:, None]).T
            spread = _spread(_whole(batch.column("v"), model.scale, model.offset), model.n, model.sums)
            if spread.dtype != object and _largest(spread) ** 2 * d < WIDE:
                deviation = arrow.array((spread**2).sum(axis=1)).cast(arrow.decimal128(38, 0))
            else:
                wide = [int(x) for x in (spread.astype(object) ** 2).sum(axis=1)]
                deviation = arrow.array([x if x < 10**38 else None for x in wide], arrow.decimal128(38, 0))
            out = spread.astype(np.float64) / model.n @ axes
            ends = np.arange(len(batch) + 1, dtype=np.int32) * axes.shape[1]
            yield arrow.RecordBatch.from_arrays([batch.column("id"), deviation, arrow.ListArray.from_arrays(ends, out.ravel())], names=["id", "deviation", "whitened"])

    return own.mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id)


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest entry, by absolute value, of the covariance of ``whitened`` (``k`` numbers a row, ``n`` rows) minus the identity."""
    import numpy as np

    if not k:
        return 0.0

    def with_ones(column):
        import numpy as np

        m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), k)
        return np.concatenate([m, np.ones((len(m), 1))], axis=1)

    sums = gram_matrix(whitened.select(F.col("whitened").alias("v")), with_ones, k + 1)
    mean = sums[:k, k] / n
    return float(np.abs(sums[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_components(rows: DataFrame, components: int = 8, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, offset: int = 100000) -> DataFrame:
    """One row for each usable row and component, with the fit's own figures beside it.

    ``deviation`` is null where it exceeds a long.
    """
    model = fit(rows, vector, scale, offset)
    found = whiten(rows, model, components, id, vector)
    k = min(components, len(model.variances)) if model else 0
    error = identity_error(found, model.n, k) if model else 0.0
    shares = F.array(*[F.lit(float(v) / model.total) for v in model.variances[:k]]) if k else F.array(F.lit(0.0))
    each = found.select(id, F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        id, (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )
