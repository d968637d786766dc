import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.operators import ann
from leakscope.operators.top import top_per_key


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vector array<double>")


def test_search_is_exact_in_the_visited_buckets(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(400, 12))
    m[300:] = m[0]  # a third of the rows in one bucket
    path, rows = str(tmp_path / "index"), frame(spark, m)
    ann.create_index(spark, path, 12, bits=5)
    ann.add_vectors(path, rows.where("id < 150"))
    ann.add_vectors(path, rows.where("id >= 150"))
    planes = ann.projections(5, 12)
    code = ((np.floor(m * 1024) @ planes.T >= 0) << np.arange(5)).sum(axis=1)
    counts = {r.bucket: r.n for r in ann.bucket_counts(spark, path).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    assert counts == {b: int((code == b).sum()) for b in set(code.tolist())}
    queries = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 30)
    seen = {}
    for r in ann.probes(spark, path, queries, 60).collect():
        seen.setdefault(r.query_id, []).append(r.bucket)
    got = {}
    for r in ann.search(spark, path, queries, 5, least=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 400, 40):
        margins = np.floor(m[i] * 1024) @ planes.T
        cost = {b: sum(abs(x) for k, x in enumerate(margins) if (x >= 0) != bool(b >> k & 1)) for b in counts}
        want, held = [], 0
        for b in sorted(counts, key=lambda b: (cost[b], b)):
            if held >= 60:
                break
            want.append(b)
            held += counts[b]
        assert sorted(seen[i]) == sorted(want)
        near = [j for j in range(400) if code[j] in want]
        best = sorted(((round(float(unit[j] @ unit[i]), 6), j) for j in near), key=lambda t: (-t[0], t[1]))[:5]
        assert sorted(got[i]) == [(r, j, s) for r, (s, j) in enumerate(best, 1)]


def test_queries_of_a_bucket_are_cut_into_blocks(spark, tmp_path, monkeypatch):
    m = np.random.default_rng(4).normal(size=(200, 8))
    path, rows = str(tmp_path / "index"), frame(spark, m)
    ann.create_index(spark, path, 8, bits=2)
    ann.add_vectors(path, rows)
    queries = rows.select(F.col("id").alias("query_id"), "vector")
    want = sorted(map(tuple, ann.search(spark, path, queries, 4, least=90).collect()))
    met = []
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 20)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 15)
    monkeypatch.setattr(ann, "top_per_key", lambda df, *a: met.append(df) or top_per_key(df, *a))
    assert sorted(map(tuple, ann.search(spark, path, queries, 4, least=90).collect())) == want
    # A block holds 15 queries on average, not the 90 and more that visit a bucket.
    assert "_qpart" in met[0]._jdf.queryExecution().analyzed().toString()


def test_only_visited_buckets_are_read(spark, tmp_path):
    path, rows = str(tmp_path / "index"), frame(spark, np.random.default_rng(2).normal(size=(300, 6)))
    ann.create_index(spark, path, 6, bits=4)
    ann.add_vectors(path, rows)
    plan = ann.search(spark, path, rows.limit(1).select(F.col("id").alias("query_id"), "vector"), 3, least=20)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(bucket" in plan or "PushedFilters: [IsNotNull(bucket), EqualTo(bucket" in plan or "In(bucket, [" in plan


def test_odd_vectors_and_empty_index(spark, tmp_path):
    path, rows = str(tmp_path / "index"), frame(spark, [[1.0, 0.0], [0.0, 0.0]])
    ann.create_index(spark, path, 2, bits=1)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    ann.add_vectors(path, rows.limit(0))
    assert ann.search(spark, path, asked, 2, least=1).count() == 0
    ann.add_vectors(path, rows.unionByName(spark.createDataFrame([(7, None)], rows.schema)))
    assert [(r.query_id, r.id) for r in ann.search(spark, path, asked.where("query_id = 0"), 2, least=9).collect()] == [(0, 0)]  # a zero vector is like none
    with pytest.raises(Exception, match="dimension"):
        ann.add_vectors(path, frame(spark, [[1.0]]))
    with pytest.raises(ValueError):
        ann.create_index(spark, str(tmp_path / "other"), 2, bits=17)
