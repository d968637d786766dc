import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakscope.operators import vectors as VE


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vector array<float>").repartition(3)
    return df, m.astype(np.float64)


def brute(m, q, k):
    sims = (m @ q) / np.where(np.linalg.norm(m, axis=1) == 0, np.inf, np.linalg.norm(m, axis=1)) / (np.linalg.norm(q) + 1e-12)
    live = [i for i in range(len(m)) if m[i].any()]
    return sorted(((i, round(float(sims[i]), 6)) for i in live), key=lambda t: (-t[1], t[0]))[:k]


def test_cosine_topk(data):
    df, m = data
    got = [(r.id, r.similarity) for r in VE.cosine_topk(df, list(m[3]), 10).collect()]
    assert got == brute(m, m[3], 10)
    assert got[0] == (3, 1.0)


def test_knn_join_small_blocks_and_brute_force_agree(spark, data):
    df, m = data
    queries = df.where(F.col("id").between(10, 40)).select(F.col("id").alias("query_id"), "vector")
    small = sorted(map(tuple, VE.knn_join(df, queries, 5).collect()))
    blocks = sorted(map(tuple, VE.knn_join(df, queries, 5, max_broadcast=8).collect()))
    want = sorted((q, i, s, r) for q in range(10, 41) for r, (i, s) in enumerate(brute(m, m[q], 5), 1))
    assert small == blocks == want


def test_blocks_are_bounded(spark, data, monkeypatch):
    df, m = data
    monkeypatch.setattr(VE, "ROWS_PER_BLOCK", 50)
    queries = df.limit(30).select(F.col("id").alias("query_id"), "vector")
    a = sorted(map(tuple, VE.knn_join(df, queries, 3, max_broadcast=7).collect()))
    assert a == sorted(map(tuple, VE.knn_join(df, queries, 3).collect()))


def test_scores_of_a_block_are_bounded():
    import tracemalloc

    rng = np.random.default_rng(3)
    m, q = rng.normal(size=(20_000, 4)), rng.normal(size=(1000, 4))
    tracemalloc.start()
    got = VE._best(pa.array(range(20_000)), m, pa.array(range(1000)), q, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # 480 MB when all 20 million scores were held three times
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in (0, 104, 105, 999):
        s = np.round(unit @ (q[i] / np.linalg.norm(q[i])), 6)
        assert got.column("id").to_pylist()[2 * i : 2 * i + 2] == np.lexsort((np.arange(20_000), -s))[:2].tolist()


def test_string_ids(spark, data):
    df, m = data
    named = df.select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), "vector")
    queries = named.where("id in ('v1', 'v2')").select(F.col("id").alias("query_id"), "vector")
    rows = VE.knn_join(named, queries, 1).collect()
    assert sorted((r.query_id, r.id) for r in rows) == [("v1", "v1"), ("v2", "v2")]


def test_dimension(spark, data):
    df, _ = data
    cut = df.withColumn("vector", F.when(F.col("id") == 5, F.slice("vector", 1, 15)).otherwise(F.col("vector")))
    assert [tuple(r) for r in VE.dimension_errors(cut, 16).collect()] == [(5, 16, 15)]
    assert VE.require_dimension(df, 16).agg(F.sum(F.size("vector"))).first()[0] == 300 * 16
    with pytest.raises(Exception, match="expected 16, got 15"):
        VE.require_dimension(cut, 16).select("vector").collect()


def test_ann_recall(data):
    df, m = data
    hits = total = 0
    for q in (1, 20, 33, 50):
        near = {r.id for r in VE.cosine_ann(df, list(m[q]), 10).collect()}
        hits += len(near & {i for i, _ in brute(m, m[q], 10)})
        total += 10
    assert hits / total >= 0.7


def test_text_vectors_and_round_trip(spark, tmp_path):
    from leakscope.sources.writers import write_vectors

    df = spark.createDataFrame([(0, "api key leak"), (1, "password in config"), (2, "api token")], "id int, text string")
    model = VE.fit_text_vectors(df)
    vecs = VE.text_vectors(df, model, keep=["id"])
    assert {len(r.vector) for r in vecs.collect()} == {384}
    write_vectors(vecs, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(map(str, back.collect())) == sorted(map(str, vecs.collect()))
    query = VE.text_vectors(spark.createDataFrame([("password",)], "text string"), model, keep=[]).first().vector
    assert VE.cosine_topk(back, query, 1).first().id == 1


def test_text_vectors_are_brute_force(spark):
    import hashlib
    import math
    import re
    from collections import Counter

    texts = ["api key leak, API key!", "password in config", "api token", "", None, " ;; ", "é_1 Ünder key"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "id int, text string, words double").repartition(3)
    model = VE.fit_text_vectors(df, dim=16)
    bucket = lambda w: int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % 16
    counts = [Counter(bucket(w) for w in re.findall(r"\w+", (t or "").lower())) for t in texts]
    weights = [math.log(8 / (1 + sum(b in c for c in counts))) for b in range(16)]
    assert np.allclose(model.weights, weights)
    for r in VE.text_vectors(df, model, keep=["id"]).collect():
        want = np.array([counts[r.id][b] * weights[b] for b in range(16)])
        assert np.allclose(r.vector, want / (np.linalg.norm(want) or 1))
    assert VE.text_vectors(df.limit(0), VE.fit_text_vectors(df.limit(0), dim=4), keep=["id"]).count() == 0


def test_global_rank_is_the_row_number(spark):
    import random

    from leakscope.operators.top import global_rank

    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 1.0, 2.0, rnd.random()])) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, s double")
    ranked = global_rank(df, [F.col("s").desc(), F.col("id")])
    got = [(r["rank"], r.id) for r in ranked.collect()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted(got) == [(n, i) for n, (i, _) in enumerate(want, 1)]
    assert "SinglePartition" not in ranked._jdf.queryExecution().toString()
    assert global_rank(df.limit(0), [F.col("s")]).count() == 0
