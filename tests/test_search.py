"""Questions by the table, and the stored index, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from leakscope.operators import extras as X
from leakscope.operators import search as SE
from leakscope.operators.findings import as_findings, latest
from leakscope.operators.retrieve import keyword_topk, tokens

WORDS = ["api key", "Password", "token", "cookie_x", "header", "é key", "seen for user 1", "basic"]


def found(spark, rows):
    raw = spark.createDataFrame(rows, "id string, summary string, severity string, ts long")
    return as_findings(raw, finding_id=F.col("id"), summary=F.col("summary"), severity=F.col("severity"), ts="ts", type="t", source="s")


def some(spark, n=150):
    rnd = random.Random(3)
    return found(spark, [(f"f{i}", " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 5))), rnd.choice(["HIGH", "LOW", "CRITICAL"]), rnd.randrange(9)) for i in range(n)]).repartition(3)


@pytest.mark.parametrize("per_pass,batch", [(1000, 10000), (3, 7)])
def test_each_question_is_answered_as_if_alone(spark, per_pass, batch):
    rows = latest(some(spark)).drop("occurrence_count")
    asked = [(i, q) for i, q in enumerate(["api key", "the password of user", "key key cookie", "zebra", "no", "É_KEY token", "basic header api"])]
    table = spark.createDataFrame([*asked, (99, None)], "query_id int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = [(r.query_id, r.rank, r.id, r.severity, r.score) for r in SE.keyword_topk_table(rows, table, 4, per_pass=per_pass).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(i, n, r.id, r.severity, r.score) for i, q in asked if tokens(q) for n, r in enumerate(keyword_topk(rows, q, 4).collect(), 1)]
    assert sorted(got) == sorted(want)


def test_odd_questions(spark):
    rows = some(spark, 5)
    table = spark.createDataFrame([(1, "api"), (2, " ")], "query_id int, text string")
    with pytest.raises(ValueError):
        SE.keyword_topk_table(rows, table, 1)
    assert SE.keyword_topk_table(rows, table.limit(0), 1).count() == 0
    assert SE.keyword_topk_table(rows.limit(0), table.limit(1), 1).count() == 0


def test_scans_added_one_by_one_give_the_index_built_at_once(spark, tmp_path):
    rows, path = some(spark), str(tmp_path / "index")
    assert SE.search_stored(spark, path, "api key", 5).count() == 0
    parts = [rows.where(F.pmod(F.xxhash64("finding_id"), F.lit(3)) == i) for i in range(3)]
    for i, part in enumerate(parts):
        assert SE.add_scan(spark, path, part.unionByName(parts[0]), f"scan{i}")  # the first part again: known ids
    assert not SE.add_scan(spark, path, rows, "scan1")
    for q in ("api key user", "password", "zebra", "cookie_x header cookie_x"):
        want = X.search_index(X.text_index(rows), q, 150, 20).collect()
        assert SE.search_stored(spark, path, q, 20).collect() == want
    postings = spark.read.parquet(f"{path}/postings")
    postings.limit(1).drop("scan").withColumn("scan", F.lit("unfinished")).write.mode("append").partitionBy("scan", "bucket").parquet(f"{path}/postings")
    assert SE.search_stored(spark, path, "api key user", 20).collect() == X.search_index(X.text_index(rows), "api key user", 150, 20).collect()


def test_only_the_buckets_of_the_words_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    SE.add_scan(spark, path, some(spark, 20), "s")
    plan = SE.search_stored(spark, path, "password", 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scan_history_is_brute_force(spark):
    rnd = random.Random(6)
    scans = [3, 7, 8, 20, 21, 30]
    rows = [(f"f{i}", s) for i in range(30) for s in scans if rnd.random() < 0.5 for _ in range(rnd.randrange(1, 3))] + [(None, 3), ("f1", None)]
    want = []
    for i in sorted({f for f, s in rows if f and s}):
        at = sorted({scans.index(s) for f, s in rows if f == i and s})
        runs = [[at[0], at[0]]]
        for s in at[1:]:
            if s == runs[-1][1] + 1:
                runs[-1][1] = s
            else:
                runs.append([s, s])
        want += [(i, scans[a], scans[b], scans[b + 1] if b + 1 < len(scans) else None, "returned" if n else "new") for n, (a, b) in enumerate(runs)]
    df = spark.createDataFrame(rows, "finding_id string, scan_id int")
    assert sorted(map(tuple, X.scan_history(df).collect())) == want
    assert X.scan_history(df.limit(0)).count() == 0


def test_domains_of_a_table_match_like_the_fixed_rule(spark):
    from leakscope import values as V
    from leakscope.operators import traffic as T

    hosts = ["stripe.com", "eu.api.stripe.com", "notstripe.com", "com", "a.okta.com.", "OKTA.com", "x.y", "", "1.2.3.4"]
    urls = [f"https://u:p@{h}:8443/a" for h in hosts if h] + ["/relative", None, "https://okta.com"] * 2
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "id int, url string, domain string")
    listed = spark.createDataFrame([(x,) for x in (*V.BYPASS_DOMAINS, "API.stripe.com", "", None)], "domain string")
    got = {r.id: r.domain for r in T.match_domains(rows, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = (u or "").partition("://")[2].partition("@")[2].partition(":")[0].lower() or ("okta.com" if u and "okta.com" in u else "")
        want = [d for d in V.BYPASS_DOMAINS if host == d or host.endswith("." + d)]
        assert got[i] == (max(want, key=len) if want else None), u
    assert {r.domain for r in T.match_domains(rows, listed.limit(0)).collect()} == {None}


def test_a_word_of_all_texts_brings_up_no_question_that_is_answered():
    import numpy as np

    rnd = random.Random(5)
    # Word 0 is in every question and row, and a thousand rows meet a thousand questions: a million pairs before.
    asked = [sorted({0, *rnd.sample(range(1, 60), 3)}) for _ in range(1000)]
    start = np.cumsum([0, *map(len, asked)])
    held = SE._Held(60, 3, start, np.concatenate(asked), np.concatenate([[2, 1, 1, 1][: len(a)] for a in asked]))
    rows, met, enter = [{0, *rnd.sample(range(1, 60), rnd.randrange(3))} for _ in range(1000)], [], held._enter
    held._enter = lambda row, who: met.append(len(who)) or enter(row, who)
    for i, r in enumerate(rows):
        held.add(i, r)
    assert sum(met) < 150_000
    for q, a in enumerate(asked):
        scores = [sum({0: 2}.get(w, 1) for w in r & set(a)) for r in rows]
        want = sorted(range(1000), key=lambda i: (-scores[i], i))[:3]
        assert held.row[q].tolist() == want and held.score[q].tolist() == [scores[i] for i in want]
    assert not len(held.live[0][0])


def test_questions_that_share_a_word_and_ids_that_ask_the_same(spark):
    rows = latest(some(spark, 120)).drop("occurrence_count")
    asked = [(i, f"seen for user {'api key password'.split()[i % 3]} zebra{i}") for i in range(60)] + [(60 + i, "cookie_x api") for i in range(20)]
    table = spark.createDataFrame(asked, "query_id int, text string").repartition(4)
    for per_pass in (1000, 9):
        got = [(r.query_id, r.rank, r.id, r.score) for r in SE.keyword_topk_table(rows, table, 3, per_pass=per_pass).collect()]
        alone = {q: [(n, r.id, r.score) for n, r in enumerate(keyword_topk(rows, q, 3).collect(), 1)] for q in {q.split(" zebra")[0] for _, q in asked}}
        assert sorted(got) == sorted((i, *r) for i, q in asked for r in alone[q.split(" zebra")[0]])
