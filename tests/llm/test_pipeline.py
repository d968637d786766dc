"""The stages on documents with known fate, and the registered queries against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, rows
from leakscope.llm import simhash
from leakscope.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").first()
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    made = [(-1, "123 456", "en", "s", 7), (-2, "#$%^ QQXZ!! " * 60, "en", "s", 7), (-3, clean.text + " ", clean.lang, "s", 7), (-3, clean.text + " ", clean.lang, "s", 7), (None, clean.text + "  ", clean.lang, None, None)]
    made += [(-4, leak, "es", "s", 7)]
    step = docs.unionByName(spark.createDataFrame(made, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, step = step.columns, stage(spark, step, SF)
        assert step.columns[: len(columns)] == columns
        kept[name] = [r.doc_id for r in step.select("doc_id").collect()]
    assert -1 not in kept["language"] and {-2, -3, -4, clean.doc_id} <= set(kept["language"])
    assert -2 not in kept["quality"] and {-3, clean.doc_id} <= set(kept["quality"])
    assert kept["near_duplicates"].count(-3) == 1 and clean.doc_id not in kept["near_duplicates"] and None not in kept["near_duplicates"]
    assert -4 not in kept["decontamination"] and kept["tokens"].count(-3) == 1
    assert step.where("not round_trip").count() == 0


def test_stages_without_rows(spark):
    step = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert step.count() == 0


def test_groups_without_a_key_of_their_own_stay(spark):
    word = lambda i: " ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    made = [(None, word(i), "en", "s", 7) for i in range(5)] + [(None, word(0), "en", "s", 7)]  # five groups without ids, one text twice
    made += [(1, word(10), "en", "s", 7), (1, word(11), "en", "s", 7), (2, word(11), "en", "s", 7), (3, word(12), "en", "s", 7), (None, word(12), "en", "s", 7)]
    made += [(4, word(13), "en", "s", 7)] * 2
    rows = docs.unionByName(spark.createDataFrame(made, docs.schema))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect()]
    want = [(None, word(i)) for i in range(5)] + [(1, word(10)), (1, word(11)), (3, word(12)), (4, word(13))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates_send_no_index_entries(spark, monkeypatch):
    """There are 34 entries a fingerprint, which Spark takes for one small table."""
    plans, stored = {}, simhash.stored

    def noted(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, purpose)

    monkeypatch.setattr(simhash, "stored", noted)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() < docs.count()
    assert "Generate explode" in plans["entries"] and "BroadcastExchange" not in plans["entries"]


def test_found_language_is_handed_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("lang = 'fr'").orderBy("doc_id").first()
    made = [(-1, some.text, None, "s", 7), (-2, some.text, "en", "s", 7), (-3, some.text, "fr", "s", 7)]
    got = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(made, docs.schema)), SF)
    assert got.columns == docs.columns and {r.doc_id: r.lang for r in got.where("doc_id < 0").collect()} == {-1: "fr", -2: "fr", -3: "fr"}
