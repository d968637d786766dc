"""The stored table of findings, and joins, sessions, windows and late rows of streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leakscope.operators.findings import as_findings, latest
from leakscope.operators.store import FindingStore, upsert_stream
from leakscope.streaming import traffic_stream as TS


def found(spark, rows):
    raw = spark.createDataFrame(rows, "id string, ts long, url string, severity string")
    return as_findings(raw, finding_id=F.col("id"), ts="ts", url="url", severity=F.col("severity"), type="t", source="s", metadata=F.create_map(F.lit("k"), F.col("url")))


def contents(df):
    return sorted((r.finding_id, r.ts, r.url, r.severity, r.metadata["k"], r.occurrence_count) for r in df.collect())


@pytest.mark.parametrize("compact_after", [1, 3, 100])
def test_store_is_the_latest_of_all_batches(spark, tmp_path, compact_after):
    rnd = random.Random(7)
    store = FindingStore(spark, str(tmp_path / "store"), buckets=4, compact_after=compact_after)
    assert store.read() is None and store.vacuum() == 0
    rows = [(rnd.choice(["hot"] * 10 + [f"f{i}" for i in range(12)] + [None]), rnd.randrange(40), f"u{i}", rnd.choice(["HIGH", "LOW"])) for i in range(120)]
    for n in range(6):
        assert store.merge(found(spark, rows[20 * n : 20 * n + 20]), n)
        seen = rows[: 20 * n + 20]
        assert contents(store.read()) == contents(latest(found(spark, [r for r in seen if r[0]])))
    before, commit = contents(store.read()), store.commit()
    assert not store.merge(found(spark, rows[:20]), 5) and not store.merge(found(spark, rows[:20]), 0)  # replayed
    assert contents(store.read()) == before and store.commit() == commit
    store.compact()
    assert store.commit()["deltas"] == [] and contents(store.read()) == before
    assert store.vacuum() > 0 and contents(store.read()) == before
    assert store.merge(found(spark, rows[:20]), 0, writer="other")
    assert contents(store.read()) == contents(latest(found(spark, [r for r in rows + rows[:20] if r[0]])))


def test_base_is_not_shuffled(spark, tmp_path):
    store = FindingStore(spark, str(tmp_path / "store"), buckets=3)
    store.merge(found(spark, [(f"f{i}", i, "u", "LOW") for i in range(50)]), 0)
    store.compact()
    store.merge(found(spark, [(f"f{i}", 99, "v", "LOW") for i in range(40, 60)]), 1)
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert store.read().count() == 60


def test_files_without_a_commit_are_not_read(spark, tmp_path):
    path = tmp_path / "store"
    store = FindingStore(spark, str(path))
    store.merge(found(spark, [("a", 1, "u", "LOW")]), 0)
    (path / "commits" / "000000000009").mkdir()  # died before its mark
    found(spark, [("b", 1, "u", "LOW")]).write.parquet(str(path / "rows" / "delta-lost"))
    assert [r.finding_id for r in store.read().collect()] == ["a"]
    assert store.merge(found(spark, [("c", 1, "u", "LOW")]), 1) and store.vacuum() >= 2
    assert sorted(r.finding_id for r in store.read().collect()) == ["a", "c"]


def test_stream_is_merged_once(spark, tmp_path):
    source, rows = tmp_path / "in", [(f"f{i % 7}", i, f"u{i}", "LOW") for i in range(30)]
    raw = "id string, ts long, url string, severity string"
    store = FindingStore(spark, str(tmp_path / "store"), buckets=2, compact_after=2)

    def run():
        live = spark.readStream.schema(raw).option("maxFilesPerTrigger", 1).json(str(source))
        stream = as_findings(live, finding_id=F.col("id"), ts="ts", url="url", severity=F.col("severity"), type="t", source="s", metadata=F.create_map(F.lit("k"), F.col("url")))
        upsert_stream(stream, store, str(tmp_path / "checkpoint")).awaitTermination()

    for n in range(3):
        spark.createDataFrame(rows[10 * n : 10 * n + 10], raw).coalesce(1).write.mode("append").json(str(source))
        run()
    run()
    assert contents(store.read()) == contents(latest(found(spark, rows)))


# --- time ------------------------------------------------------------------

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def live(spark, tmp_path, name, schema):
    (tmp_path / name).mkdir()
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def put(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def test_requests_meet_their_responses(spark, tmp_path):
    left, right = "exchange_id long, event_time timestamp, url string", "exchange_id long, event_time timestamp, status int"
    requests, responses = live(spark, tmp_path, "requests", left), live(spark, tmp_path, "responses", right)

    def run():
        TS.run_to_end(TS.append_to(TS.pair_exchanges(requests, responses, unanswered=True), str(tmp_path / "out"), str(tmp_path / "checkpoint")))

    put(spark, tmp_path, "requests", [(1, at(0), "a"), (2, at(1), "b"), (3, at(2), "c"), (None, at(2), "n")], left)
    put(spark, tmp_path, "responses", [(1, at(4), 200), (3, at(1), 500)], right)  # 3: before its request
    run()
    put(spark, tmp_path, "requests", [(4, at(30), "d")], left)
    put(spark, tmp_path, "responses", [(2, at(6), 201), (4, at(36), 202), (5, at(30), 203)], right)  # 4: too late
    run()
    put(spark, tmp_path, "requests", [(9, at(90), "e")], left)
    put(spark, tmp_path, "responses", [(9, at(90), 204)], right)
    run()
    got = sorted(((r.exchange_id or 0, r.url, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == [(0, "n", None), (1, "a", 200), (2, "b", 201), (3, "c", None), (4, "d", None), (9, "e", 204)]


def test_sessions_and_sliding_windows(spark, tmp_path):
    schema = "client string, event_time timestamp"
    log = live(spark, tmp_path, "log", schema)
    rows = [("a", at(0)), ("a", at(29)), ("b", at(10)), ("a", at(58)), ("a", at(100))]
    sinks = {"sessions": TS.client_sessions(log, ["client"]), "windows": TS.sliding_counts(log, ["client"])}
    for part in (rows[:3], rows[3:], [("end", at(6000))]):
        put(spark, tmp_path, "log", part, schema)
        for name, stream in sinks.items():
            TS.run_to_end(TS.append_to(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")))
    minutes = lambda t: int((t - START).total_seconds() // 60)
    sessions = [(r.client, minutes(r.session_start), minutes(r.session_end), r.n) for r in spark.read.parquet(str(tmp_path / "sessions")).collect()]
    assert sorted(sessions) == [("a", 0, 58, 3), ("a", 100, 100, 1), ("b", 10, 10, 1)]
    whole = TS.sliding_counts(spark.createDataFrame(rows, schema), ["client"]).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "windows")).collect()))


def test_late_rows_are_kept_aside(spark, tmp_path):
    schema = "id int, event_time timestamp"
    log = live(spark, tmp_path, "log", schema)
    for part in ([(1, at(0)), (2, at(60))], [(3, at(49)), (4, at(50)), (5, None)], [(6, at(10)), (7, at(200))], [(8, at(100))]):
        put(spark, tmp_path, "log", part, schema)
        TS.run_to_end(TS.keep_late(log, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    ids = lambda name: sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / name)).collect())
    assert ids("rows") == [1, 2, 4, 5, 7] and ids("late") == [3, 6, 8]


def test_open_windows_are_read_from_the_updates(spark, tmp_path):
    schema = "client string, event_time timestamp"
    log, out = live(spark, tmp_path, "log", schema), str(tmp_path / "out")
    counts = log.withWatermark("event_time", "10 minutes").groupBy(F.window("event_time", "1 hour"), "client").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "client", "n")
    for part in ([("a", at(0)), ("b", at(5))], [("a", at(30)), ("a", at(90))], [("a", at(59))]):  # the last is late
        put(spark, tmp_path, "log", part, schema)
        TS.run_to_end(TS.update_at(counts, out, str(tmp_path / "checkpoint")))
    got = sorted((r.start, r.client, r.n) for r in TS.updated(spark, out, ["start", "client"]).collect())
    assert got == [(at(0), "a", 2), (at(0), "b", 1), (at(60), "a", 1)]
