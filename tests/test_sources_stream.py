import json

import pytest
from conftest import AWS, GHP, collect
from pyspark.sql import functions as F

from leakscope.catalog import default_catalog
from leakscope.operators import extras as X
from leakscope.operators import traffic as T
from leakscope.session import shared_dir, small
from leakscope.sources import readers
from leakscope.streaming import traffic_stream as TS

P = default_catalog()


def write_log(folder, n=40):
    folder.mkdir()
    for part in range(2):
        lines = []
        for i in range(part * n, part * n + n):
            stage = ("mitm_outbound", "mitm_bypass", "security_finding")[i % 3]
            lines.append(json.dumps({"ts": 1000 + i * 30, "stage": stage, "client": "c", "method": "GET", "url": f"http://a/{i % 4}",
                                     "severity": "HIGH" if i % 2 else "LOW", "type": "basic_auth_header", "description": f"d{i % 5}"}))
        lines[5:5] = ["", '{"ts": 1, "sta', "[1, 2"]
        (folder / f"part-{part}.json").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_traffic_log_skips_bad_lines(spark, tmp_path):
    log = readers.read_traffic_log(spark, write_log(tmp_path / "log"))
    assert collect(T.stage_counts(log)) == [(27, 27, 26)]
    assert readers.read_traffic_log(spark, str(tmp_path / "none")).count() == 0


def test_text_files(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text(AWS)
    (root / "sub/b.txt").write_text("plain")
    (root / "late.txt").write_bytes(b"x" * 5000 + b"\0")
    (root / "nul.txt").write_bytes(b"ab\0cd")
    (root / "IMG.PNG").write_text("text in a picture name")
    found = readers.read_text_files(spark, str(root))
    names = sorted(r.path.rsplit("/", 1)[1] for r in found.collect())
    assert names == ["a.py", "b.txt", "late.txt"]


def test_browser_exchange_and_diff_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"localStorage": {"token": "x"}, "cookies": [{"name": "a"}]}\n{"error": "timeout"}\n')
    assert readers.read_browser_state(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "e.json").write_text(json.dumps({"ts": 1, "url": "https://a/", "resp_headers": {"Content-Type": "text/html"}, "resp_body": AWS}) + "\n")
    assert T.scan_traffic(readers.read_exchanges(spark, str(tmp_path / "e.json")), P).count() == 1
    (tmp_path / "abc123.diff").write_text("diff --git a/x b/x\n--- a/x\n+++ b/x\n+1")
    row = readers.read_diffs(spark, str(tmp_path / "abc123.diff")).first()
    assert row.commit == "abc123" and row.diff.endswith("+1") and row.commit_ts > 0


def test_stage_counts_stream_equals_batch(spark, tmp_path):
    path = write_log(tmp_path / "log")
    out = str(tmp_path / "out")
    stream = TS.stage_counts(readers.stream_traffic_log(spark, path, max_files=1))
    TS.run_to_end(TS.replace_at(stream, out, str(tmp_path / "cp")))
    batch = TS.stage_counts(readers.read_traffic_log(spark, path))
    assert collect(TS.current(spark, out).select("stage", "n")) == collect(batch)


def test_windows_are_final_up_to_the_watermark(spark, tmp_path):
    path = write_log(tmp_path / "log")
    out = str(tmp_path / "out")
    stream = TS.severity_windows(readers.stream_traffic_log(spark, path), delay="5 minutes")
    TS.run_to_end(TS.append_to(stream, out, str(tmp_path / "cp")))
    rows = TS.with_event_time(T.split_log(readers.read_traffic_log(spark, path)))
    batch = X.severity_windows(rows)
    limit = rows.agg(F.max("ts")).first()[0] - 300
    closed = batch.where(F.unix_seconds("window_start") + 60 <= limit)
    assert 0 < closed.count() < batch.count()
    assert collect(spark.read.parquet(out)) == collect(closed)


def test_dedupe_keeps_one_row_per_id(spark, tmp_path):
    path = write_log(tmp_path / "log")
    out = str(tmp_path / "out")
    found = T.split_log(readers.stream_traffic_log(spark, path, max_files=1))
    TS.run_to_end(TS.append_to(TS.distinct_findings(found, delay="2 days"), out, str(tmp_path / "cp")))
    got = spark.read.parquet(out)
    assert got.count() == got.select("finding_id").distinct().count()
    batch = T.split_log(readers.read_traffic_log(spark, path)).select("finding_id").distinct()
    assert collect(got.select("finding_id")) == collect(batch)


def test_detectors_on_a_stream_equal_batch(spark, tmp_path):
    folder = tmp_path / "exchanges"
    folder.mkdir()
    rows = [
        {"ts": 1, "client": "c", "method": "GET", "url": "http://u:p@a/", "req_headers": {"Authorization": "Bearer " + GHP}, "resp_headers": {}},
        {"ts": 2, "client": "c", "method": "POST", "url": "https://a/", "req_body": '{"password":"hunter22"}', "resp_headers": {"Content-Type": "text/html"}, "resp_body": AWS},
    ]
    for i, r in enumerate(rows):
        (folder / f"{i}.json").write_text(json.dumps(r) + "\n")
    out = str(tmp_path / "out")
    live = spark.readStream.schema(readers.EXCHANGE).option("maxFilesPerTrigger", 1).json(str(folder))
    TS.run_to_end(TS.append_to(T.scan_traffic(live, P).drop("metadata"), out, str(tmp_path / "cp")))
    batch = T.scan_traffic(readers.read_exchanges(spark, str(folder)), P).drop("metadata")
    key = ["ts", "type", "severity", "pattern"]
    assert collect(spark.read.parquet(out).select(key)) == collect(batch.select(key))
    assert batch.count() == 4


def test_tail_over_batches(spark, tmp_path):
    path = write_log(tmp_path / "log")
    out = str(tmp_path / "out")
    TS.run_to_end(TS.tail(readers.stream_traffic_log(spark, path, max_files=1), out, str(tmp_path / "cp"), 10))
    want = [r.ts for r in T.newest(readers.read_traffic_log(spark, path), 10).collect()]
    assert sorted(r.ts for r in TS.current(spark, out).collect()) == sorted(want)


def test_shared_dir_is_below_the_named_folder(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


@pytest.mark.parametrize("limit, hinted", [(10, True), (2, False)])
def test_broadcast_needs_a_proven_size(spark, limit, hinted):
    plan = small(spark.range(5), limit)._jdf.queryExecution().toString()
    assert ("strategy=broadcast" in plan) == hinted
