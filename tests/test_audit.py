import pytest
from conftest import AWS, GHP, collect

from leakscope.catalog import default_catalog
from leakscope.plans import audit as A
from leakscope.sources import readers


def test_audit_writes_everything_once(spark, tmp_path):
    diffs = spark.createDataFrame([("c" * 40, 5, f"diff --git a/x b/x\n--- a/x\n+++ b/x\n+{AWS}")], "commit string, commit_ts bigint, diff string")
    exchanges = spark.createDataFrame([(9, "c", "GET", "http://u:p@a/", {"Authorization": GHP}, None, 200, {}, None)], readers.EXCHANGE)
    pages = spark.createDataFrame(
        [("http://a/", 404, {"X": AWS}, [], GHP)], "url string, status int, headers map<string,string>, set_cookies array<string>, body string"
    )
    path = str(tmp_path / "audit")
    gate = A.audit(spark, path, target="t", diffs=diffs, exchanges=exchanges, pages=pages)
    assert gate.first()[0] == 2
    assert spark.read.json(f"{path}/report/findings").count() == 7
    store = readers.read_store(spark, f"{path}/store")
    types = {r.type for r in store["findings"].collect()}
    assert types == {"git_pattern", "url_embedded_credentials", "api_key_in_header", "status", "response_pattern", "header_pattern"}
    nodes, edges = readers.read_graph(spark, f"{path}/graph")
    assert nodes.where("label = 'Finding'").count() == store["findings"].count()
    assert {r.cwe_id for r in store["finding_cwe_map"].collect()} == {"CWE-798", "CWE-523", "CWE-200", "CWE-548"}
    written = "".join(f.read_text(errors="ignore") for f in tmp_path.rglob("*.json"))
    assert AWS not in written and GHP not in written


def test_audit_needs_a_source():
    with pytest.raises(ValueError):
        A.collect_findings(default_catalog())


def test_ask_without_matches(spark):
    from leakscope.operators.findings import normalize

    found = normalize(spark.createDataFrame([("t", "key leak", 1)], "type string, summary string, ts int"))
    assert A.ask(found, "key").first().n_contexts == 1
    row = A.ask(found, "nothing fits").first()
    assert row.n_contexts == 0 and "(no contexts)" in row.prompt
