import json
import warnings

import pytest
from conftest import collect
from pyspark.sql import functions as F

from leakscope.knowledge import KnowledgeBase, read_knowledge_base
from leakscope.operators import extras as X
from leakscope.operators import findings as FN
from leakscope.operators import graph as G
from leakscope.operators import retrieve as R
from leakscope.sources import readers, writers

KB = KnowledgeBase()


def report(tmp_path, findings, name="report.json"):
    path = tmp_path / name
    path.write_text(json.dumps({"timestamp": "t", "target": "x", "findings": findings}, indent=1))
    return str(path)


THREE = [
    {"type": "api_key_in_header", "severity": "CRITICAL", "source": "mitm", "summary": "AWS key in header", "snippet": "[REDACTED]",
     "url": "https://api.example.com/v1", "method": "POST", "pattern": "AWS_ACCESS_KEY_ID", "timestamp": 30},
    {"type": "plaintext_password", "severity": "HIGH", "source": "git", "summary": "Password in config", "timestamp": 20},
    {"type": "browser_storage", "severity": "MEDIUM", "source": "browser", "summary": "Token in localStorage", "timestamp": 10},
]


@pytest.fixture
def three(spark, tmp_path):
    return FN.normalize(readers.read_report(spark, report(tmp_path, THREE)))


# --- reports ----------------------------------------------------------------


def test_report_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_report(spark, str(tmp_path / "none.json"))
    for name, text in (("empty.json", ""), ("bad.json", '{"findings": ['), ("other.json", '{"results": []}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(readers.ReportError):
            readers.read_report(spark, str(tmp_path / name))
    with pytest.warns(UserWarning, match="no findings"):
        assert readers.read_report(spark, report(tmp_path, [])).count() == 0


def test_report_round_trip(spark, three, tmp_path):
    writers.write_report_object(three.drop("metadata"), str(tmp_path / "out"), target="t")
    back = FN.normalize(readers.read_report(spark, str(tmp_path / "out")))
    assert collect(back.select("type", "severity", "summary")) == collect(three.select("type", "severity", "summary"))
    with pytest.raises(ValueError, match="write_report"):
        writers.write_report_object(three, str(tmp_path / "big"), target="t", max_rows=2)
    writers.write_report(three, str(tmp_path / "folder"), target="t")
    back = FN.normalize(readers.read_report(spark, str(tmp_path / "folder")))
    assert collect(back.select("finding_id", "type", "url", "ts")) == collect(three.select("finding_id", "type", "url", "ts"))
    summary = readers.read_report_summary(spark, str(tmp_path / "folder")).first()
    assert summary.target == "t" and summary.stats == {"browser": 1, "git": 1, "mitm": 1}
    assert summary.severities == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 1, "LOW": 0, "INFO": 0}
    (tmp_path / "folder/findings/broken.json").write_text('{"type": \n')
    with pytest.raises(Exception, match="not valid JSON"):
        readers.read_report(spark, str(tmp_path / "folder")).collect()


def test_evidence_reaches_graph_and_store(spark):
    raw = spark.createDataFrame(
        [("a", "c0ffee", "src/x.py", "x"), ("b", None, None, None)], "type string, commit string, path string, extra string"
    )
    found = FN.normalize(raw)
    stored = {r.type: json.loads(r.metadata) for r in G.store_tables(found, KnowledgeBase())["findings"].collect()}
    assert stored == {"a": {"commit": "c0ffee", "path": "src/x.py", "extra": "x"}, "b": {}}
    nodes = {r.attrs["type"]: r.attrs for r in G.nodes(found, KnowledgeBase()).where("label = 'Finding'").collect()}
    assert nodes["a"]["commit"] == "c0ffee" and json.loads(nodes["a"]["metadata"]) == stored["a"] and "path" not in nodes["b"]
    # A metadata entry of the same name as a column gives way to it, and stays where the column is null.
    own = FN.as_findings(raw.withColumn("m", F.expr("map('path', 'old')")), type=F.col("type"), path="path", metadata="m")
    stored = {r.type: json.loads(r.metadata) for r in G.store_tables(own, KnowledgeBase())["findings"].collect()}
    assert stored == {"a": {"path": "src/x.py"}, "b": {"path": "old"}}


def test_store_merge(spark, tmp_path):
    kb = KnowledgeBase()
    rows = [("1", "a", "LOW", 5, "https://h/x", "GET"), ("2", "api_key_in_header", "HIGH", 6, "https://h/y", "GET")]
    again = [("1", "a", "HIGH", 1, "https://h/x", "GET"), ("3", "plaintext_password", "INFO", 9, "https://h/x", "GET")]
    first, second = (
        FN.normalize(spark.createDataFrame(r, "id string, type string, severity string, ts long, url string, method string")) for r in (rows, again)
    )
    writers.write_store(G.store_tables(first, kb), str(tmp_path / "one"))
    writers.merge_store(G.store_tables(second, kb), str(tmp_path / "one"), str(tmp_path / "two"))
    store = readers.read_store(spark, str(tmp_path / "two"))
    assert collect(store["findings"].select("finding_id", "severity")) == [("1", "HIGH"), ("2", "HIGH"), ("3", "INFO")]
    assert collect(store["endpoints"].select("url", "first_seen", "last_seen")) == [("https://h/x", 1, 9), ("https://h/y", 6, 6)]
    ids = [r.cwe_id for r in store["cwe_entries"].collect()]
    assert len(ids) == len(set(ids)) and {r.finding_id for r in store["finding_cwe_map"].collect()} == {"2", "3"}


# --- findings ---------------------------------------------------------------


def test_normalize_fallbacks(spark, tmp_path):
    rows = [
        {"type": "a", "client": "requests", "description": "d", "ts": 5, "pattern": "P", "timestamp_human": "then"},
        {"type": "b", "summary": "", "description": "", "severity": "LOW"},
        {"id": "given", "type": "c", "source": "s", "timestamp": 1, "ts": 2},
    ]
    found = {r.type: r for r in FN.normalize(readers.read_report(spark, report(tmp_path, rows))).collect()}
    assert (found["a"].source, found["a"].summary, found["a"].severity, found["a"].ts) == ("requests", "d", "INFO", 5)
    assert (found["b"].source, found["b"].summary) == ("mitm", "b")
    assert (found["c"].finding_id, found["c"].ts) == ("given", 1)
    assert found["a"].metadata == {"timestamp_human": "then"} and found["b"].metadata == {}
    assert (found["a"].client, found["a"].pattern) == ("requests", "P")


def test_latest_keeps_the_last_write_and_counts(spark):
    df = spark.createDataFrame([("x", 1, "LOW"), ("x", 3, "HIGH"), ("x", 2, "INFO"), ("y", 1, "LOW")], "finding_id string, ts int, severity string")
    assert collect(FN.latest(df, ["ts"])) == [("x", 3, "HIGH", 3), ("y", 1, "LOW", 1)]


def test_gate_and_summary(spark, three):
    assert FN.gate(three).first()[0] == 2
    assert FN.gate(three.where("severity <> 'CRITICAL'")).first()[0] == 1
    assert FN.gate(three.where("severity = 'MEDIUM'")).first()[0] == 0
    assert FN.gate(three.where("false")).first()[0] == 0
    odd = three.withColumn("severity", F.when(F.col("severity") == "HIGH", "ODD").otherwise(F.col("severity")))
    assert collect(FN.severity_summary(odd)) == [("CRITICAL", 1), ("HIGH", 0), ("INFO", 0), ("LOW", 0), ("MEDIUM", 1), ("ODD", 1)]


def test_query_filters_and_validation(spark, three):
    pairs = G.store_tables(three, KB)["finding_cwe_map"]
    assert [r.type for r in FN.query_findings(three).collect()] == [f["type"] for f in THREE]
    for f in THREE:
        assert FN.query_findings(three, severity=f["severity"].lower()).count() == 1
    for cwe in ("CWE-798", "cwe:CWE-798"):
        assert [r.type for r in FN.query_findings(three, pairs, cwe_id=cwe).collect()] == ["api_key_in_header"]
    assert FN.query_findings(three, limit=2).count() == 2
    assert FN.query_findings(three, severity="UNKNOWN").count() == 0
    for bad in ({"severity": "BAD"}, {"limit": 0}, {"limit": -1}, {"cwe_id": "CWE-1"}):
        with pytest.raises(ValueError):
            FN.query_findings(three, **bad)


# --- graph ------------------------------------------------------------------


def test_one_aws_key(spark, tmp_path):
    one = [{"type": "api_key_in_header", "severity": "HIGH", "description": "AWS key", "url": "https://a/", "method": "get"}]
    f = FN.normalize(readers.read_report(spark, report(tmp_path, one)))
    nodes, edges = G.nodes(f, KB), G.edges(f, KB)
    assert [r.id for r in nodes.where("label = 'CWE'").collect()] == ["cwe:CWE-798"]
    assert edges.where("label = 'is_instance_of'").count() == 1
    assert nodes.where("label in ('Finding', 'Endpoint')").count() == 2
    assert edges.where("label = 'targets'").count() == 3


def test_static_part_is_there_without_findings(spark, three):
    none = three.where("false")
    stats = {r.kind: r.n for r in G.graph_stats(G.nodes(none, KB), G.edges(none, KB)).collect()}
    assert stats == {"findings": 0, "endpoints": 0, "cwes": 0, "owasps": 10, "mitigations": 21, "attack_vectors": 0, "code_examples": 38, "edges": 38}


def test_end_to_end(spark, three, tmp_path):
    nodes, edges = G.nodes(three, KB), G.edges(three, KB)
    writers.write_graph(nodes, edges, str(tmp_path / "graph"))
    n2, e2 = readers.read_graph(spark, str(tmp_path / "graph"))
    assert collect(e2) == collect(edges)
    assert collect(n2.select("id", "label", "name")) == collect(nodes.select("id", "label", "name"))
    assert edges.select("src", "dst").distinct().count() == edges.count()
    stats = {r.kind: r.n for r in G.graph_stats(n2, e2).collect()}
    assert stats["findings"] == 3 and stats["cwes"] >= 2 and stats["endpoints"] == 1
    paths = G.finding_paths(e2, KnowledgeBase())
    assert paths.select("finding").distinct().count() == 3
    assert {r.owasp for r in paths.where("cwe = 'cwe:CWE-798'").collect()} == {"owasp:A07"}
    next_ = G.successors(n2, e2, "cwe:CWE-798", "belongs_to").collect()
    assert [(r.dst, r.dst_label) for r in next_] == [("owasp:A07", "OWASP")]


def test_pattern_name_maps_to_a_weakness_too(spark):
    df = FN.normalize(spark.createDataFrame([("custom", "git_pattern"), ("browser_storage", "api_key_in_url"), ("custom", None)], "type string, pattern string"))
    assert [r.cwe_id for r in G.with_cwe(df, KB).orderBy("type", F.col("pattern").desc_nulls_last()).collect()] == ["CWE-798", "CWE-798", None]


def test_weaknesses_without_category_have_no_mitigation(spark):
    df = G.with_cwe(FN.normalize(spark.createDataFrame([("js_pattern",)], "type string")), KB)
    assert [r.mitigation_id for r in G.with_mitigation(df, KB).collect()] == [None]
    assert [r.owasp_id for r in G.with_owasp(df, KB).collect()] == [None]


def test_store(spark, three, tmp_path):
    writers.write_store(G.store_tables(three, KB), str(tmp_path / "store"))
    tables = readers.read_store(spark, str(tmp_path / "store"))
    assert collect(G.store_stats(tables)) == [("cwes", 3), ("endpoints", 1), ("finding_cwe_maps", 3), ("findings", 3)]
    assert tables["mitigations"].count() == 21 and tables["cwe_owasp_map"].count() == 38
    empty = G.store_tables(three.where("false"), KB)
    assert all(r.n == 0 for r in G.store_stats(empty).collect())
    scan = tables["findings"].where("severity = 'HIGH'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(severity" in scan


def test_enrichment_does_not_shuffle_findings(three):
    plan = G.with_mitigation(G.with_cwe(three, KB), KB)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_read_knowledge_base(spark, tmp_path):
    (tmp_path / "cwe.json").write_text(json.dumps({"mappings": [{"finding_types": ["t"], "cwe_id": "CWE-1", "cwe_name": "n", "severity": "LOW", "attack_vectors": ["a_b"]}]}, indent=1))
    kb = read_knowledge_base(spark, str(tmp_path / "cwe.json"), str(tmp_path / "none.json"))
    assert kb.owasp == () and kb.cwes[0][0] == "CWE-1" and kb.cwes[0][4] == ("t",)
    df = G.with_cwe(FN.normalize(spark.createDataFrame([("t",)], "type string")), kb)
    row = G.with_attack_vectors(df, kb).first()
    assert (row.cwe_id, row.vector_name) == ("CWE-1", "A B")
    assert G.edges(FN.normalize(spark.createDataFrame([("t",)], "type string")), kb).count() == 2


# --- retrieval --------------------------------------------------------------


def test_tokens():
    assert R.tokens("How to FIX the API_key in an x?") == ["how", "fix", "the", "api_key"]


def findings(spark, *rows):
    df = spark.createDataFrame([(s, v, i) for i, (s, v) in enumerate(rows)], "summary string, severity string, ts int")
    return FN.normalize(df.withColumn("type", F.lit("t")))


def test_keyword_topk(spark):
    df = findings(spark, ("key leak", "MEDIUM"), ("key leak again", "CRITICAL"), ("KEY leak", "HIGH"), ("other", None), ("api key leak", "LOW"))
    assert [r.severity for r in R.keyword_topk(df, "key").collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert [r.severity for r in R.keyword_topk(df, "API key").collect()][0] == "LOW"
    assert R.keyword_topk(df, "unrelated words").count() == 0
    assert collect(R.keyword_topk(df, "Key")) == collect(R.keyword_topk(df, "KEY"))
    for bad in (("", 5), ("  ", 5), ("key", 0), ("key", -1)):
        with pytest.raises(ValueError):
            R.keyword_topk(df, *bad)


def test_k_limit(spark):
    df = findings(spark, *[(f"Finding {i}", "HIGH") for i in range(5)])
    assert [R.keyword_topk(df, "finding", k).count() for k in (3, 5, 10)] == [3, 5, 5]


def test_batch_equals_single(spark):
    df = findings(spark, *[(f"word{i % 3} and word{i % 5}", s) for i, s in enumerate(["LOW", "HIGH", "INFO", "CRITICAL"] * 10)])
    queries = [(f"q{i}", f"word{i % 5} word{i % 3}") for i in range(70)]
    batch = R.keyword_topk_batch(df, queries, 4).collect()
    for qid, text in queries[:3] + queries[-3:]:
        single = [(r.id, r.score) for r in R.keyword_topk(df, text, 4).collect()]
        assert [(r.id, r.score) for r in sorted((r for r in batch if r.query_id == qid), key=lambda r: r["rank"])] == single


def test_prompt_and_citation(spark):
    ctx = spark.createDataFrame([("q", 2, "f2", "s2", None, "u2"), ("q", 1, "f1", "s1", "HIGH", None)], "query_id string, rank int, id string, summary string, severity string, url string")
    text = R.join_contexts(ctx).first().context
    assert text == "[Source: f1] Severity: HIGH URL:  Summary: s1\n[Source: f2] Severity: INFO URL: u2 Summary: s2"
    df = spark.createDataFrame(
        [("a", ["f1", "f2", "f3", "f4", "f5", "f6"]), ("b [Source: x]", ["f1"]), ("c", []), ("d", [None])], "text string, ids array<string>"
    )
    out = [r[0] for r in df.select(R.with_citation("text", "ids")).collect()]
    assert out == [
        "a\n\nCitations: [Source: f1], [Source: f2], [Source: f3], [Source: f4], [Source: f5]",
        "b [Source: x]", "c\n\n[NOTE] No retrieved contexts available to cite.", "d",
    ]
    done = R.finish_answers(df).collect()
    assert [r.cited for r in done] == [True, True, False, False]
    full = df.limit(1).select(R.prompt(F.lit(None).cast("string"), F.lit("why?"))).first()[0]
    assert "(no contexts)" in full and "Query: why?" in full


# --- extensions -------------------------------------------------------------


def test_scan_diff(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "finding_id string")
    b = spark.createDataFrame([("y",), ("z",)], "finding_id string")
    assert collect(X.scan_diff(a, b)) == [("x", "fixed"), ("y", "persisting"), ("z", "new")]


def test_entropy(texts):
    df = texts("aaaaaaaaaaaaaaaaaaaaaaaa abcdefghijklmnopqrstuvwxyz012345")
    rows = X.entropy_tokens(df, "text", keep=["id"]).collect()
    assert [(r.token_no, r.original_length, r.entropy) for r in rows] == [(1, 32, 5.0)]


def test_globs(spark):
    paths = ["node_modules/a/b.js", "src/node_modules/x", "a.min.js", "src/a.min.js", "src/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in df.select(X.ignored_path("path", ["**/node_modules/**", "*.min.js"])).collect()]
    assert got == [True, True, True, False, False]


def test_text_index(spark):
    df = findings(spark, ("alpha beta beta", "LOW"), ("alpha gamma", "LOW"), ("alpha", "LOW"))
    rows = X.search_index(X.text_index(df), "beta alpha", 3).collect()
    assert rows[0].score == pytest.approx(2 * 1.098612, abs=1e-5) and len(rows) == 3


def test_no_warning_on_a_normal_report(spark, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        readers.read_report(spark, report(tmp_path, THREE))


def test_reachable_is_a_breadth_first_search(spark):
    import random

    rnd = random.Random(2)
    pairs = [(rnd.randrange(25), rnd.randrange(25), rnd.choice("xy")) for _ in range(45)] + [(1, 2, "x"), (2, 1, "x"), (3, 3, "x")]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", c) for a, b, c in pairs], "src string, dst string, label string")
    start = spark.createDataFrame([("n1",), ("n1",), ("n3",), ("n7",), ("none",), (None,)], "id string")
    for labels, depth in ((None, 30), (("x",), 30), (None, 2)):
        out = {}
        for a, b, c in pairs:
            if labels is None or c in labels:
                out.setdefault(f"n{a}", set()).add(f"n{b}")
        want = set()
        for s in ("n1", "n3", "n7"):
            seen, level = {}, {s}
            for d in range(1, depth + 1):
                level = {y for x in level for y in out.get(x, ()) if y not in seen}
                seen |= dict.fromkeys(level, d)
            want |= {(s, n, d) for n, d in seen.items()}
        got = [tuple(r) for r in G.reachable(edges, start, depth, labels).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        G.reachable(edges, start, 0)
