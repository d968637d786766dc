"""The physical plans that the operators are written for."""

import re

import pytest

from leakscope.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    return text.split("== Physical Plan ==")[1]


def test_scan_reads_two_columns_and_has_no_shuffle_of_its_own(spark):
    text = plan(spark, "pattern_scan_docs")
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)
    # The only exchange is the round-robin that spreads a table smaller than the cluster.
    assert re.findall(r"Exchange (\w+)", text) == ["RoundRobinPartitioning"]


def test_regexes_run_behind_the_prefilter(spark):
    for name in ("pattern_scan_docs", "first_pattern", "url_query_key", "scan_traffic"):
        text = plan(spark, name)
        below = text[text.index("ArrowEvalPython"):]
        assert "AKIA[0-9A-Z]{16}) THEN" not in below.split("FileScan")[0], name


def test_top_per_key_is_limited_before_the_shuffle(spark):
    for name in ("traffic_tail_per_client", "pickaxe_topn", "keyword_topk_batch", "knn_join"):
        text = plan(spark, name)
        assert "WindowGroupLimit" in text and "Partial" in text, name


def test_global_top_needs_no_full_sort(spark):
    for name in ("traffic_tail", "query_by_severity", "keyword_topk", "cosine_topk", "fts_rank"):
        assert "TakeOrderedAndProject" in plan(spark, name), name


def test_enrichment_shuffles_only_aggregates(spark):
    text = plan(spark, "enrich_owasp")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"crawl_reach"} - {n for n in QUERIES if n.startswith("stream")}))
def test_no_cross_join_and_no_nested_loop(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
