from conftest import AWS, GENERIC, GHP, collect
from pyspark.sql import functions as F

from leakscope.catalog import default_catalog
from leakscope.operators import web as W

P = default_catalog()
PAGE = "url string, status int, headers map<string,string>, set_cookies array<string>, body string"


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE)


def test_page_checks(spark):
    df = pages(
        spark,
        ("http://a/1", 200, {"Server": AWS, "ETag": AWS, "X-K": f"{AWS} {GHP}"}, ["sessionid=" + GHP, " Auth = " + GHP], "x " + GENERIC),
        ("http://a/2", 404, {}, [], None),
    )
    found = W.scan_pages(df, P)
    by_type = {r.type: r.n for r in found.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert by_type == {"status": 2, "response_pattern": 1, "header_pattern": 3, "cookie_pattern": 2}
    assert {r.key for r in found.where("type = 'cookie_pattern'").collect()} == {"auth"}
    assert W.real_issues(found).where("type = 'status'").count() == 1
    dump = str(found.collect())
    assert AWS not in dump and GHP not in dump


def test_wrap_modes(spark):
    found = W.response_patterns(pages(spark, ("http://a/1", 200, {}, [], AWS)), P)
    assert W.wrap(found).first().type == "response_pattern"
    hidden = W.wrap(found, hide_type=True).first()
    assert (hidden.type, hidden.metadata["type"], hidden.summary) == ("crawler_issue", "response_pattern", "response_pattern")


def test_links_and_assets(spark):
    df = pages(
        spark,
        ("http://h/d/1", 200, {}, [], "<script src='app.js'></script><a HREF=\"/x\">"),
        ("http://h/d/2", 200, {}, [], "<script src='app.js'></script><script src='app.js'></script><script src='big.js'></script>"),
    )
    found = W.links(df)
    assert collect(found.select("link").distinct()) == [("http://h/d/app.js",), ("http://h/d/big.js",), ("http://h/x",)]
    assets = spark.createDataFrame(
        [("http://h/d/app.js", 200, f"var k='{GHP}'"), ("http://h/d/big.js", 200, "x" * 600_000 + AWS), ("http://h/d/no.js", 200, AWS)],
        "url string, status int, content string",
    )
    hits = W.asset_patterns(found, assets, P)
    by_url = {(r.url, r.pattern): r.n for r in hits.groupBy("url", "pattern").agg(F.count("*").alias("n")).collect()}
    assert by_url == {("http://h/d/app.js", "Github Token"): 3, ("http://h/d/app.js", "Github Pat"): 3, ("http://h/d/big.js", "Aws Access Key Id"): 1}
    limited = W.asset_patterns(found, assets, P, max_bytes=500_000, per_reference=False)
    assert {(r.url, r.pattern): r.metadata["links"] for r in limited.collect()} == {("http://h/d/app.js", "Github Token"): "3", ("http://h/d/app.js", "Github Pat"): "3"}


def test_source_maps(spark):
    df = pages(spark, ("http://h/d/1", 200, {}, [], "//# sourceMappingURL=app.js.map\n//# sourceMappingURL = sub/x.map"))
    refs = W.source_map_refs(df)
    assert collect(refs.select("link")) == [("http://h/d/app.js.map",), ("http://h/d/sub/x.map",)]
    maps = spark.createDataFrame(
        [("http://h/d/app.js.map", 200, '{"sourcesContent": ["a", "%s"]}' % AWS), ("http://h/d/sub/x.map", 500, '{"sourcesContent": ["%s"]}' % AWS), ("http://h/z", 200, "not json")],
        "url string, status int, content string",
    )
    rows = W.source_map_patterns(refs, maps, P).collect()
    assert [(r.url, r.metadata["source_index"]) for r in rows] == [("http://h/d/app.js.map", "1")]


def test_crawl_levels_budget_and_host(spark):
    edges = spark.createDataFrame(
        [("http://a/", "http://a/1"), ("http://a/", "http://b/"), ("http://a/1", "http://a/2"), ("http://a/2", "http://a/"), ("http://a/1", "http://a/3"), ("http://b/", "http://b/1")],
        "src string, dst string",
    )
    assert collect(W.crawl(edges, "http://a/")) == [("http://a/", 0), ("http://a/1", 1), ("http://a/2", 2), ("http://a/3", 2)]
    assert collect(W.crawl(edges, "http://a/", max_pages=3)) == [("http://a/", 0), ("http://a/1", 1), ("http://a/2", 2)]
    assert W.crawl(edges, "http://a/", same_host_only=False, max_pages=None).count() == 6


def test_probes_and_catch_all(spark):
    rows = [("a", f"http://a{p}", 200, "same") for p in ("/.env", "/.git/config", "/config.php")]
    rows += [("b", "http://b/.env", 200, "same"), ("b", "http://b/.git/HEAD", 200, "same"), ("b", "http://b/other", 200, "same")]
    rows += [("c", "http://c/.env", 200, "x"), ("c", "http://c/.htaccess", 200, "y"), ("c", "http://c/info.php", 404, "z"), ("c", "http://c/config.yml", 200, " \n "), ("c", "http://c/.DS_Store", 200, "w" * 900)]
    df = spark.createDataFrame(rows, "host string, url string, status int, body string")
    found = W.exposed_paths(df)
    counts = {(r.host, r.type): r.n for r in found.groupBy(F.substring("url", 8, 1).alias("host"), "type").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", "false_positive_catchall"): 3, ("b", "exposed_path"): 2, ("c", "exposed_path"): 3}
    assert found.agg(F.max("original_length")).first()[0] == 800


def test_many_references_to_one_asset(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 100)
    found = spark.range(1234).selectExpr("concat('http://h/p', id) AS page_url", "'http://h/app.js' AS link")
    assets = spark.createDataFrame([("http://h/app.js", 200, AWS)], "url string, status int, content string")
    assert W.asset_patterns(found, assets, P).count() == 1234
