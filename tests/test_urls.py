from urllib.parse import urljoin, urlsplit

from leakscope.functions import urls as U

BASE = ["http://a.example/b/c/d?q=1#f", "https://h.example", "https://h.example/", "http://h:81/x/y/", "http://u:p@h.example/a/b"]
REFS = ["", "g", "./g", "g/", "/g", "//other/x", "?y", "g?y", "#s", "g#s", "../g", "../../g", "../../../g", "./../g", "g/./h", "g/../h",
        "http://z/x", "https://z", "mailto:a@b", "javascript:void(0)", "/a/./b/../c", "..", ".", "/..", "x/..", "a b"]
URLS = ["http://user:pw@Host.Example:8080/a/b?x=1#y", "https://[2001:DB8::1]:443/p", "/rel?x", "http://h_x/%zz", "ftp://h/a b", "HTTP://H", "http://@h/", "https://a@b@c/d", "x"]


def test_join_agrees_with_the_standard_library(spark):
    pairs = [(b, r) for b in BASE for r in REFS]
    df = spark.createDataFrame(pairs, "b string, r string").select("b", "r", U.join("b", "r").alias("j"))
    wrong = [(x.b, x.r, x.j, urljoin(x.b, x.r)) for x in df.collect() if x.j != urljoin(x.b, x.r)]
    assert wrong == []


def test_split_agrees_with_the_standard_library(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select(
        "u", U.scheme("u").alias("scheme"), U.host("u").alias("host"), U.path("u").alias("path"), U.query("u").alias("query")
    )
    for r in df.collect():
        s = urlsplit(r.u)
        assert (r.scheme, r.host, r.path, r.query) == (s.scheme, s.hostname or "", s.path, s.query), r.u


def test_redacted_drops_user_query_and_fragment(spark):
    df = spark.createDataFrame([(URLS[0],)], "u string")
    assert df.select(U.redacted("u")).first()[0] == "http://Host.Example:8080/a/b"
    assert df.select(U.redacted("u", keep_userinfo=True)).first()[0] == "http://user:pw@Host.Example:8080/a/b"


def test_same_host(spark):
    rows = [("/x", True), ("http://a.example/y", True), ("http://localhost:3000/", True), ("http://127.0.0.1/", True), ("http://b.example/", False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in df.select("want", U.same_host("u", F.lit("a.example")).alias("got")).collect())
