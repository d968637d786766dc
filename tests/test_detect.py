import random

from conftest import AWS, GENERIC, GHP, collect
from pyspark.sql import functions as F

from leakscope.catalog import default_catalog, make_catalog
from leakscope.operators import detect as D

P = default_catalog()


def found(df):
    return sorted((r.id, r.pattern, r.original_length) for r in df.collect())


def test_every_pattern_hits_once_and_is_masked(texts):
    df = texts(f"{AWS} and {AWS}", f"x {GHP} y", "nothing", None, "")
    hits = D.scan(df, "text", P, keep=["id"])
    assert found(hits) == [(0, "Aws Access Key Id", 20), (1, "Github Pat", 40), (1, "Github Token", 40)]
    assert {r.snippet for r in hits.collect()} == {"[REDACTED]"}
    assert AWS not in str(hits.collect())


def test_first_mode_stops_at_the_first_pattern_in_catalog_order(texts):
    assert found(D.scan(texts(f"{GHP} {AWS}"), "text", P, keep=["id"], mode="first")) == [(0, "Aws Access Key Id", 20)]


def test_cap(texts):
    long = "sk-" + "a" * 900
    assert found(D.scan(texts(long), "text", P, keep=["id"], cap=200)) == [(0, "Openai Api Key", 200)]


def test_lines(texts):
    df = texts(f"a\n{AWS}\nb {AWS}", "none\n")
    rows = D.scan_lines(df, "text", P, keep=["id"]).collect()
    assert sorted((r.id, r.line_no) for r in rows) == [(0, 1), (0, 2)]


def test_lines_with_an_anchored_pattern(texts):
    anchored = make_catalog([("START", "^key[0-9]+$")])
    rows = D.scan_lines(texts("a\nkey12\nb key3"), "text", anchored, keep=["id"]).collect()
    assert [(r.line_no, r.original_length) for r in rows] == [(1, 5)]


def test_java_only_regex_is_scanned_without_the_prefilter(texts):
    look = make_catalog([("LOOK", "(?<=id:)[0-9]{3}"), ("BACK", r"(ab)\1")])
    assert D.might_match("text", [p.regex for p in look]) is None
    assert found(D.scan(texts("id:123", "abab", "id 123"), "text", look, keep=["id"])) == [(0, "Look", 3), (1, "Back", 4)]


def test_occurrences(texts):
    rows = D.occurrences(texts(f"{AWS} {AWS} {GHP}"), "text", P, keep=["id"]).collect()
    assert sorted((r.pattern, r.occurrences, r.original_length) for r in rows) == [
        ("Aws Access Key Id", 2, 20), ("Github Pat", 1, 40), ("Github Token", 1, 40),
    ]


def test_whole_match_length_for_a_pattern_with_groups(texts):
    rows = D.scan(texts("-----BEGIN RSA PRIVATE KEY-----"), "text", P, keep=["id"]).collect()
    assert [(r.pattern, r.original_length) for r in rows] == [("Private Key", 31)]


def test_late_match_in_a_long_text(texts):
    assert found(D.scan(texts("x" * 700_000 + AWS), "text", P, keep=["id"])) == [(0, "Aws Access Key Id", 20)]


def test_invalid_utf8_is_still_scanned(spark):
    df = spark.range(1).select("id", F.expr(f"CAST(concat(X'FF', CAST('redis://:p' AS binary), X'FE', CAST('q@h' AS binary)) AS string)").alias("text"))
    assert [r.pattern for r in D.scan(df, "text", P, keep=["id"]).collect()] == ["Redis Url"]


def test_prefilter_never_drops_a_match(spark):
    """Random texts from pieces of secrets: what the exact test finds, the automaton lets pass."""
    rng = random.Random(3)
    pieces = [AWS, GHP, GENERIC, "secret", "token", "=", ":", "'", '"', " ", "\x0b", "\n", "é", "ſecret", "Bearer", "a" * 25, "ya29.", "mongodb://u:p@h", "K"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 6)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, text string")
    exact = df.where(F.expr(" OR ".join(f"({D._test('text', p)})" for p in P)))
    passed = df.where(D.might_match("text", [p.regex for p in P]))
    assert exact.exceptAll(passed).count() == 0
    by_scan = D.scan(df, "text", P, keep=["id"]).select("id").distinct()
    assert collect(by_scan) == collect(exact.select("id"))
    assert exact.count() > 300


def test_scan_with_a_catalog_table(spark, texts):
    table = spark.createDataFrame([(1, "B", "b+"), (0, "A", "a+")], "ord int, raw_name string, regex string")
    rows = D.scan_with_table(texts("xxbbaa"), "text", table, keep=["id"]).collect()
    assert sorted((r.ord, r.pattern, r.original_length) for r in rows) == [(0, "A", 2), (1, "B", 2)]


def test_redaction(texts):
    df = texts(f"Use {AWS} now", "x" * 45, f"[Source: {'a' * 40}] and {'b' * 40}")
    assert [r.r for r in df.select(D.redact("text").alias("r")).collect()] == ["Use [REDACTED] now", "[REDACTED]", "[Source: [REDACTED]] and [REDACTED]"]
    kept = df.select(D.redact_keeping_citations("text").alias("r")).collect()[2].r
    assert kept == f"[Source: {'a' * 40}] and [REDACTED]"


def test_unescape(texts):
    df = texts("token = &quot;0123456789abcdefghij&quot;")
    assert D.scan(df, "text", P, keep=["id"]).count() == 0
    assert D.scan(df.withColumn("text", D.unescape_html("text")), "text", P, keep=["id"]).count() == 1
