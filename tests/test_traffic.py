from conftest import AWS, GENERIC, GHP, collect
from pyspark.sql import functions as F

from leakscope.catalog import default_catalog
from leakscope.functions import scalars as S
from leakscope.operators import findings as FN
from leakscope.operators import traffic as T
from leakscope.sources.readers import EXCHANGE, TRAFFIC_LOG

P = default_catalog()
OPENAI = "sk-" + "a1" * 12


def exchange(spark, **kw):
    row = {"ts": 1, "client": "c", "method": "GET", "url": "https://a.example/p", "req_headers": {}, "req_body": None,
           "status": 200, "resp_headers": {}, "resp_body": None} | kw
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in EXCHANGE.replace("map<string,string>", "map").split(", "))], EXCHANGE)


def test_bypass_truth_table(spark):
    rows = [
        ("http://localhost:3000/", True), ("http://127.0.0.1/", True), ("http://[::1]/", True),
        ("https://api.openai.com/v1", True), ("https://eu.api.stripe.com/", True), ("https://notstripe.com/", False),
        ("https://x.execute-api.eu-west-1.example.com/", True), ("https://b.s3.amazonaws.com/", True), ("https://d1.cloudfront.net/", True),
        ("https://app.example.com/OAuth2/x", True), ("https://app.example.com/lesson", True), ("https://app.example.com/auth", True),
        ("https://app.example.com/v1", False), ("/login", False), ("", False),
    ]
    df = spark.createDataFrame(rows, "url string, want boolean").select("url", "want", T.bypassed("url").alias("got"))
    assert [(r.url, r.got) for r in df.collect()] == [(u, w) for u, w in rows]


def test_ignore_truth_table(spark):
    rows = [("https://accounts.google.com/x", True), ("https://maps.googleapis.com/", True), ("https://dev-1.OKTA.com/", True),
            ("https://a.example/auth/x", True), ("https://a.example/auth", False), ("https://a.example/", False)]
    df = spark.createDataFrame(rows, "url string, want boolean").select("want", T.ignored("url").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_hash_like_truth_table(spark):
    rows = [("short", False), ("$2b$12$abcdefgh", True), ("$2x$12$abcdefgh", False), ("$argon2id$v=19", True), ("a" * 64, True), ("A" * 128, True),
            ("g" * 64, True), ("a" * 63 + "!", False), ("ab+/" * 10, False), ("ab+/" * 11, True), ("plainpassword", False), (None, False)]
    df = spark.createDataFrame(rows, "v string, want boolean").select("v", "want", S.looks_hashed("v").alias("got"))
    assert [r.got for r in df.collect()] == [w for _, w in rows]


def test_header_severity_truth_table(spark):
    def row(url, name):
        return T.header_key(exchange(spark, url=url, req_headers={name: f"Bearer {OPENAI}"}), P).first()

    expected = row("https://a.example/", "Authorization")
    assert expected.severity == "HIGH" and "expected for server-side" in expected.description and expected.pattern == "OPENAI_API_KEY"
    insecure = row("http://a.example/", "authorization")
    assert insecure.severity == "CRITICAL" and "insecure HTTP" in insecure.description
    other = row("https://a.example/", "X-Api-Key")
    assert other.severity == "HIGH" and other.description == "Potential OPENAI_API_KEY in header X-Api-Key"
    assert row("https://a.example/", "X-Other") is None


def test_alert_filter(spark):
    expected = T.header_key(exchange(spark, req_headers={"Authorization": OPENAI}), P)
    critical = T.header_key(exchange(spark, url="http://a.example/", req_headers={"Authorization": OPENAI}), P)
    other = T.header_key(exchange(spark, req_headers={"Authorization": AWS}), P)
    assert [FN.alerts(f).count() for f in (expected, critical, other)] == [0, 1, 1]


def test_url_credentials_drop_the_secret_unless_asked(spark):
    df = exchange(spark, url="https://user:pw@a.example/p?q=1")
    assert T.url_credentials(df).first().url == "https://a.example/p"
    assert T.url_credentials(df, keep_userinfo=True).first().url == "https://user:pw@a.example/p"
    assert T.url_credentials(exchange(spark, url="https://a.example/u@v")).count() == 0


def test_passwords_per_occurrence(spark):
    body = '{"password": "hunter22", "pwd":"abc", "passwd": "$2b$12$abcdefgh", PASS=another}'
    rows = T.plaintext_password(exchange(spark, req_body=body)).collect()
    assert sorted(r.field for r in rows) == ["PASS", "password"]
    assert "hunter22" not in str(rows)


def test_response_body_needs_a_text_type(spark):
    for kind, n in (("text/html", 1), ("Application/JSON", 1), ("image/png", 0)):
        df = exchange(spark, resp_headers={"content-type": kind}, resp_body=AWS)
        assert T.response_body_secret(df, P).count() == n
    assert T.response_body_secret(exchange(spark, resp_body=AWS), P).count() == 0


def test_one_pass_gives_what_the_single_checks_give(spark):
    rows = [
        exchange(spark, url=f"http://u:p@a.example/x?k={GENERIC}", req_headers={"Authorization": "Basic abc", "Api-Key": GHP}),
        exchange(spark, method="POST", req_body=f'{{"password":"hunter22","k":"{AWS}","g":"{GHP}"}}'),
        exchange(spark, resp_headers={"Content-Type": "text/plain", "X-Debug": f"{GHP} {AWS}"}, resp_body=f"{AWS} {GHP}"),
        exchange(spark, resp_headers=None, req_headers=None, url=f"/rel?{GENERIC}"),
    ]
    df = rows[0]
    for r in rows[1:]:
        df = df.unionByName(r)
    single = [
        T.url_credentials(df), T.url_query_key(df, P), T.basic_auth(df), T.header_key(df, P), T.plaintext_password(df),
        T.body_secret(df, P), T.response_header_secret(df, P), T.response_body_secret(df, P),
    ]
    cols = ["finding_id", "type", "severity", "pattern", "url", "header", "field", "snippet", "original_length", "description"]
    merged = FN.union_findings(single).select(cols)
    assert sorted(map(str, merged.collect())) == sorted(map(str, T.scan_traffic(df, P).select(cols).collect()))
    assert merged.count() == 13


def test_split_log(spark):
    log = spark.createDataFrame(
        [
            (5, "t", "mitm_outbound", "requests", "GET", "https://a.example/", None, None, None, None, None, None, None, None),
            (6, "t", "mitm_bypass", "requests", "GET", "https://b.example/", None, None, None, None, None, None, None, None),
            (7, "t", "security_finding", "httpx", None, "https://a.example/", "HIGH", "api_key_in_header", "GITHUB_PAT", None, None, "Authorization", None, None),
        ],
        TRAFFIC_LOG,
    )
    rows = {r.type: r for r in T.split_log(log).collect()}
    assert rows["mitm_proxied_request"].description == "Proxied request via MITM: GET https://a.example/ (client=requests)"
    assert rows["mitm_proxied_request"].severity == "INFO"
    assert rows["api_key_in_header"].summary == "MITM security finding" and rows["api_key_in_header"].header == "Authorization"
    assert collect(T.stage_counts(log)) == [(1, 1, 1)]
    assert [r.ts for r in T.newest(log, 2).collect()] == [7, 6]
    stamped = T.stamp(T.split_log(log)).where("ts = 7").first()
    assert (stamped.stage, stamped.timestamp) == ("security_finding", "1970-01-01 00:00:07")


def test_newest_per_client_is_exact_beyond_the_pushed_rank(spark):
    df = spark.range(5000).selectExpr("id AS ts", "IF(id % 3 = 0, 'a', 'b') AS client")
    out = T.newest_per_client(df, 1200)
    counts = {r.client: (r.n, r.low) for r in out.groupBy("client").agg(F.count("*").alias("n"), F.min("ts").alias("low")).collect()}
    newest = [sorted((i for i in range(5000) if (i % 3 == 0) == third), reverse=True)[1199] for third in (True, False)]
    assert counts == {"a": (1200, newest[0]), "b": (1200, newest[1])}
