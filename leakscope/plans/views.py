"""Inputs of the registered queries, derived from the given tables.

The tables hold few secrets, so planted ones are pure functions of row ids.  Each
view covers every row of the table it is built from.  ``oracle.py`` builds the
same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import urls as U
from ..operators import findings as FN
from ..operators import traffic as TR
from ..session import spread
from ..values import PROBE_PATHS

# The finding types of the knowledge base, in its order.
FINDING_TYPES = (
    "api_key_in_header", "api_key_in_url", "git_pattern", "plaintext_password", "password_in_body",
    "url_embedded_credentials", "basic_auth_header", "secret_in_response_body", "secret_in_response_header",
    "response_pattern", "browser_storage", "cookie_insecure", "exposed_path", "js_pattern",
    "sourcemap_pattern", "header_pattern", "cookie_pattern", "browser_global",
)
CLIENTS = ("requests", "httpx", "aiohttp")
LOG_PATTERNS = ("GITHUB_PAT", "GROQ_API_KEY", "AWS_ACCESS_KEY_ID", "git_pattern")
STORAGE_KEYS = ("auth_token", "theme", "apiBase", "lang", "sessionKey", "cart", "clientSecret", "user")
# Second scan of the comparison starts here; the first ends six days later.
SCAN_B_START = 1704844800
SCAN_A_END = 1705363200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def h(c: str) -> Column:
    return F.sha1(F.col(c).cast("string"))


def github_key(c: str) -> Column:
    return F.concat(F.lit("ghp_"), F.substring(h(c), 1, 36))


def aws_key(c: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(h(c), 1, 16)))


def generic_key(c: str) -> Column:
    return F.concat(F.lit("api_key="), F.substring(h(c), 1, 24))


def every(c: str, n: int, r: int = 0) -> Column:
    return F.col(c) % n == r


def pick(values, index: Column) -> Column:
    return F.element_at(S.text_array(values), (index + 1).cast("int"))


# --- texts ------------------------------------------------------------------


def documents(spark, d, *more: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", *more))


def raw_pages(spark, d) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "url", "html"))


def commit_diffs(spark, d) -> DataFrame:
    """Two-file unified diffs; ten documents make a commit."""
    docs = documents(spark, d)
    group = F.floor(F.col("doc_id") / 10)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    signed = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.when((F.col("doc_id") + i) % 5 == 4, "-").otherwise("+"), line),
    )
    note = F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md"))
    planted = F.when(every("doc_id", 13), F.concat(F.lit("+key "), aws_key("doc_id"))).when(
        every("doc_id", 7), F.concat(F.lit("-old "), github_key("doc_id"))
    ).otherwise("+nothing")
    diff = F.concat(
        F.lit("diff --git a/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -0,0 +1 @@\n"),
        F.array_join(signed, "\n"),
        F.lit("\ndiff --git a/"), note, F.lit("\n--- a/"), note, F.lit("\n+++ b/"), note, F.lit("\n@@ -0,0 +1 @@\n"), planted,
    )
    return docs.select(
        F.sha1(group.cast("string")).alias("commit"),
        (F.lit(1700000000) + group * 3600).cast("bigint").alias("commit_ts"),
        diff.alias("diff"),
    )


# --- pages ------------------------------------------------------------------


def pages(spark, d) -> DataFrame:
    """Pages with planted links, script references, a source-map reference and a key."""
    p = raw_pages(spark, d)
    number = F.col("page_id").cast("string")
    two = (F.col("page_id") * 2).cast("string")
    body = F.concat(
        "html",
        F.lit('<script src="https://cdn.example.com/asset/0.js"></script><script src="https://cdn.example.com/asset/'), two, F.lit('.js"></script>'),
        F.lit('<a href="../up/'), number, F.lit('">u</a><a href="?p='), number, F.lit('">q</a><a href="#top">t</a><a href="sub/./x.html">x</a>'),
        F.when(every("page_id", 8), F.concat(F.lit("\n//# sourceMappingURL=/maps/"), number, F.lit(".js.map"))).otherwise(""),
        F.when(every("page_id", 9), F.concat(F.lit("<!-- "), generic_key("page_id"), F.lit(" -->"))).otherwise(""),
    )
    return p.select("page_id", "url", body.alias("body"))


def exchanges(spark, d) -> DataFrame:
    p = pages(spark, d)
    with_user = F.when(every("page_id", 17), F.replace("url", F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url"))
    bare = F.split_part(with_user, F.lit("#"), F.lit(1))
    joint = F.when(bare.contains("?"), "&").otherwise("?")
    url = F.when(every("page_id", 7), F.concat(bare, joint, generic_key("page_id"))).otherwise(with_user)
    authorization = (
        F.when(every("page_id", 11), F.concat(F.lit("Bearer "), github_key("page_id")))
        .when(every("page_id", 19), F.lit("Basic dXNlcjpwdw=="))
    )
    password = (
        F.when(every("page_id", 5), F.concat(F.lit('{"user":"u","password":"hunter-'), F.substring(h("page_id"), 1, 6), F.lit('"}')))
        .when(every("page_id", 5, 1), F.concat(F.lit('{"user":"u","password":"$2b$12$'), F.substring(h("page_id"), 1, 22), F.lit('"}')))
        .when(every("page_id", 5, 2), F.concat(F.lit('token="'), h("page_id"), F.lit('"')))
    )

    def headers(**named: Column) -> Column:
        pairs = [x for n, c in named.items() for x in (F.lit(n.replace("_", "-")), c)]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    cookie = (
        F.when(every("page_id", 5), F.concat(F.lit("sessionid="), github_key("page_id")))
        .when(every("page_id", 5, 1), F.concat(F.lit("Auth="), github_key("page_id"), F.lit("; Path=/")))
        .when(every("page_id", 5, 2), F.lit("theme=dark"))
    )
    return p.select(
        "page_id",
        (F.lit(1704067200) + F.col("page_id")).cast("bigint").alias("ts"),
        pick(CLIENTS, F.col("page_id") % 3).alias("client"),
        F.when(every("page_id", 3), "POST").otherwise("GET").alias("method"),
        url.alias("url"),
        headers(
            Authorization=authorization,
            X_Api_Key=F.when(every("page_id", 23), aws_key("page_id")),
            User_Agent=F.lit("crawler/1.0"),
        ).alias("req_headers"),
        password.alias("req_body"),
        F.when(every("page_id", 10, 9), 404).otherwise(200).alias("status"),
        headers(
            Content_Type=pick(("text/html", "application/json", "image/png", "Text/HTML; charset=utf-8"), F.col("page_id") % 4),
            Server=F.when(every("page_id", 29), aws_key("page_id")).otherwise("nginx"),
            X_Debug=F.when(every("page_id", 13), github_key("page_id")),
        ).alias("resp_headers"),
        F.array_compact(F.array(cookie)).alias("set_cookies"),
        F.col("body").alias("resp_body"),
    )


def web_pages(spark, d) -> DataFrame:
    return exchanges(spark, d).select(
        "page_id", "url", "status", F.col("resp_headers").alias("headers"), "set_cookies", F.col("resp_body").alias("body")
    )


def assets(spark, d) -> DataFrame:
    """Scripts made of the documents; every sixth carries a planted key."""
    docs = documents(spark, d)
    planted = F.when(every("doc_id", 6), F.concat(F.lit(' var k="'), github_key("doc_id"), F.lit('"'))).otherwise("")
    return docs.select(
        F.concat(F.lit("https://cdn.example.com/asset/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("url"),
        F.when(every("doc_id", 16, 14), 404).otherwise(200).alias("status"),
        F.concat("text", planted).alias("content"),
    )


def source_maps(spark, d) -> DataFrame:
    """Source maps at the address that the pages name, with two sources each."""
    p = raw_pages(spark, d)
    sources = F.array("html", F.concat(F.lit("const k = '"), generic_key("page_id"), F.lit("'")))
    return p.select(
        F.concat(U.origin("url"), F.lit("/maps/"), F.col("page_id").cast("string"), F.lit(".js.map")).alias("url"),
        F.lit(200).alias("status"),
        F.to_json(F.struct(sources.alias("sourcesContent"))).alias("content"),
    )


def link_graph(spark, d) -> DataFrame:
    """``src, dst`` links that make the pages a binary tree by id, beside their own links."""
    p = table(spark, d, "pages").select("page_id", "url")
    parent = F.floor((F.col("page_id") - 1) / 2).cast("bigint")
    child = p.where(F.col("page_id") > 0).select(parent.alias("page_id"), F.col("url").alias("dst"))
    return p.join(child, "page_id").select(F.col("url").alias("src"), "dst")


def probes(spark, d) -> DataFrame:
    """Answers of every host to every probe path."""
    s = table(spark, d, "supplier").select("s_suppkey")
    paths = F.posexplode(S.text_array(PROBE_PATHS)).alias("n", "path")
    host = F.concat(F.lit("host"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
    rows = s.select("s_suppkey", host.alias("host"), paths)
    return rows.select(
        "host",
        F.concat(F.lit("https://"), "host", "path").alias("url"),
        F.when((F.col("s_suppkey") + F.col("n")) % 4 == 0, 404).otherwise(200).alias("status"),
        F.when(every("s_suppkey", 3), F.lit("welcome"))
        .when((F.col("s_suppkey") + F.col("n")) % 5 == 0, F.lit(" \n"))
        .otherwise(F.concat(F.lit("body of "), "path"))
        .alias("body"),
    )


# --- traffic ----------------------------------------------------------------


def traffic_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    e = e.withColumn("epoch", _epoch(e))
    array = lambda items: "array(" + ", ".join(S.text_literal(i) for i in items) + ")"
    finding = "event_type IN ('error', 'purchase')"
    type_ = f"element_at({array(FINDING_TYPES)}, int((event_id + user_id) % 18) + 1)"
    return e.selectExpr(
        "event_id",
        "epoch AS ts",
        "CASE WHEN event_type IN ('view', 'click') THEN 'mitm_outbound' WHEN event_type = 'signup' THEN 'mitm_bypass' ELSE 'security_finding' END AS stage",
        f"element_at({array(CLIENTS)}, int(user_id % 3) + 1) AS client",
        "if(event_id % 3 = 0, 'POST', 'GET') AS method",
        "concat('https://api', user_id % 7, '.example.com/v1/', event_type, '/', event_id % 50) AS url",
        f"""CASE WHEN {finding} THEN
            CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' WHEN value >= 5 THEN 'LOW' ELSE 'INFO' END
        END AS severity""",
        f"CASE WHEN {finding} THEN {type_} END AS type",
        f"CASE WHEN {finding} AND event_id % 5 <> 0 THEN element_at({array(LOG_PATTERNS)}, int(event_id % 4) + 1) END AS pattern",
        f"CASE WHEN {finding} THEN concat(replace({type_}, '_', ' '), ' seen for user ', user_id) END AS description",
        "CAST(NULL AS string) AS field",
        "CAST(NULL AS string) AS header",
    )


def _epoch(e: DataFrame) -> Column:
    """Whole seconds since 1970 of ``ts``, whatever its timestamp type and the session zone."""
    if dict(e.dtypes)["ts"] == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return F.unix_seconds("ts")


def log_findings(spark, d) -> DataFrame:
    """Security findings of the log, in the finding schema."""
    return FN.normalize(TR.split_log(traffic_log(spark, d).where(F.col("stage") == "security_finding")).drop("finding_id", "metadata"))


def messages(spark, d) -> DataFrame:
    """A request and a response per log row, with some hosts that are ignored."""
    log = traffic_log(spark, d)
    url = F.when(every("event_id", 6), F.concat(F.lit("https://ACCOUNTS.google.com/"), "stage")).when(
        every("event_id", 10), F.concat("url", F.lit("/login?next=/"))
    ).otherwise(F.col("url"))
    return log.select("event_id", url.alias("url"), F.explode(F.array(F.lit("request"), F.lit("response"))).alias("kind"))


def urls(spark, d) -> DataFrame:
    """A url per log row that covers every rule of the bypass list."""
    host = pick(
        (
            "localhost", "127.0.0.1", "api.openai.com", "eu.api.stripe.com", "notstripe.com", "x.execute-api.us-east-1.amazonaws.com",
            "bucket.s3.amazonaws.com", "d111.cloudfront.net", "app.example.com", "www.googleapis.com", "okta.com", "[::1]",
        ),
        F.col("event_id") % 12,
    )
    tail = pick(("/v1", "/oauth2/token", "/a?x=lesson", "/", "/login#f", "/SAML/acs"), F.floor(F.col("event_id") / 12) % 6)
    full = F.concat(F.lit("https://u:p@"), host, F.lit(":8443"), tail)
    return traffic_log(spark, d).select(
        "event_id", F.when(every("event_id", 25), F.concat(F.lit("/relative"), tail)).otherwise(full).alias("url")
    )


def request_bodies(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    value = (
        F.when(every("c_custkey", 5), F.concat(F.lit("plain-"), F.substring(h("c_custkey"), 1, 5)))
        .when(every("c_custkey", 5, 1), F.concat(F.lit("$2b$12$"), F.substring(h("c_custkey"), 1, 22)))
        .when(every("c_custkey", 5, 2), F.concat(h("c_custkey"), F.substring(h("c_custkey"), 1, 24)))
        .when(every("c_custkey", 5, 3), F.lit("abc"))
        .otherwise(F.concat(F.lit("long+"), F.substring(h("c_custkey"), 1, 39)))
    )
    extra = F.when(every("c_custkey", 7), F.concat(F.lit(',"k":"'), generic_key("c_custkey"), F.lit('","pwd":"second"'))).otherwise("")
    number = F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey",
        value.alias("value"),
        F.concat(F.lit("https://shop.example.com/login/"), number).alias("url"),
        F.concat(F.lit('{"user":"u'), number, F.lit('","Password":"'), value, F.lit('"'), extra, F.lit("}")).alias("req_body"),
    )


def browser_state(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    key = pick(STORAGE_KEYS, F.col("c_custkey") % 8)
    other = pick(STORAGE_KEYS, (F.col("c_custkey") + 3) % 8)
    value = pick(("null", '""', "false", '"on"', "0", "{}", "42"), F.col("c_custkey") % 7)
    flag = F.when(every("c_custkey", 4), True).when(every("c_custkey", 4, 1), False)
    return c.select(
        F.col("c_custkey").cast("string").alias("user"),
        F.create_map(key, F.col("c_name")).alias("localStorage"),
        F.create_map(other, h("c_custkey")).alias("sessionStorage"),
        F.array(
            F.struct(F.lit("sid").alias("name"), flag.alias("secure"), F.lit(True).alias("httpOnly")),
            F.struct(F.lit("pref").alias("name"), F.lit(True).alias("secure"), every("c_custkey", 3).alias("httpOnly")),
        ).alias("cookies"),
        F.create_map(F.lit("__CONFIG__"), value).alias("globals"),
        F.when(every("c_custkey", 50, 49), F.lit("timeout")).alias("error"),
    )


# --- retrieval --------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def label_centroids(spark, d) -> DataFrame:
    """Mean vector of each label."""
    flat = vectors(spark, d).select("label", F.posexplode("vector").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(ordered.alias("v")).select(F.col("label").cast("bigint").alias("query_id"), F.col("v.m").alias("vector"))


def answers(spark, d) -> DataFrame:
    """Conversation turns as model answers, with planted keys and citations."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = F.col("conv_id") + F.col("turn")
    text = F.concat(
        "text",
        F.when(n % 4 == 0, F.concat(F.lit(" use "), aws_key("conv_id"))).otherwise(""),
        F.when(n % 5 == 0, F.concat(F.lit(" or "), github_key("conv_id"))).otherwise(""),
        F.when(n % 3 == 0, F.concat(F.lit(" [Source: "), h("conv_id"), F.lit("] done"))).otherwise(""),
    )
    ids = F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), (n % 7).cast("int")), lambda i: F.concat(F.lit("f"), (n + i).cast("string")))
    )
    return c.select("conv_id", "turn", text.alias("text"), ids.alias("ids"))


def two_scans(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two overlapping time ranges of the log as two scans; together they cover all rows."""
    f = log_findings(spark, d)
    return f.where(F.col("ts") < SCAN_A_END), f.where(F.col("ts") >= SCAN_B_START)
