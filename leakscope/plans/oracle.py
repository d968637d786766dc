"""SQL for the correctness gate, run by another engine on the same tables.

The catalog and the knowledge base are inlined as values.  The logic is written
for itself, not derived from the Spark plans.
"""

from __future__ import annotations

from .. import values as V
from ..catalog import Pattern, default_catalog, prefix_terms
from ..knowledge import CWES, MITIGATIONS, OWASP
from ..operators.extras import glob_regex
from ..operators.retrieve import tokens
from . import queries as Q
from . import views as VW

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def array(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


def pick(items, index: str) -> str:
    return f"list_extract({array(items)}, CAST({index} AS INT) + 1)"


# --- shared pieces ----------------------------------------------------------

P = default_catalog()


def ghp(c):
    return f"'ghp_' || substr(sha1(CAST({c} AS VARCHAR)), 1, 36)"


def akia(c):
    return f"'AKIA' || upper(substr(sha1(CAST({c} AS VARCHAR)), 1, 16))"


def generic(c):
    return f"'api_key=' || substr(sha1(CAST({c} AS VARCHAR)), 1, 24)"


def hits(source: str, keys: str, text: str, name: str = "name", patterns: list[Pattern] = P) -> str:
    """All (row, pattern) matches: one constant regex per branch."""
    return " UNION ALL ".join(
        f"SELECT {keys}, {p.ord} AS ord, {q(getattr(p, name))} AS pattern, "
        f"length(regexp_extract({text}, {q(p.regex)}, 0)) AS n, "
        f"len(regexp_extract_all({text}, {q(p.regex)}, 0)) AS occurrences "
        f"FROM {source} WHERE regexp_matches({text}, {q(p.regex)})"
        for p in patterns
    )


def first_only(hit_sql: str, keys: str) -> str:
    return f"SELECT * FROM ({hit_sql}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ord) = 1"


def url_host(u):
    rest = f"regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')"
    return f"lower(CASE WHEN {rest} LIKE '[%' THEN regexp_extract({rest}, '^\\[([^\\]]*)\\]', 1) ELSE split_part({rest}, ':', 1) END)"


def url_clean(u):
    """Scheme, host and path without user, query and fragment."""
    return f"regexp_replace(regexp_replace({u}, '[?#].*$', ''), '://[^/@]*@', '://')"


CTE = {
    "docs": "SELECT doc_id, text, source FROM documents",
    "doc_lines": """SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents""",
    "diff_files": f"""
        SELECT doc_id, sha1(CAST(doc_id // 10 AS VARCHAR)) AS commit_id, 1700000000 + (doc_id // 10) * 3600 AS commit_ts,
            1 AS file_no, source || '/' || doc_id || '.txt' AS path,
            list_transform(string_split(text, chr(10)),
                lambda x, i: CASE WHEN (doc_id + i - 1) % 5 = 4 THEN '-' ELSE '+' END || x) AS body
        FROM documents
        UNION ALL
        SELECT doc_id, sha1(CAST(doc_id // 10 AS VARCHAR)), 1700000000 + (doc_id // 10) * 3600, 2, 'notes/' || doc_id || '.md',
            [CASE WHEN doc_id % 13 = 0 THEN '+key ' || {akia('doc_id')} WHEN doc_id % 7 = 0 THEN '-old ' || {ghp('doc_id')} ELSE '+nothing' END]
        FROM documents""",
    "diff_rows": """
        SELECT commit_id AS commit, commit_ts, path, file_no, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no
        FROM (SELECT *, list_concat(['--- a/' || path, '+++ b/' || path, '@@ -0,0 +1 @@'], body) AS lines FROM diff_files)""",
    "page": f"""
        SELECT page_id, url, html || '<script src="https://cdn.example.com/asset/0.js"></script><script src="https://cdn.example.com/asset/'
            || (page_id * 2) || '.js"></script><a href="../up/' || page_id || '">u</a><a href="?p=' || page_id
            || '">q</a><a href="#top">t</a><a href="sub/./x.html">x</a>'
            || CASE WHEN page_id % 8 = 0 THEN chr(10) || '//# sourceMappingURL=/maps/' || page_id || '.js.map' ELSE '' END
            || CASE WHEN page_id % 9 = 0 THEN '<!-- ' || {generic('page_id')} || ' -->' ELSE '' END AS body
        FROM pages""",
    "exchange": f"""
        SELECT page_id, 1704067200 + page_id AS ts, {pick(VW.CLIENTS, 'page_id % 3')} AS client,
            CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
            CASE WHEN page_id % 7 = 0 THEN split_part(u, '#', 1) || CASE WHEN split_part(u, '#', 1) LIKE '%?%' THEN '&' ELSE '?' END || {generic('page_id')} ELSE u END AS url,
            CASE WHEN page_id % 11 = 0 THEN 'Bearer ' || {ghp('page_id')} WHEN page_id % 19 = 0 THEN 'Basic dXNlcjpwdw==' END AS auth,
            CASE WHEN page_id % 23 = 0 THEN {akia('page_id')} END AS api_key,
            CASE page_id % 5 WHEN 0 THEN '{{"user":"u","password":"hunter-' || substr(sha1(CAST(page_id AS VARCHAR)), 1, 6) || '"}}'
                WHEN 1 THEN '{{"user":"u","password":"$2b$12$' || substr(sha1(CAST(page_id AS VARCHAR)), 1, 22) || '"}}'
                WHEN 2 THEN 'token="' || sha1(CAST(page_id AS VARCHAR)) || '"' END AS req_body,
            CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS status,
            {pick(('text/html', 'application/json', 'image/png', 'Text/HTML; charset=utf-8'), 'page_id % 4')} AS content_type,
            CASE WHEN page_id % 29 = 0 THEN {akia('page_id')} ELSE 'nginx' END AS server,
            CASE WHEN page_id % 13 = 0 THEN {ghp('page_id')} END AS debug,
            CASE page_id % 5 WHEN 0 THEN 'sessionid=' || {ghp('page_id')} WHEN 1 THEN 'Auth=' || {ghp('page_id')} || '; Path=/' WHEN 2 THEN 'theme=dark' END AS cookie,
            body
        FROM (SELECT page_id, body, CASE WHEN page_id % 17 = 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS u FROM page)""",
    "resp_header": """
        SELECT page_id, url, 'Content-Type' AS header, content_type AS value FROM exchange
        UNION ALL SELECT page_id, url, 'Server', server FROM exchange
        UNION ALL SELECT page_id, url, 'X-Debug', debug FROM exchange WHERE debug IS NOT NULL""",
    "key_header": """
        SELECT page_id, ts, url, 'Authorization' AS header, auth AS value FROM exchange WHERE auth IS NOT NULL
        UNION ALL SELECT page_id, ts, url, 'X-Api-Key', api_key FROM exchange WHERE api_key IS NOT NULL""",
    "link": f"""
        SELECT page_id, page_url, ref, CASE
            WHEN ref = '' THEN page_url
            WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref
            WHEN ref LIKE '/%' THEN origin || ref
            WHEN ref LIKE '?%' THEN regexp_replace(page_url, '[?#].*$', '') || ref
            WHEN ref LIKE '#%' THEN regexp_replace(page_url, '#.*$', '') || ref
            WHEN ref LIKE '../%' THEN origin || regexp_replace(folder, '[^/]+/$', '') || substr(ref, 4)
            ELSE origin || folder || replace(ref, './', '') END AS link
        FROM (SELECT page_id, url AS page_url, unnest(regexp_extract_all(body, {q(V.LINK_REGEX)}, 1)) AS ref,
                regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,
                CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                     ELSE regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) END AS folder
              FROM page)""",
    "asset": f"""
        SELECT 'https://cdn.example.com/asset/' || doc_id || '.js' AS url, CASE WHEN doc_id % 16 = 14 THEN 404 ELSE 200 END AS status,
            text || CASE WHEN doc_id % 6 = 0 THEN ' var k="' || {ghp('doc_id')} || '"' ELSE '' END AS content FROM documents""",
    "map_source": f"""
        SELECT page_id, 0 AS source_index, html AS source FROM pages WHERE page_id % 8 = 0
        UNION ALL SELECT page_id, 1, 'const k = ''' || {generic('page_id')} || '''' FROM pages WHERE page_id % 8 = 0""",
    "probe": f"""
        SELECT 'host' || s_suppkey || '.example.com' AS host, 'https://host' || s_suppkey || '.example.com' || path AS url,
            CASE WHEN (s_suppkey + n) % 4 = 0 THEN 404 ELSE 200 END AS status,
            CASE WHEN s_suppkey % 3 = 0 THEN 'welcome' WHEN (s_suppkey + n) % 5 = 0 THEN ' ' || chr(10) ELSE 'body of ' || path END AS body
        FROM supplier, ({values([(i, p) for i, p in enumerate(V.PROBE_PATHS)], 'n, path')})""",
    "exposed": """
        SELECT host, url, status, length(body) AS n,
            count(*) OVER (PARTITION BY host) >= 3
                AND min(body) OVER (PARTITION BY host) = max(body) OVER (PARTITION BY host) AS same
        FROM probe WHERE status = 200 AND regexp_matches(body, '\\S')""",
    "log": f"""
        SELECT event_id, epoch_us(ts) // 1000000 AS ts,
            CASE WHEN event_type IN ('view', 'click') THEN 'mitm_outbound' WHEN event_type = 'signup' THEN 'mitm_bypass' ELSE 'security_finding' END AS stage,
            {pick(VW.CLIENTS, 'user_id % 3')} AS client, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
            'https://api' || (user_id % 7) || '.example.com/v1/' || event_type || '/' || (event_id % 50) AS url,
            CASE WHEN sec THEN CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' WHEN value >= 5 THEN 'LOW' ELSE 'INFO' END END AS severity,
            CASE WHEN sec THEN ft END AS type,
            CASE WHEN sec AND event_id % 5 <> 0 THEN {pick(VW.LOG_PATTERNS, 'event_id % 4')} END AS pattern,
            CASE WHEN sec THEN replace(ft, '_', ' ') || ' seen for user ' || user_id END AS description
        FROM (SELECT *, event_type IN ('error', 'purchase') AS sec, {pick(VW.FINDING_TYPES, '(event_id + user_id) % 18')} AS ft FROM events)""",
    "finding": """
        SELECT event_id, sha1(type || '|' || description || '|') AS finding_id, type, severity, client AS source,
            description AS summary, pattern, url, method, ts FROM log WHERE stage = 'security_finding'""",
    "latest": """
        SELECT *, count(*) OVER (PARTITION BY finding_id) AS occurrence_count FROM finding
        QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ts DESC, url DESC, method DESC, severity DESC, pattern DESC NULLS LAST) = 1""",
    "endpoint": """
        SELECT sha1(method || '|' || url) AS endpoint_id, url, method, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n
        FROM finding GROUP BY url, method""",
    "message": f"""
        SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'https://ACCOUNTS.google.com/' || stage
            WHEN event_id % 10 = 0 THEN url || '/login?next=/' ELSE url END AS url, unnest(['request', 'response']) AS kind FROM log""",
    "ignored_message": f"""
        SELECT event_id, kind, regexp_matches({url_host('url')}, {q(V.IGNORE_HOST_REGEX)})
            OR {' OR '.join(f"contains(lower(url), {q(t)})" for t in V.IGNORE_URL_TOKENS)} AS ignored FROM message""",
    "odd_url": f"""
        SELECT event_id, CASE WHEN event_id % 25 = 0 THEN '/relative' || tail ELSE 'https://u:p@' || host || ':8443' || tail END AS url
        FROM (SELECT event_id, {pick(('localhost', '127.0.0.1', 'api.openai.com', 'eu.api.stripe.com', 'notstripe.com', 'x.execute-api.us-east-1.amazonaws.com', 'bucket.s3.amazonaws.com', 'd111.cloudfront.net', 'app.example.com', 'www.googleapis.com', 'okta.com', '[::1]'), 'event_id % 12')} AS host,
              {pick(('/v1', '/oauth2/token', '/a?x=lesson', '/', '/login#f', '/SAML/acs'), '(event_id // 12) % 6')} AS tail FROM events)""",
    "request_body": f"""
        SELECT c_custkey, value, 'https://shop.example.com/login/' || c_custkey AS url,
            '{{"user":"u' || c_custkey || '","Password":"' || value || '"'
                || CASE WHEN c_custkey % 7 = 0 THEN ',"k":"' || {generic('c_custkey')} || '","pwd":"second"' ELSE '' END || '}}' AS req_body
        FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'plain-' || substr(hx, 1, 5) WHEN 1 THEN '$2b$12$' || substr(hx, 1, 22)
                WHEN 2 THEN hx || substr(hx, 1, 24) WHEN 3 THEN 'abc' ELSE 'long+' || substr(hx, 1, 39) END AS value
              FROM (SELECT c_custkey, sha1(CAST(c_custkey AS VARCHAR)) AS hx FROM customer))""",
    "browser": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS client, c_custkey, c_name, sha1(CAST(c_custkey AS VARCHAR)) AS hx,
            {pick(VW.STORAGE_KEYS, 'c_custkey % 8')} AS local_key, {pick(VW.STORAGE_KEYS, '(c_custkey + 3) % 8')} AS session_key,
            CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
            {pick(('null', '""', 'false', '"on"', '0', '{}', '42'), 'c_custkey % 7')} AS config
        FROM customer WHERE c_custkey % 50 <> 49""",
    "type_cwe": values([(t, i, c[0]) for i, c in enumerate(CWES) for t in c[4]], "t, ord, cwe_id"),
    "cwe_name": values([(c[0], c[1]) for c in CWES], "cwe_id, name"),
    "vector": values([(c[0], v) for c in CWES for v in c[5]], "cwe_id, attack_type"),
    "cwe_owasp": values([(c, o[0], o[1], o[3]) for o in OWASP for c in o[5]], "cwe_id, owasp_id, name, rank"),
    "owasp_name": values([(o[0], o[1]) for o in OWASP], "owasp_id, name"),
    "owasp_mit": values([(o[0], m) for o in OWASP for m in o[6]], "owasp_id, mitigation_id"),
    "mit_name": values([(m[0], m[1]) for m in MITIGATIONS], "mitigation_id, name"),
    "example": values([(m[0], e) for m in MITIGATIONS for e in m[3]], "mitigation_id, filename"),
    "enriched": """
        SELECT f.*, (SELECT min_by(t.cwe_id, t.ord) FROM type_cwe t WHERE t.t = f.type OR t.t = f.pattern) AS cwe_id FROM finding f""",
    "cwe_mit": "SELECT DISTINCT cwe_id, mitigation_id FROM cwe_owasp JOIN owasp_mit USING (owasp_id)",
    "edge": """
        SELECT DISTINCT 'finding:' || finding_id AS src, 'endpoint:' || sha1(method || '|' || url) AS dst, 'found_at' AS label FROM finding
        UNION ALL SELECT DISTINCT 'finding:' || finding_id, 'cwe:' || cwe_id, 'is_instance_of' FROM enriched WHERE cwe_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'finding:' || finding_id, 'attack_vector:' || substr(sha1(attack_type), 1, 12), 'exploitable_via' FROM enriched JOIN vector USING (cwe_id)
        UNION ALL SELECT DISTINCT 'cwe:' || cwe_id, 'owasp:' || owasp_id, 'belongs_to' FROM enriched JOIN cwe_owasp USING (cwe_id)
        UNION ALL SELECT DISTINCT 'cwe:' || cwe_id, 'mitigation:' || mitigation_id, 'fixed_by' FROM enriched JOIN cwe_mit USING (cwe_id)
        UNION ALL SELECT DISTINCT 'mitigation:' || mitigation_id, 'code_example:' || substr(sha1(filename), 1, 12), 'demonstrates' FROM example
        UNION ALL SELECT DISTINCT 'attack_vector:' || substr(sha1(attack_type), 1, 12), 'endpoint:' || sha1(method || '|' || url), 'targets' FROM enriched JOIN vector USING (cwe_id)""",
    "node": """
        SELECT DISTINCT 'finding:' || finding_id AS id, 'Finding' AS label, summary AS name FROM finding
        UNION ALL SELECT 'endpoint:' || endpoint_id, 'Endpoint', url FROM endpoint
        UNION ALL SELECT 'cwe:' || cwe_id, 'CWE', name FROM cwe_name WHERE cwe_id IN (SELECT cwe_id FROM enriched)
        UNION ALL SELECT DISTINCT 'attack_vector:' || substr(sha1(attack_type), 1, 12), 'AttackVector',
            list_aggregate(list_transform(string_split(attack_type, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')
            FROM vector WHERE cwe_id IN (SELECT cwe_id FROM enriched)
        UNION ALL SELECT 'owasp:' || owasp_id, 'OWASP', name FROM owasp_name
        UNION ALL SELECT 'mitigation:' || mitigation_id, 'Mitigation', name FROM mit_name
        UNION ALL SELECT 'code_example:' || substr(sha1(filename), 1, 12), 'CodeExample', filename FROM example""",
    "answer": f"""
        SELECT conv_id, turn, text || CASE WHEN n % 4 = 0 THEN ' use ' || {akia('conv_id')} ELSE '' END
            || CASE WHEN n % 5 = 0 THEN ' or ' || {ghp('conv_id')} ELSE '' END
            || CASE WHEN n % 3 = 0 THEN ' [Source: ' || sha1(CAST(conv_id AS VARCHAR)) || '] done' ELSE '' END AS text,
            CASE WHEN n % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(0, CAST(n % 7 AS INT) + 1), lambda i: 'f' || (n + i)) END AS ids, n
        FROM (SELECT conv_id, turn, text, conv_id + turn AS n FROM conversations)""",
    "centroid": """
        SELECT label, list(m ORDER BY i) AS q FROM (
            SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
            GROUP BY label, i) GROUP BY label""",
    "mean_vector": """
        SELECT list(m ORDER BY i) AS q FROM (
            SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)""",
}


def redacted(text: str) -> str:
    for r in V.REDACTION_REGEXES:
        text = f"regexp_replace({text}, {q(r)}, '[REDACTED]', 'g')"
    return text


def cited(text: str) -> str:
    return f"""CASE WHEN contains({text}, '[Source:') THEN {text}
        WHEN len(ids) = 0 THEN {text} || chr(10) || chr(10) || '[NOTE] No retrieved contexts available to cite.'
        ELSE {text} || chr(10) || chr(10) || 'Citations: ' || array_to_string(list_transform(ids[1:5], lambda x: '[Source: ' || x || ']'), ', ') END"""


def keyword_score(question: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(summary || ' '), {q(t)}) THEN 1 ELSE 0 END" for t in tokens(question))


RANK = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END"


def batch_scores() -> str:
    each = " UNION ALL ".join(f"SELECT {q(i)} AS query_id, {keyword_score(t)} AS score, * FROM latest" for i, t in Q.QUESTIONS)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {RANK} DESC, ts, finding_id) AS rank
        FROM ({each}) WHERE score > 0) WHERE rank <= 5"""


CTE["batch"] = batch_scores()
CTE["asked"] = values(Q.QUESTIONS, "query_id, question")

# Which shared pieces a query text uses, found by name and closed over their own needs.


def with_ctes(body: str) -> str:
    import re

    def used(text: str) -> list[str]:
        return [n for n in CTE if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b|,\s*{n}\b\s*(?:[a-z]?\b)(?=\s|,|\)|$)", text)]

    order: list[str] = []

    def visit(text: str) -> None:
        for n in used(text):
            if n not in order:
                visit(CTE[n])
                if n not in order:
                    order.append(n)

    visit(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " + body


def add(name: str, body: str) -> None:
    ORACLE[name] = with_ctes(body)


# --- sources ----------------------------------------------------------------

add("read_report", "SELECT source, severity, count(*) AS n, min(finding_id) AS first_id, max(url) AS last_url FROM finding GROUP BY source, severity")
add("audit_summary", """SELECT 'events' AS target, 'stats' AS kind, source AS name, count(*) AS n FROM finding GROUP BY source
    UNION ALL SELECT 'events', 'severities', severity, coalesce(n, 0) FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) v(severity)
        LEFT JOIN (SELECT severity, count(*) AS n FROM finding GROUP BY severity) USING (severity)""")
add("text_files", "SELECT pattern, count(*) AS line_hits FROM ("
    + hits("(SELECT l.* FROM doc_lines l JOIN documents d USING (doc_id) WHERE lang <> 'de')", "doc_id", "line") + ") GROUP BY pattern")
add("pattern_catalog", f"""SELECT raw_name, name, regex, coalesce(docs, 0) AS docs
    FROM ({values([(p.raw_name, p.name, p.regex) for p in P], 'raw_name, name, regex')})
    LEFT JOIN (SELECT pattern AS raw_name, count(*) AS docs FROM ({hits('docs', 'doc_id', 'text', 'raw_name')}) GROUP BY pattern) USING (raw_name)""")
add("diff_lines", """SELECT commit, path, substr(line, 1, 1) AS sign, count(*) AS n, sum(line_no) AS line_nos, max(file_no) AS file_no, sum(length(line)) AS chars
    FROM diff_rows GROUP BY commit, path, substr(line, 1, 1)""")

add("diff_log", """SELECT commit, commit_ts, path, substr(line, 1, 1) AS sign, count(*) AS n, sum(line_no) AS line_nos, max(file_no) AS file_no, sum(length(line)) AS chars
    FROM diff_rows GROUP BY commit, commit_ts, path, substr(line, 1, 1)""")

# --- detection --------------------------------------------------------------

add("pattern_scan_docs", f"SELECT doc_id, pattern, '[REDACTED]' AS snippet, least(n, 400) AS original_length FROM ({hits('docs', 'doc_id', 'text')})")
add("pattern_scan_lines", f"SELECT doc_id, line_no, pattern, least(n, 200) AS original_length FROM ({hits('doc_lines', 'doc_id, line_no', 'line')})")
add("first_pattern", f"SELECT url, pattern FROM ({first_only(hits('asset', 'url', 'content'), 'url')})")
add("pattern_occurrences", f"SELECT url, pattern, occurrences, n AS original_length FROM ({hits('asset', 'url', 'content')})")
add("redact_text", f"""SELECT conv_id, turn, sha1(t) AS redacted_sha, (length(t) - length(replace(t, '[REDACTED]', ''))) // 10 AS marks
    FROM (SELECT conv_id, turn, {redacted('text')} AS t FROM answer)""")
add("size_limits", f"SELECT url, inside, pattern FROM ({hits('(SELECT *, strlen(content) <= 8000 AND length(content) <= 6000 AS inside FROM asset)', 'url, inside', 'content')})")

# --- web --------------------------------------------------------------------

add("web_response_pattern", f"""SELECT url, 'response_pattern' AS type, 'HIGH' AS severity, pattern, least(n, 400) AS original_length,
    sha1('response_pattern|response_pattern|[REDACTED]') AS finding_id FROM ({hits('exchange', 'url', 'body')})""")
add("web_response_unescaped", f"""SELECT url, pattern, least(n, 400) AS original_length FROM ({hits(
    "(SELECT url, replace(replace(replace(replace(replace(body, '&quot;', chr(34)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS body FROM exchange)", 'url', 'body')})""")
add("web_header_pattern", f"""SELECT url, header, pattern, len AS original_length, 'HIGH' AS severity
    FROM ({hits("(SELECT *, length(value) AS len FROM resp_header WHERE lower(header) NOT IN ('etag', 'server', 'date', 'content-length'))", 'url, header, len', 'value')})""")
add("web_cookie_pattern", f"""SELECT url, key, pattern, least(len, 400) AS original_length, 'HIGH' AS severity
    FROM ({hits(f"(SELECT url, cookie, length(cookie) AS len, lower(trim(split_part(cookie, '=', 1))) AS key FROM exchange WHERE cookie IS NOT NULL AND lower(trim(split_part(cookie, '=', 1))) NOT IN ({', '.join(q(c) for c in V.SKIPPED_COOKIES)}))", 'url, key, len', 'cookie')})""")
add("extract_links", "SELECT page_url, ref, link, count(*) AS n FROM link GROUP BY page_url, ref, link")
add("asset_links", """SELECT page_url, count_if(link LIKE '%.js' OR link LIKE '%.map') AS assets, count_if(link NOT LIKE '%.js' AND link NOT LIKE '%.map') AS pages
    FROM link GROUP BY page_url""")
add("asset_pattern", f"""SELECT url, 'js_pattern' AS type, pattern, least(n, 400) AS original_length, count(*) AS n
    FROM ({hits('(SELECT * FROM asset WHERE status = 200)', 'url', 'content')}) a JOIN link l ON l.link = a.url GROUP BY url, pattern, least(n, 400)""")
add("asset_pattern_counted", f"""SELECT url, pattern, count(*) AS links
    FROM ({hits('(SELECT * FROM asset WHERE status = 200)', 'url', 'content')}) a JOIN link l ON l.link = a.url GROUP BY url, pattern""")
add("sourcemap_refs", """SELECT url AS page_url, '/maps/' || page_id || '.js.map' AS ref, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/maps/' || page_id || '.js.map' AS link
    FROM pages WHERE page_id % 8 = 0""")
add("sourcemap_pattern", f"""SELECT regexp_extract(p.url, '^[a-z]+://[^/?#]*', 0) || '/maps/' || s.page_id || '.js.map' AS url, 'sourcemap_pattern' AS type, pattern,
    least(n, 400) AS original_length, source_index FROM ({hits('map_source', 'page_id, source_index', 'source')}) s JOIN pages p USING (page_id)""")
add("same_host_links", f"""SELECT page_url, count(*) AS n FROM link
    WHERE {url_host('link')} = {url_host('page_url')} OR {url_host('link')} IN ('localhost', '127.0.0.1') GROUP BY page_url""")
CTE["host_page"] = f"SELECT page_id, url, {url_host('url')} AS host, row_number() OVER (PARTITION BY {url_host('url')} ORDER BY page_id) AS n FROM page"
CTE["host_link"] = f"""SELECT DISTINCT src, dst FROM (SELECT page_url AS src, link AS dst FROM link
        UNION ALL SELECT p.url, c.url FROM host_page p JOIN host_page c ON p.host = c.host AND c.n // 2 = p.n AND c.n > 1)
    WHERE {url_host('dst')} = (SELECT {url_host('min_by(url, page_id)')} FROM page)"""
ORACLE["crawl_links"] = with_ctes("SELECT 1 FROM host_link").replace(" SELECT 1 FROM host_link", """, walk AS (
        SELECT min_by(url, page_id) AS url, 0 AS depth FROM pages UNION SELECT dst, depth + 1 FROM walk JOIN host_link ON src = url WHERE depth < 40)
    SELECT url, min(depth) AS depth FROM walk GROUP BY url ORDER BY depth, url LIMIT 40""")
ORACLE["crawl_reach"] = """WITH RECURSIVE reach(page_id, depth) AS (
        SELECT min(page_id), 0 FROM pages
        UNION ALL SELECT p.page_id, r.depth + 1 FROM reach r JOIN pages p ON p.page_id > 0 AND (p.page_id - 1) // 2 = r.page_id)
    SELECT url, min(depth) AS depth FROM reach JOIN pages USING (page_id) GROUP BY url"""
add("probe_exposed_path", "SELECT url, status, 'MEDIUM' AS severity, least(n, 800) AS original_length FROM exposed WHERE NOT same")
add("probe_catchall", "SELECT host, CASE WHEN same THEN 'false_positive_catchall' ELSE 'exposed_path' END AS type, count(*) AS n FROM exposed GROUP BY host, same")
add("web_status_issues", "SELECT url, 'status' AS type, status FROM exchange WHERE status >= 400")
add("web_wrap", f"""SELECT url, 'crawler_issue' AS type, inner_type AS summary, severity, inner_type, inner_pattern FROM (
    SELECT url, 'status' AS inner_type, 'MEDIUM' AS severity, NULL AS inner_pattern FROM exchange WHERE status >= 400
    UNION ALL SELECT url, 'response_pattern', 'HIGH', pattern FROM ({hits('exchange', 'url', 'body')})
    UNION ALL SELECT url, 'header_pattern', 'HIGH', pattern FROM ({hits("(SELECT * FROM resp_header WHERE header <> 'Server')", 'url', 'value')})
    UNION ALL SELECT url, 'cookie_pattern', 'HIGH', pattern FROM ({hits("(SELECT * FROM exchange WHERE cookie IS NOT NULL AND cookie NOT LIKE 'sessionid=%')", 'url', 'cookie')}))""")

# --- traffic ----------------------------------------------------------------

HOST = url_host("url")
add("traffic_bypass", f"""SELECT event_id, h <> '' AND (h IN ('localhost', '127.0.0.1', '::1') OR h IN ({', '.join(q(x) for x in V.BYPASS_DOMAINS)})
        OR {' OR '.join(f"ends_with(h, {q('.' + x)})" for x in V.BYPASS_DOMAINS)}
        OR {' OR '.join(f"contains(h, {q(x)})" for x in V.BYPASS_HOST_PARTS)}
        OR {' OR '.join(f"contains(lower(url), {q(x)})" for x in V.BYPASS_URL_TOKENS)}) AS bypass
    FROM (SELECT event_id, url, {HOST} AS h FROM odd_url)""")
add("traffic_ignore", "SELECT event_id, kind, ignored FROM ignored_message")
add("url_redact", f"""SELECT event_id, CASE WHEN url LIKE '/%' THEN ':///' || substr(regexp_replace(url, '[?#].*$', ''), 2) ELSE {url_clean('url')} END AS redacted,
    {HOST} AS host FROM odd_url""")
add("url_credentials", f"""SELECT {url_clean('url')} AS url, 'url_embedded_credentials' AS type, 'CRITICAL' AS severity, client, method, ts
    FROM exchange WHERE url LIKE '%://user:pw@%'""")
add("url_query_key", f"""SELECT {url_clean('url')} AS url, 'api_key_in_url' AS type, 'CRITICAL' AS severity, pattern,
    'API key ' || pattern || ' exposed in URL query string (logged in browser history, proxy logs, server logs)' AS description
    FROM ({first_only(hits("(SELECT page_id, url, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM exchange)", 'page_id, url', 'query', 'raw_name'), 'page_id')})""")
add("basic_auth", f"SELECT {url_clean('url')} AS url, 'basic_auth_header' AS type, 'CRITICAL' AS severity, ts FROM exchange WHERE contains(auth, 'Basic')")
KEY_HEADER = f"""SELECT *, CASE WHEN url LIKE 'https://%' THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
    CASE WHEN url LIKE 'https://%' AND header = 'Authorization' THEN pattern || ' in Authorization header over HTTPS (expected for server-side API calls, review if unexpected)'
        WHEN url NOT LIKE 'https://%' THEN 'API key ' || pattern || ' transmitted over insecure HTTP (unencrypted)'
        ELSE 'Potential ' || pattern || ' in header ' || header END AS description
    FROM ({first_only(hits('key_header', 'page_id, ts, url, header', 'value', 'raw_name'), 'page_id, header')})"""
add("header_key_severity", f"SELECT {url_clean('url')} AS url, header, pattern, severity, description FROM ({KEY_HEADER})")


def hashed(v):
    return f"""(length({v}) >= 8 AND (regexp_matches({v}, '^\\$2[aby]\\$') OR starts_with({v}, '$argon2')
        OR (length({v}) IN (64, 128) AND regexp_matches({v}, '^[0-9a-fA-F]+$'))
        OR (length({v}) > 40 AND regexp_matches({v}, '^[A-Za-z0-9+/=]+$'))))"""


def passwords(source, keys):
    r = q(V.PASSWORD_FIELD_REGEX)
    return f"""SELECT {keys}, field FROM (SELECT {keys}, unnest(regexp_extract_all(req_body, {r}, 1)) AS field,
        unnest(regexp_extract_all(req_body, {r}, 2)) AS v FROM {source}) WHERE length(v) > 3 AND NOT {hashed('v')}"""


add("plaintext_password", f"""SELECT url, field, 'CRITICAL' AS severity, 'Plaintext password in field ''' || field || ''' (not hashed)' AS description
    FROM ({passwords('request_body', 'url')})""")
add("hash_like", f"SELECT c_custkey, {hashed('value')} AS hashed FROM request_body")
add("body_secret", f"SELECT url, pattern, 'HIGH' AS severity, 'Potential ' || pattern || ' in request body' AS description FROM ({hits('request_body', 'url', 'req_body', 'raw_name')})")
add("resp_header_secret", f"""SELECT {url_clean('url')} AS url, header, pattern, 'CRITICAL' AS severity
    FROM ({first_only(hits('resp_header', 'page_id, url, header', 'value', 'raw_name'), 'page_id, header')})""")
TEXT_PAGES = "(SELECT * FROM exchange WHERE lower(content_type) LIKE '%text/%' OR lower(content_type) LIKE '%application/json%')"
add("resp_body_secret", f"""SELECT {url_clean('url')} AS url, pattern, 'CRITICAL' AS severity, least(n, 200) AS original_length
    FROM ({hits(TEXT_PAGES, 'page_id, url', 'body', 'raw_name')})""")
TRAFFIC = f"""
    SELECT ts, 'url_embedded_credentials' AS type, 'CRITICAL' AS severity, NULL AS pattern, NULL AS header, NULL AS field, NULL AS original_length,
        'Credentials embedded in URL (user:pass@domain)' AS description FROM exchange WHERE url LIKE '%://user:pw@%'
    UNION ALL SELECT ts, 'api_key_in_url', 'CRITICAL', pattern, NULL, NULL, NULL,
        'API key ' || pattern || ' exposed in URL query string (logged in browser history, proxy logs, server logs)'
        FROM ({first_only(hits("(SELECT page_id, ts, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM exchange)", 'page_id, ts', 'query', 'raw_name'), 'page_id')})
    UNION ALL SELECT ts, 'basic_auth_header', 'CRITICAL', NULL, NULL, NULL, NULL, 'Basic Authentication (base64 credentials) in header' FROM exchange WHERE contains(auth, 'Basic')
    UNION ALL SELECT ts, 'api_key_in_header', severity, pattern, header, NULL, NULL, description FROM ({KEY_HEADER})
    UNION ALL SELECT ts, 'plaintext_password', 'CRITICAL', NULL, NULL, field, NULL, 'Plaintext password in field ''' || field || ''' (not hashed)'
        FROM ({passwords('exchange', 'ts')})
    UNION ALL SELECT ts, 'secret_in_body', 'HIGH', pattern, NULL, NULL, NULL, 'Potential ' || pattern || ' in request body' FROM ({hits('exchange', 'ts', 'req_body', 'raw_name')})
    UNION ALL SELECT 1704067200 + page_id, 'secret_in_response_header', 'CRITICAL', pattern, header, NULL, NULL, 'Secret ' || pattern || ' leaked in response header ' || header
        FROM ({first_only(hits('resp_header', 'page_id, url, header', 'value', 'raw_name'), 'page_id, header')})
    UNION ALL SELECT ts, 'secret_in_response_body', 'CRITICAL', pattern, NULL, NULL, least(n, 200), 'Secret ' || pattern || ' leaked in response body'
        FROM ({hits(TEXT_PAGES, 'ts', 'body', 'raw_name')})"""
add("scan_traffic", TRAFFIC)
add("stream_findings", TRAFFIC)
add("alerts", f"""SELECT type, severity, pattern, count(*) AS n FROM ({TRAFFIC})
    WHERE NOT (type = 'api_key_in_header' AND pattern IN ({', '.join(q(p) for p in V.EXPECTED_SERVER_AUTH)}) AND contains(description, 'expected for server-side'))
    GROUP BY type, severity, pattern""")
SPLIT = """SELECT event_id, sha1(type || '|' || summary || '|') AS finding_id, * EXCLUDE (event_id) FROM (
    SELECT event_id, 'mitm_proxied_request' AS type, 'INFO' AS severity, client AS source, d AS summary, d AS description, NULL AS pattern, url, method, ts
        FROM (SELECT *, 'Proxied request via MITM: ' || method || ' ' || url || ' (client=' || client || ')' AS d FROM log WHERE stage = 'mitm_outbound')
    UNION ALL SELECT event_id, type, severity, client, description, description, pattern, url, method, ts FROM log WHERE stage = 'security_finding')"""
add("traffic_split", f"SELECT * EXCLUDE (event_id) FROM ({SPLIT})")
add("traffic_stamp", """SELECT 'security_finding' AS stage, substr(t, 1, 13) AS hour, count(*) AS n, min(t) AS first, max(t) AS last
    FROM (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM finding) GROUP BY substr(t, 1, 13)""")
add("traffic_counts", """SELECT count_if(stage = 'mitm_outbound') AS proxied, count_if(stage = 'mitm_bypass') AS bypassed,
    count_if(stage = 'security_finding') AS security_findings FROM log""")
add("traffic_counters", """SELECT count_if(kind = 'request' AND NOT ignored) AS requests, count_if(kind = 'response' AND NOT ignored) AS responses,
    count_if(kind = 'request' AND ignored) AS ignored FROM ignored_message""")
add("traffic_tail", "SELECT event_id, ts, stage, url FROM log ORDER BY ts DESC, event_id DESC LIMIT 200")
add("traffic_tail_per_client", """SELECT client, event_id, ts, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts DESC, event_id DESC) AS rank FROM log) WHERE rank <= 200""")

# --- browser ----------------------------------------------------------------

SUSPICIOUS = " OR ".join(f"contains(lower(key), {q(t)})" for t in V.STORAGE_KEY_PARTS)
add("browser_storage", f"""SELECT client, location, key, n AS original_length, 'MEDIUM' AS severity FROM (
    SELECT client, 'localStorage' AS location, local_key AS key, length(c_name) AS n FROM browser
    UNION ALL SELECT client, 'sessionStorage', session_key, length(hx) FROM browser) WHERE {SUSPICIOUS}""")
add("cookie_insecure", """SELECT client, 'sid' AS key, 'LOW' AS severity, CAST(flag AS VARCHAR) AS secure, 'true' AS http_only FROM browser WHERE flag IS NOT TRUE
    UNION ALL SELECT client, 'pref', 'LOW', 'true', 'false' FROM browser WHERE c_custkey % 3 <> 0""")
add("browser_global", """SELECT client, '__CONFIG__' AS key, CASE WHEN config LIKE '"%' THEN length(config) - 2 ELSE length(config) END AS original_length, 'MEDIUM' AS severity
    FROM browser WHERE config NOT IN ('null', '""', 'false', '0')""")

# --- version history --------------------------------------------------------

ADDED = "starts_with(line, '+') AND NOT starts_with(line, '+++')"
REMOVED = "starts_with(line, '-') AND NOT starts_with(line, '---')"
TERMS = prefix_terms(P)
CTE["term"] = values([(t, n, i) for t, n, i in TERMS], "term, name, term_ord")
CTE["changed"] = f"SELECT *, CASE WHEN starts_with(line, '+') THEN 1 ELSE -1 END AS s FROM diff_rows WHERE ({ADDED}) OR ({REMOVED})"
CTE["term_commit"] = """SELECT commit, commit_ts, term, term_ord, count(*) AS files FROM (
    SELECT commit, commit_ts, path, term, term_ord, sum(s * ((length(line) - length(replace(line, term, ''))) // length(term))) AS change
    FROM changed, term WHERE contains(line, term) GROUP BY ALL HAVING change <> 0) GROUP BY ALL"""


def newest(n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY commit_ts DESC, commit) AS rank FROM term_commit)
        WHERE rank <= {max(1, n // len(TERMS))}"""


def budget(n: int) -> str:
    return f"SELECT DISTINCT commit FROM (SELECT * FROM ({newest(n)}) ORDER BY term_ord, rank LIMIT {n})"


add("diff_added", f"SELECT commit, path, count(*) AS n, sum(length(line)) AS chars FROM diff_rows WHERE {ADDED} GROUP BY commit, path")
add("prefix_hits", "SELECT t.term, name, coalesce(lines, 0) AS lines FROM term t LEFT JOIN (SELECT term, count(*) AS lines FROM changed, term WHERE contains(line, term) GROUP BY term) USING (term)")
add("pickaxe", "SELECT commit, commit_ts, term, files FROM term_commit")
add("pickaxe_topn", f"SELECT commit, term, rank FROM ({newest(100)})")
add("pickaxe_budget", budget(20))
GIT = hits(f"(SELECT * FROM diff_rows WHERE {ADDED})", "commit, path, file_no, line_no", "line")
add("git_pattern", f"""SELECT sha1('git_pattern|' || pattern || ' in git history|[REDACTED]') AS finding_id, substr(commit, 1, 12) AS commit, path, pattern,
    least(n, 200) AS original_length, 'HIGH' AS severity, pattern || ' found in git history at ' || path || ' (commit ' || substr(commit, 1, 12) || ')' AS description FROM ({GIT})""")
GIT_FIRST = f"""SELECT * FROM ({GIT}) QUALIFY row_number() OVER (PARTITION BY commit, path, pattern ORDER BY file_no, line_no) = 1"""
add("git_dedupe", f"SELECT substr(commit, 1, 12) AS commit, path, pattern, least(n, 200) AS original_length FROM ({GIT_FIRST})")
add("git_pattern_pruned", f"""SELECT substr(commit, 1, 12) AS commit, path, pattern, least(n, 200) AS original_length FROM ({GIT_FIRST})
    WHERE commit IN (SELECT commit FROM ({budget(100)}))""")

add("git_dedupe_commit", f"""SELECT substr(h.commit, 1, 12) AS commit, p.path, pattern
    FROM (SELECT * FROM ({GIT}) QUALIFY row_number() OVER (PARTITION BY commit ORDER BY ord, file_no, line_no, path) = 1) h
    JOIN (SELECT commit, path FROM diff_rows QUALIFY row_number() OVER (PARTITION BY commit ORDER BY file_no, path) = 1) p ON p.commit = h.commit""")

# --- findings ---------------------------------------------------------------

add("finding_ids", "SELECT finding_id, type, summary, count(*) AS n FROM finding GROUP BY ALL")
add("findings_normalized", """SELECT sha1(coalesce(type, '') || '|' || coalesce(s, '') || '|') AS finding_id, type, coalesce(severity, 'INFO') AS severity, client AS source, s AS summary, ts,
    2 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n_metadata
    FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN stage ELSE coalesce(description, type) END AS s FROM log)""")
add("findings_latest", "SELECT finding_id, ts, url, severity, pattern, occurrence_count FROM latest")
add("severity_summary", """SELECT severity, coalesce(n, 0) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) v(severity)
    FULL JOIN (SELECT severity, count(*) AS n FROM finding GROUP BY severity) USING (severity)""")
add("severity_rollup", "SELECT source, severity, count(*) AS n FROM finding GROUP BY ROLLUP (source, severity)")
add("source_stats", f"""SELECT source, count(*) AS n, {', '.join(f"count_if(severity = '{s}') AS {s.lower()}" for s in V.SEVERITY_RANK)} FROM finding GROUP BY source""")
add("gate_code", "SELECT max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 ELSE 0 END) AS exit_code FROM finding")
add("query_by_severity", "SELECT finding_id, severity, ts FROM latest WHERE severity = 'HIGH' ORDER BY ts DESC, finding_id LIMIT 100")
CTE["latest_cwe"] = "SELECT f.*, (SELECT min_by(t.cwe_id, t.ord) FROM type_cwe t WHERE t.t = f.type OR t.t = f.pattern) AS cwe_id FROM latest f"
add("query_by_cwe", "SELECT finding_id, type, ts FROM latest_cwe WHERE cwe_id = 'CWE-798' ORDER BY ts DESC, finding_id LIMIT 100")
add("store_stats", """SELECT 'findings' AS kind, count(DISTINCT finding_id) AS n FROM finding UNION ALL SELECT 'endpoints', count(*) FROM endpoint
    UNION ALL SELECT 'cwes', count(DISTINCT cwe_id) FROM enriched
    UNION ALL SELECT 'finding_cwe_maps', count(*) FROM (SELECT DISTINCT finding_id, cwe_id FROM enriched WHERE cwe_id IS NOT NULL)""")
add("endpoints", "SELECT * FROM endpoint")
add("findings_all", f"""SELECT 'git' AS source, 'git_pattern' AS type, count(*) AS n FROM ({GIT_FIRST}) HAVING count(*) > 0
    UNION ALL SELECT 'mitm', type, count(*) FROM ({TRAFFIC}) GROUP BY type
    UNION ALL SELECT 'web', inner_type, count(*) FROM (
        SELECT 'status' AS inner_type FROM exchange WHERE status >= 400
        UNION ALL SELECT 'response_pattern' FROM ({hits('exchange', 'url', 'body')})
        UNION ALL SELECT 'header_pattern' FROM ({hits("(SELECT * FROM resp_header WHERE header <> 'Server')", 'url', 'value')})
        UNION ALL SELECT 'cookie_pattern' FROM ({hits("(SELECT * FROM exchange WHERE cookie IS NOT NULL AND cookie NOT LIKE 'sessionid=%')", 'url', 'cookie')})) GROUP BY inner_type
    UNION ALL SELECT 'browser', 'browser_storage', count(*) FROM (SELECT local_key AS key FROM browser UNION ALL SELECT session_key FROM browser) WHERE {SUSPICIOUS}
    UNION ALL SELECT 'browser', 'cookie_insecure', count_if(flag IS NOT TRUE) + count_if(c_custkey % 3 <> 0) FROM browser
    UNION ALL SELECT 'browser', 'browser_global', count(*) FROM browser WHERE config NOT IN ('null', '""', 'false', '0')
    UNION ALL SELECT source, type, count(*) FROM ({SPLIT}) GROUP BY source, type""")

# --- graph ------------------------------------------------------------------

add("enrich_cwe", "SELECT type, pattern, cwe_id, count(*) AS n FROM enriched GROUP BY ALL")
add("enrich_owasp", "SELECT e.cwe_id, owasp_id, count(*) AS n FROM enriched e LEFT JOIN cwe_owasp o ON o.cwe_id = e.cwe_id GROUP BY ALL")
add("kb_cwe_owasp", """SELECT k.cwe_id, k.owasp_id, k.name, k.rank, coalesce(n, 0) AS n FROM cwe_owasp k
    LEFT JOIN (SELECT cwe_id, count(*) AS n FROM enriched GROUP BY cwe_id) c ON c.cwe_id = k.cwe_id""")
add("enrich_mitigation", "SELECT e.cwe_id, mitigation_id, count(*) AS n FROM enriched e LEFT JOIN cwe_mit m ON m.cwe_id = e.cwe_id GROUP BY ALL")
add("attack_vectors", """SELECT substr(sha1(attack_type), 1, 12) AS vector_id, attack_type,
    list_aggregate(list_transform(string_split(attack_type, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS vector_name, count(*) AS n
    FROM enriched JOIN vector USING (cwe_id) GROUP BY attack_type""")
add("graph_nodes", "SELECT id, label, name FROM node")
add("graph_edges", "SELECT src, dst, label FROM edge")
add("graph_stats", """SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('findings', 'Finding'), ('endpoints', 'Endpoint'), ('cwes', 'CWE'), ('owasps', 'OWASP'),
        ('mitigations', 'Mitigation'), ('attack_vectors', 'AttackVector'), ('code_examples', 'CodeExample')) v(kind, label)
    LEFT JOIN (SELECT label, count(*) AS n FROM node GROUP BY label) USING (label) UNION ALL SELECT 'edges', count(*) FROM edge""")
add("graph_paths", """SELECT a.src AS finding, a.dst AS cwe, b.dst AS owasp, c.dst AS mitigation
    FROM edge a JOIN edge b ON b.src = a.dst AND b.label = 'belongs_to' JOIN edge c ON c.src = a.dst AND c.label = 'fixed_by'
    JOIN (SELECT DISTINCT 'owasp:' || owasp_id AS o, 'mitigation:' || mitigation_id AS m FROM owasp_mit) om ON om.o = b.dst AND om.m = c.dst WHERE a.label = 'is_instance_of'""")
ORACLE["graph_reach"] = with_ctes("SELECT 1 FROM edge").replace(" SELECT 1 FROM edge", """, walk AS (
        SELECT src AS start, dst AS node, 1 AS depth FROM edge WHERE label = 'is_instance_of'
        UNION ALL SELECT start, dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 5 AND label IN ('is_instance_of', 'belongs_to', 'fixed_by', 'demonstrates'))
    SELECT start, node, min(depth) AS depth FROM walk WHERE node LIKE 'code_example:%' GROUP BY start, node""")
add("graph_successors", "SELECT e.dst, n.label AS dst_label, n.name AS dst_name, count(*) AS n FROM edge e JOIN node n ON n.id = e.dst WHERE e.label = 'is_instance_of' GROUP BY ALL")
EVIDENCE = "CAST(json_object('description', summary, 'url', url, 'method', method, 'client', source) AS VARCHAR)"
add("graph_finding_attrs", f"""SELECT 'finding:' || finding_id AS id, url, method, summary AS description, severity,
    CAST(occurrence_count AS VARCHAR) AS occurrence_count, {EVIDENCE} AS metadata FROM latest""")
add("norm_findings", f"""SELECT finding_id, type, severity, source, summary, '[REDACTED]' AS snippet, {EVIDENCE} AS metadata,
    'default' AS scan_id, ts AS "timestamp" FROM latest""")
add("store_merge", f"""SELECT finding_id, severity, source, ts AS "timestamp", {EVIDENCE} AS metadata FROM (
    SELECT *, ts >= {VW.SCAN_B_START} AS second FROM finding WHERE ts < {VW.SCAN_A_END} OR ts >= {VW.SCAN_B_START})
    QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY second DESC, ts DESC, url DESC, method DESC, severity DESC, pattern DESC NULLS LAST) = 1""")
add("norm_finding_cwe", "SELECT DISTINCT finding_id, cwe_id, CAST(1.0 AS DOUBLE) AS confidence FROM enriched WHERE cwe_id IS NOT NULL")
add("norm_owasp", """SELECT m.mitigation_id, ex.code_example, sum(c.n) AS findings FROM cwe_mit m
    JOIN (SELECT cwe_id, count(DISTINCT finding_id) AS n FROM enriched GROUP BY cwe_id) c ON c.cwe_id = m.cwe_id
    JOIN (SELECT mitigation_id, string_agg(filename, ', ' ORDER BY filename) AS code_example FROM example GROUP BY mitigation_id) ex ON ex.mitigation_id = m.mitigation_id
    GROUP BY ALL""")
add("flagship", "SELECT severity, e.cwe_id, owasp_id, count(*) AS n FROM enriched e LEFT JOIN cwe_owasp o ON o.cwe_id = e.cwe_id GROUP BY ALL")

# --- retrieval --------------------------------------------------------------

add("keyword_topk", f"""SELECT finding_id AS id, summary, severity, CAST(NULL AS VARCHAR) AS snippet, url, score
    FROM (SELECT *, {keyword_score(Q.QUESTION)} AS score FROM latest) WHERE score > 0 ORDER BY score DESC, {RANK} DESC, ts, finding_id LIMIT 10""")
add("keyword_topk_batch", "SELECT query_id, rank, finding_id AS id, severity, score FROM batch")
CTE["question"] = f"""SELECT c_custkey AS query_id, {pick(('password', 'api key', 'seen for', 'Basic auth', 'cookie cookie', 'zebra', 'storage user', 'in header'), 'c_custkey % 8')}
    || ' user ' || (c_custkey % 1000) || ' no' AS text FROM customer"""
CTE["question_word"] = """SELECT text, w, count(*) AS times FROM (SELECT DISTINCT text FROM question), unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) u(w)
    WHERE length(w) > 2 GROUP BY text, w"""
# Equal questions have equal answers, and a word is looked for once in each text.
CTE["word_hit"] = "SELECT w, finding_id, severity, ts FROM (SELECT DISTINCT w FROM question_word) JOIN latest ON contains(lower(summary || ' '), w)"
CTE["answered"] = f"""SELECT text, finding_id, severity, score, row_number() OVER (PARTITION BY text ORDER BY score DESC, {RANK} DESC, ts, finding_id) AS rank
    FROM (SELECT text, finding_id, severity, ts, sum(times) AS score FROM question_word JOIN word_hit USING (w) GROUP BY ALL)"""
add("keyword_topk_table", "SELECT query_id, rank, finding_id AS id, severity, score FROM question JOIN answered USING (text) WHERE rank <= 3")
RULES = "\n".join(V.PROMPT_RULES)
INSTRUCTIONS = "\n".join(V.PROMPT_INSTRUCTIONS)
add("prompt_context", f"""SELECT query_id, n_contexts, context, length(context) + length(question) + {len(chr(10) + INSTRUCTIONS + chr(10) * 3 + 'Context (from retrieval):' + chr(10)) + len(chr(10) * 2 + 'Query: ') + len(chr(10) * 2 + 'Provide remediation following these rules:' + chr(10) + RULES + chr(10))} AS prompt_length
    FROM asked JOIN (SELECT query_id, count(*) AS n_contexts,
        string_agg('[Source: ' || finding_id || '] Severity: ' || severity || ' URL: ' || url || ' Summary: ' || summary, chr(10) ORDER BY rank) AS context
        FROM batch GROUP BY query_id) USING (query_id)""")
PROMPT_HEAD = chr(10) + INSTRUCTIONS + chr(10) * 3 + "Context (from retrieval):" + chr(10)
PROMPT_TAIL = f"\n\nQuery: {Q.QUESTION}\n\nProvide remediation following these rules:\n{RULES}\n"
add("ask", f"""SELECT {q(Q.QUESTION)} AS question, count(*) AS n_contexts, {q(PROMPT_HEAD)} || string_agg('[Source: ' || finding_id || '] Severity: ' || severity
    || ' URL: ' || url || ' Summary: ' || summary, chr(10) ORDER BY score DESC, {RANK} DESC, ts, finding_id) || {q(PROMPT_TAIL)} AS prompt
    FROM (SELECT *, {keyword_score(Q.QUESTION)} AS score FROM latest WHERE {keyword_score(Q.QUESTION)} > 0 ORDER BY score DESC, {RANK} DESC, ts, finding_id LIMIT 5)""")
add("ensure_citation", f"SELECT conv_id, turn, sha1({cited('text')}) AS answer_sha FROM answer")
# The text has at most one citation, so redaction works on the parts before and after it.
add("answer_postprocess", f"""SELECT conv_id, turn, sha1({cited('t')}) AS answer_sha, contains({cited('t')}, '[Source:') AS cited FROM (
    SELECT conv_id, turn, ids, CASE WHEN n % 3 = 0 THEN {redacted("split_part(text, ' [Source: ', 1)")} || ' [Source: ' || sha1(CAST(conv_id AS VARCHAR)) || '] done'
        ELSE {redacted('text')} END AS t FROM answer)""")

# --- vectors ----------------------------------------------------------------

COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6)"
add("cosine_topk", f"SELECT vec_id AS id, {COS} AS similarity FROM embeddings, mean_vector ORDER BY similarity DESC, id LIMIT 20")
add("vector_dim_check", "SELECT vec_id AS id, 64 AS expected, 63 AS got FROM embeddings WHERE vec_id % 50 = 0")
add("knn_join", f"""SELECT query_id, id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
    FROM (SELECT c.label AS query_id, vec_id AS id, {COS} AS similarity FROM embeddings, centroid c)) WHERE rank <= 10""")

CTE["plane"] = "SELECT b, j, CASE WHEN substr(sha1(b || ':' || j), 1, 1) < '8' THEN 1 ELSE -1 END AS s FROM range(8) x(b), range(64) y(j)"
CTE["vector_bucket"] = """SELECT vec_id, sum(CASE WHEN m >= 0 THEN 1 << b ELSE 0 END) AS bucket FROM (
    SELECT vec_id, b, sum(s * floor(1024 * CAST(embedding[j + 1] AS DOUBLE))) AS m FROM embeddings, plane GROUP BY vec_id, b) GROUP BY vec_id"""
CTE["bucket_size"] = "SELECT bucket, count(*) AS n FROM vector_bucket GROUP BY bucket"
CTE["near_vector"] = """SELECT a.vec_id AS query_id, CASE WHEN b.vec_id IS NULL THEN CAST(a.embedding AS DOUBLE[])
        ELSE list_transform(range(1, 65), lambda j: CAST(a.embedding[j] AS DOUBLE) + CAST(b.embedding[j] AS DOUBLE) * 0.25) END AS q
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0"""
CTE["asked_vector"] = "SELECT * FROM near_vector UNION ALL SELECT -1, q FROM mean_vector"
CTE["probe"] = """SELECT query_id, bucket, n FROM (
    SELECT query_id, bucket, n, sum(n) OVER (PARTITION BY query_id ORDER BY cost, bucket) - n AS before FROM (
        SELECT query_id, bucket, n, sum(CASE WHEN (m >= 0) <> ((bucket >> b) & 1 = 1) THEN abs(m) ELSE 0 END) AS cost FROM bucket_size,
            (SELECT query_id, b, sum(s * floor(1024 * q[j + 1])) AS m FROM asked_vector, plane GROUP BY query_id, b) GROUP BY query_id, bucket, n))
    WHERE before < (SELECT ceil(count(*) / 12) FROM embeddings)"""
CTE["ann"] = f"""SELECT query_id, vec_id AS id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, {COS} AS similarity FROM probe JOIN vector_bucket USING (bucket) JOIN embeddings USING (vec_id) JOIN asked_vector USING (query_id))"""
CTE["visit"] = "SELECT query_id, sum(n) AS visited FROM probe GROUP BY query_id"
add("cosine_ann", "SELECT id, similarity FROM ann WHERE query_id = -1 AND rank <= 20")
add("ann_topk", "SELECT query_id, id, similarity, rank, visited FROM ann JOIN visit USING (query_id) WHERE query_id >= 0 AND rank <= 10")
add("ann_recall", f"""SELECT round(avg(CASE WHEN rank = 1 THEN hit END), 6) AS recall_at_1, round(avg(hit), 6) AS recall_at_10,
    round((SELECT avg(visited) FROM visit WHERE query_id >= 0) / (SELECT count(*) FROM embeddings), 6) AS visited
    FROM (SELECT t.rank, CASE WHEN a.id IS NULL THEN 0 ELSE 1 END AS hit FROM (
        SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, vec_id) AS rank FROM embeddings, near_vector) t
        LEFT JOIN (SELECT query_id, id FROM ann WHERE rank <= 10) a USING (query_id, id) WHERE t.rank <= 10)""")

def weighted_words(source: str) -> str:
    """CTE bodies for the rows ``(id, text)`` of a source: words by bucket, and their weights."""
    return f"""SELECT id, CAST('0x' || substr(sha1(w), 1, 8) AS BIGINT) % 384 AS bucket, CAST(count(*) AS DOUBLE) AS tf
        FROM (SELECT id, unnest(string_split_regex(lower(text), '[^\\pL\\pN_]+')) AS w FROM ({source})) WHERE w <> '' GROUP BY ALL"""


CTE["doc_word"] = weighted_words("SELECT doc_id AS id, text FROM documents")
CTE["doc_weight"] = """SELECT id, bucket, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w
    FROM doc_word JOIN (SELECT bucket, count(*) AS df FROM doc_word GROUP BY bucket) USING (bucket)"""
CTE["found_word"] = weighted_words("SELECT finding_id AS id, summary || ' ' AS text FROM latest")
CTE["bucket_weight"] = "SELECT b.bucket, ln(((SELECT count(*) FROM latest) + 1) / (coalesce(df, 0) + 1)) AS idf FROM range(384) b(bucket) LEFT JOIN (SELECT bucket, count(*) AS df FROM found_word GROUP BY bucket) USING (bucket)"
CTE["asked_word"] = weighted_words(f"SELECT 0 AS id, {q(Q.QUESTION)} AS text")
CTE["alike"] = """SELECT id, round(CASE WHEN n > 0 THEN coalesce(dot, 0) / (sqrt(n) * (SELECT sqrt(sum(tf * idf * tf * idf)) FROM asked_word JOIN bucket_weight USING (bucket))) END, 6) AS similarity FROM (
    SELECT f.id, sum(f.tf * b.idf * f.tf * b.idf) AS n, sum(f.tf * b.idf * a.tf * b.idf) AS dot
    FROM found_word f JOIN bucket_weight b USING (bucket) LEFT JOIN asked_word a USING (bucket) GROUP BY f.id)"""
add("text_vectors", """SELECT doc_id, 384 AS dim, coalesce(buckets, 0) AS buckets, top_bucket, coalesce(round(top / n, 6), 0) AS top_weight, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS norm
    FROM documents LEFT JOIN (SELECT id, count(*) AS buckets, arg_max(bucket, (w, -bucket)) AS top_bucket, max(w) AS top, sqrt(sum(w * w)) AS n FROM doc_weight WHERE w > 0 GROUP BY id) ON id = doc_id""")
add("finding_vector_topk", "SELECT id, similarity FROM alike ORDER BY similarity DESC NULLS LAST, id LIMIT 5")
add("hybrid_topk", f"""SELECT id, round(sum(1.0 / (60 + r)), 8) AS score, count(*) AS lists FROM (
    SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM alike WHERE similarity IS NOT NULL
    UNION ALL SELECT finding_id, row_number() OVER (ORDER BY s DESC, finding_id) FROM (SELECT finding_id, {keyword_score(Q.QUESTION)} AS s FROM latest) WHERE s > 0)
    GROUP BY id ORDER BY score DESC, id LIMIT 5""")

# --- extensions -------------------------------------------------------------

add("entropy_tokens", f"""SELECT doc_id, token_no, length(token) AS original_length, e AS entropy FROM (
    SELECT *, round(list_sum(list_transform(list_distinct(string_split(token, '')),
        lambda c: -((length(token) - length(replace(token, c, ''))) / length(token)) * log2((length(token) - length(replace(token, c, ''))) / length(token)))), 6) AS e
    FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS token_no FROM (SELECT doc_id, regexp_extract_all(text, {q('[A-Za-z0-9+/=_-]{20,}')}) AS t FROM docs))) WHERE e >= 3.5""")
add("scan_diff", f"""SELECT finding_id, CASE WHEN a AND b THEN 'persisting' WHEN b THEN 'new' ELSE 'fixed' END AS state
    FROM (SELECT finding_id, bool_or(ts < {VW.SCAN_A_END}) AS a, bool_or(ts >= {VW.SCAN_B_START}) AS b FROM finding GROUP BY finding_id)""")
FTS = sorted(set(tokens(Q.QUESTION)))
CTE["word"] = f"""SELECT token, finding_id, count(*) AS tf FROM (SELECT finding_id, unnest(string_split(lower(summary), ' ')) AS token FROM latest)
    WHERE token IN ({', '.join(q(t) for t in FTS)}) GROUP BY token, finding_id"""
add("fts_rank", """SELECT finding_id, round(sum(tf * ln((SELECT CAST(count(*) AS DOUBLE) FROM latest) / df)), 6) AS score
    FROM word JOIN (SELECT token, count(*) AS df FROM word GROUP BY token) USING (token) GROUP BY finding_id ORDER BY score DESC, finding_id LIMIT 20""")
add("scan_history", """SELECT finding_id, min(scan) AS first_scan, max(scan) AS last_scan, CASE WHEN max(scan) < (SELECT max((ts - 1704067200) // 432000) FROM finding) THEN max(scan) + 1 END AS fixed_in,
    CASE WHEN row_number() OVER (PARTITION BY finding_id ORDER BY min(scan)) = 1 THEN 'new' ELSE 'returned' END AS state
    FROM (SELECT *, scan - row_number() OVER (PARTITION BY finding_id ORDER BY scan) AS stretch FROM (SELECT DISTINCT finding_id, (ts - 1704067200) // 432000 AS scan FROM finding))
    GROUP BY finding_id, stretch""")
add("domain_match", f"""WITH hosts AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN 'x' || (event_id % 3) || '.c' || (event_id % 1999) || '.example.net'
        WHEN event_id // 11 % 3 = 0 THEN 'eu.api.stripe.com' WHEN event_id // 11 % 3 = 1 THEN 'notstripe.com' END AS host FROM events),
    listed AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'x1.c' END || c_custkey || '.example.net' AS domain FROM customer UNION SELECT unnest({array((*V.BYPASS_DOMAINS, 'net'))})),
    names AS (SELECT host, list_aggregate(string_split(host, '.')[i:], 'string_agg', '.') AS domain FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM hosts))),
    longest AS (SELECT host, arg_max(domain, length(domain)) AS domain FROM names JOIN listed USING (domain) GROUP BY host)
    SELECT event_id, domain FROM hosts LEFT JOIN longest USING (host)""")
ORACLE["fts_stored"] = ORACLE["fts_rank"]
add("ignore_globs", f"""SELECT DISTINCT path, {' OR '.join(f'regexp_matches(path, {q(glob_regex(g))})' for g in Q.GLOBS)} AS ignored FROM diff_files""")
add("severity_by_minute", "SELECT ts - ts % 60 AS minute, severity, count(*) AS n FROM finding GROUP BY ALL")

# --- streams ----------------------------------------------------------------

add("traffic_log_file", "SELECT stage, client, count(*) AS n, sum(ts) AS ts_sum FROM log GROUP BY stage, client")
add("stream_traffic_counts", "SELECT stage, count(*) AS n FROM log GROUP BY stage")
add("stream_severity_window", f"""SELECT ts - ts % 60 AS minute, severity, count(*) AS n FROM ({SPLIT}) GROUP BY ALL""")
add("stream_dedupe", f"SELECT DISTINCT finding_id, type FROM ({SPLIT})")
add("stream_tail", "SELECT stage, count(*) AS n, min(ts) AS oldest FROM (SELECT * FROM log ORDER BY ts DESC, url DESC, stage DESC LIMIT 200) GROUP BY stage")
add("stream_upsert", "SELECT finding_id, severity, source, url, ts, occurrence_count FROM latest")
add("stream_pairs", """SELECT event_id AS exchange_id, url, 200 + event_id % 5 AS status, ts AS asked, ts + event_id * 37 % 400 AS answered
    FROM log WHERE event_id % 7 <> 0 AND event_id * 37 % 400 <= 300""")
add("stream_sessions", """SELECT client, stage, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN ts - before <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY client, stage ORDER BY ts, event_id) AS session
    FROM (SELECT *, lag(ts) OVER (PARTITION BY client, stage ORDER BY ts, event_id) AS before FROM log)) GROUP BY client, stage, session""")
add("stream_sliding", "SELECT stage, ts - ts % 900 - 900 * k AS hour, count(*) AS n FROM log, range(4) r(k) GROUP BY ALL")
SLICE = f"CASE WHEN ts < {VW.SCAN_B_START} THEN 0 WHEN ts < {VW.SCAN_A_END} THEN 1 ELSE 2 END + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END"
add("stream_late", f"""SELECT event_id, ts < coalesce((SELECT max(ts) FROM (SELECT ts, {SLICE} AS s FROM log) b WHERE b.s < a.slice), 0) - 172800 AS late
    FROM (SELECT event_id, ts, {SLICE} AS slice FROM log) a""")
ORACLE["catalog_file"] = ORACLE["pattern_catalog"]
ORACLE["exchange_file"] = ORACLE["web_wrap"]
add("sourcemap_counted", f"""SELECT * FROM (SELECT url, pattern, count(*) AS links, source_index FROM ({ORACLE['sourcemap_pattern']}) GROUP BY url, pattern, source_index)""")
# Pages whose url holds a user name a source map that is not there under that name.
ORACLE["audit_web"] = f"""SELECT inner_type AS type, CASE WHEN inner_type = 'status' THEN 'INFO' ELSE severity END AS severity, count(*) AS n FROM ({ORACLE['web_wrap']}) GROUP BY ALL
    UNION ALL SELECT 'js_pattern', 'HIGH', count(*) FROM ({ORACLE['asset_pattern_counted']}) HAVING count(*) > 0
    UNION ALL SELECT 'sourcemap_pattern', 'HIGH', count(*) FROM ({ORACLE['sourcemap_counted']}) WHERE CAST(regexp_extract(url, '/maps/([0-9]+)', 1) AS INT) % 17 <> 0 HAVING count(*) > 0
    UNION ALL SELECT type, 'MEDIUM', sum(n) FROM ({ORACLE['probe_catchall']}) GROUP BY type"""
