"""Fixed values.

Everything in this file is data that results depend on: word lists, header and
host lists, probe paths, finding types and literal search terms.  They are kept
in their natural order and nothing here is computed.
"""

REDACTED = "[REDACTED]"

# Severity names and ranks; any other value ranks 1.
SEVERITY_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
SEVERITY_FILTERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN")

# Lengths of a matched value are reported up to these caps.
CAP_HISTORY = 200
CAP_WEB = 400
CAP_PROBE = 800
CAP_RESPONSE_BODY = 200

# Paths that often expose configuration or credentials.
PROBE_PATHS = (
    "/.env", "/.env.local", "/.env.production", "/.env.development",
    "/.git/config", "/.git/HEAD", "/.git/index",
    "/config.php", "/config.php.bak", "/config.yml", "/database.yml",
    "/phpinfo.php", "/server-status", "/info.php",
    "/.htpasswd", "/.htaccess",
    "/.DS_Store", "/.gitignore",
    "/.circleci/config.yml", "/.travis.yml", "/.github/workflows",
)

# File suffixes that are never scanned as text.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif",
    ".zip", ".tar", ".gz",
    ".db", ".sqlite",
    ".wasm", ".dll", ".exe",
)

# Links and source-map references.
LINK_REGEX = r"""(?i)(?:src|href)=["']([^"']+)["']"""
SOURCE_MAP_REGEX = r"sourceMappingURL\s*=\s*([\w\-_./\\]+\.map)"
ASSET_SUFFIXES = (".js", ".map")

# Response headers and cookie names that are not scanned.
IGNORED_HEADERS = ("etag", "server", "date", "content-length")
SKIPPED_COOKIES = (
    "_streamlit_xsrf", "sessionid", "session", "csrf_token", "xsrf-token",
    "ajs_anonymous_id", "ajs_user_id", "_ga", "_gid", "_fbp",
)

# Hosts whose traffic is never proxied.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
BYPASS_DOMAINS = (
    "accounts.google.com", "oauth2.googleapis.com", "www.googleapis.com", "googleapis.com",
    "login.microsoftonline.com", "login.live.com",
    "auth0.com", "okta.com",
    "api.openai.com", "openai.com",
    "api.anthropic.com", "anthropic.com",
    "api.groq.com", "groq.com",
    "api-inference.huggingface.co", "huggingface.co",
    "api.cohere.ai", "cohere.ai",
    "replicate.com", "api.replicate.com",
    "together.xyz", "api.together.xyz",
    "anyscale.com", "api.anyscale.com",
    "perplexity.ai", "api.perplexity.ai",
    "stripe.com", "api.stripe.com",
    "paypal.com", "api.paypal.com",
    "cloudflare.com", "cloudflare.net",
    "cloudfront.net",
)
BYPASS_HOST_PARTS = (
    ".amazonaws.com", ".execute-api.", ".lambda-url.", ".cloudfront.net", ".s3.amazonaws.com",
)
BYPASS_URL_TOKENS = ("oauth", "openid", "/auth", "/login", "sso", "saml")

# Hosts and url tokens whose traffic is not counted.
IGNORE_HOST_REGEX = (
    r"(?i)(accounts\.google\.com|oauth2\.googleapis\.com|.*\.googleapis\.com"
    r"|login\.microsoftonline\.com|login\.live\.com|auth0\.com|okta\.com)"
)
IGNORE_URL_TOKENS = ("oauth", "sso", "openid", "/auth/", "/login")

# Request headers that carry keys.
KEY_HEADERS = ("authorization", "x-api-key", "api-key", "apikey")

# Password fields in request bodies: group 1 is the field, group 2 the value.
PASSWORD_FIELD_REGEX = (
    r"""(?i)["']?(password|passwd|pwd|user_password|pass)["']?\s*[:=]\s*["']?([^"',}\s]+)"""
)

# Response content types that are scanned as text.
TEXT_CONTENT_TYPES = ("text/", "application/json", "application/xml", "application/javascript")

# Patterns whose use in an Authorization header over https raises no alert.
EXPECTED_SERVER_AUTH = (
    "OPENAI_API_KEY", "ANTHROPIC_API_KEY", "GROQ_API_KEY", "MISTRAL_API_KEY",
    "HUGGINGFACE_TOKEN", "GITHUB_PAT", "GITLAB_PAT",
)

# Traffic log stages.
STAGE_PROXIED = "mitm_outbound"
STAGE_BYPASSED = "mitm_bypass"
STAGE_FINDING = "security_finding"

# Parts of a storage key that make it suspicious.
STORAGE_KEY_PARTS = ("token", "key", "secret", "api")

# Substitutions made in model answers, applied in this order.
REDACTION_REGEXES = (
    r"AKIA[0-9A-Z]{16}",
    r"(?:ghp|gho)_[A-Za-z0-9_]{36}",
    r"[A-Za-z0-9\-_]{40,}",
)

# Literal search terms taken from the start of a regex: (start of regex, term).
PREFIX_TERMS = (
    ("AKIA", "AKIA"), ("AIza", "AIza"), ("sk-", "sk-"), ("sk_live_", "sk_live_"),
    ("sk_test_", "sk_test_"), ("gsk_", "gsk_"), ("hf_", "hf_"), ("r8_", "r8_"),
    ("xox", "xox"), ("ghp_", "ghp_"), ("gho_", "gho_"), ("glpat-", "glpat-"),
    ("AC[", "AC"), ("SK[", "SK"), ("SG", "SG."), ("key-", "key-"), ("sq0", "sq0"),
    ("shpat_", "shpat_"), ("eyJ", "eyJ"), ("mongodb", "mongodb"), ("postgres", "postgres"),
    ("mysql", "mysql"), ("redis", "redis"), ("https://[a-f0-9]{32}", "sentry"),
    ("[A-Za-z0-9_-]{24}", "Discord"), ("[0-9]{8,10}:", "Telegram"), ("AAAA", "AAAA"),
    ("EAA", "EAA"), ("secret_", "secret_"), ("ntn_", "ntn_"), ("key[", "key"),
    ("pk", "pk."), ("pypi-", "pypi-"),
)
# Terms for a regex that only has to contain a word; the second compares in lower case.
CONTAINED_TERMS = (("-----BEGIN", "-----BEGIN"),)
CONTAINED_TERMS_LOWER = (("bearer", "bearer"),)
CONTAINED_TERMS_LAST = (("ya29", "ya29"),)

# Prompt text sent with the retrieved contexts: the instructions, then the question.
PROMPT_INSTRUCTIONS = (
    "You are a security expert analyzing vulnerability findings.",
    "You MUST cite retrieved context using [Source: finding_id].",
    "You MUST NOT expose any secret values or credentials.",
    "You MUST provide actionable remediation steps.",
)
PROMPT_RULES = (
    "1. Cite sources for every claim using [Source: finding_id]",
    "2. Prioritize by severity (CRITICAL first)",
    "3. Include code examples where applicable",
    "4. Explain the security impact",
)
