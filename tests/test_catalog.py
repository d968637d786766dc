import pytest

from leakscope import catalog as C


def test_default_catalog_starts_with_the_documented_patterns():
    names = [p.raw_name for p in C.default_catalog()]
    assert names[:4] == ["AWS_ACCESS_KEY_ID", "OPENAI_API_KEY", "STRIPE_SECRET_KEY", "GITHUB_TOKEN"]
    assert [p.name for p in C.fallback_catalog()] == ["Generic Api Key", "Generic Secret", "Private Key"]


@pytest.mark.parametrize(
    "regex, guard",
    [
        ("AKIA[0-9A-Z]{16}", "AKIA"),
        ("sk-x*", "sk-"),
        ("ab?c", None),
        ("abc|def", None),
        ("abc(x|y)", "abc"),
        ("(?i)secret", None),
        (r"SG\.x", "SG"),
        ("a{3}", None),
    ],
)
def test_literal_guard(regex, guard):
    assert C.literal_guard(regex) == guard


@pytest.mark.parametrize("regex", ["a$", r"\bkey\b", "(?<=a)b", "a++", "(a)\\1", r"\p{L}+"])
def test_no_prefilter_for_constructs_that_differ(regex):
    assert C.prefilter_regex(regex) is None


def test_read_catalog(spark, tmp_path):
    path = tmp_path / "patterns.env"
    path.write_text("# comment\n\nMY_KEY = k[0-9]{4}=x\nBROKEN=([a-z\nEMPTY=\nnot a pattern\n")
    with pytest.warns(UserWarning, match="BROKEN"):
        found = C.read_catalog(spark, str(path))
    assert [(p.raw_name, p.name, p.regex) for p in found] == [("MY_KEY", "My Key", "k[0-9]{4}=x")]


def test_missing_catalog_falls_back(spark, tmp_path):
    missing = str(tmp_path / "none.env")
    assert C.read_catalog(spark, missing) == C.fallback_catalog()
    with pytest.raises(Exception):
        C.read_catalog(spark, missing, missing="error")


def test_prefix_terms_last_pattern_of_a_term_wins():
    patterns = C.make_catalog([("A", "ghp_[a-z]+"), ("B", "xyz"), ("C", "ghp_[0-9]+"), ("D", "x-----BEGIN y"), ("E", "(?i)BEARER z")])
    assert C.prefix_terms(patterns) == [("ghp_", "C", 0), ("-----BEGIN", "D", 1), ("bearer", "E", 2)]


def test_fallback_catalog_gives_one_term():
    assert [t for t, _, _ in C.prefix_terms(C.fallback_catalog())] == ["-----BEGIN"]
