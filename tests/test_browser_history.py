from conftest import AWS, GHP, collect

from leakscope.catalog import default_catalog, make_catalog, prefix_terms
from leakscope.operators import browser as B
from leakscope.operators import history as H
from leakscope.sources.readers import BROWSER_STATE

P = default_catalog()


def test_browser_checks(spark):
    rows = [
        ({"authToken": "abc", "theme": "x", "monkey": "m"}, {"API_base": "1"}, [("a", True, True), ("b", None, True), ("c", True, False)],
         {"g1": "null", "g2": '""', "g3": "false", "g4": '"abc"', "g5": "{}", "g6": "0"}, None),
        ({"token": "t"}, {}, [("a", False, False)], {}, "timeout"),
    ]
    df = spark.createDataFrame(rows, BROWSER_STATE)
    found = B.scan_browser(df)
    assert {(r.type, r.key) for r in found.collect()} == {
        ("browser_storage", "authToken"), ("browser_storage", "monkey"), ("browser_storage", "API_base"),
        ("cookie_insecure", "b"), ("cookie_insecure", "c"), ("browser_global", "g4"), ("browser_global", "g5"),
    }
    assert {r.location for r in found.collect() if r.key == "API_base"} == {"sessionStorage"}
    assert {r.key: r.original_length for r in found.collect() if r.type == "browser_global"} == {"g4": 3, "g5": 2}


def diff(*files):
    out = "commit abc\nAuthor: x\n\n"
    for path, lines in files:
        out += f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n" + "\n".join(lines) + "\n"
    return out


def table(spark):
    rows = [
        ("c" * 40, 30, diff(("src/a.py", ["+x", f"+k={AWS}", f"+k={AWS}"]), ("src/b.py", [f"+t={GHP}", f"-old {AWS}"]))),
        ("d" * 40, 20, diff(("z.txt", [f"-{GHP}", f"+{GHP}"]))),
        ("e" * 40, 10, diff(("y.txt", [f"+{AWS}"]))),
    ]
    return spark.createDataFrame(rows, "commit string, commit_ts bigint, diff string")


def test_diff_lines_have_the_path_of_their_file(spark):
    lines = H.diff_lines(table(spark))
    paths = {(r.path, r.line) for r in lines.where(H.added()).collect()}
    assert ("src/a.py", f"+k={AWS}") in paths and ("src/b.py", f"+t={GHP}") in paths
    assert not any(line.startswith("+++") for _, line in paths)


def test_history_modes(spark):
    def rows(**kw):
        return sorted((r.commit, r.path, r.pattern) for r in H.scan_diffs(table(spark), P, **kw).collect())

    c, d, e = "c" * 12, "d" * 12, "e" * 12
    assert rows() == sorted([
        (c, "src/a.py", "Aws Access Key Id"), (c, "src/b.py", "Github Token"), (c, "src/b.py", "Github Pat"),
        (d, "z.txt", "Github Token"), (d, "z.txt", "Github Pat"), (e, "y.txt", "Aws Access Key Id"),
    ])
    assert len(rows(dedupe=None)) == 7
    assert rows(dedupe="commit") == [(c, "src/a.py", "Aws Access Key Id"), (d, "z.txt", "Github Token"), (e, "y.txt", "Aws Access Key Id")]


def test_first_file_of_a_commit_without_its_lines_in_the_plan(spark):
    # The first file may lie in another diff of the commit, without any secret, and a header alone is no file.
    rows = [
        ("c" * 40, 30, diff(("b.py", [f"+k={AWS}"]))), ("c" * 40, 30, diff(("a.py", ["+x"] * 50))), ("d" * 40, 20, "diff --git a/0 b/0"),
        ("d" * 40, 20, diff(("y.txt", ["-x"]), ("x.txt", [f"+{AWS}"]))), ("e" * 40, 10, diff(("n.txt", ["+x"]))), ("f" * 40, 5, None),
    ]
    diffs = spark.createDataFrame(rows, "commit string, commit_ts bigint, diff string")
    want = [("c" * 12, "a.py"), ("d" * 12, "y.txt")]
    scans = H.scan_diffs(diffs, P, dedupe="commit"), H.scan_history(H.diff_lines(diffs), P, dedupe="commit")
    for got in scans:
        assert sorted({(r.commit, r.path) for r in got.collect()}) == want
    # No sort of lines: the files are those of sections, or of lines put together by hashing.
    plans = [got._jdf.queryExecution().optimizedPlan().toString() for got in scans]
    sections, lines = [p[p.index("min_by(path") :].splitlines() for p in plans]
    assert sum("Generate" in x for x in sections) == 1
    assert lines[1].strip(" :+-").startswith("Aggregate [commit")


def test_pickaxe_counts_changes_per_file(spark):
    found = H.pickaxe(H.diff_lines(table(spark)), prefix_terms(P))
    rows = {(r.commit[0], r.term, r.files) for r in found.collect()}
    assert rows == {("c", "AKIA", 2), ("c", "ghp_", 1), ("e", "AKIA", 1)}


def test_budget_prefers_terms_in_order_and_newest_commits(spark):
    lines = H.diff_lines(table(spark))
    two = make_catalog([("A", "AKIA[0-9A-Z]{16}"), ("G", "ghp_[0-9a-zA-Z]{36}")])
    assert collect(H.examined_commits(lines, two, 1).select("commit")) == [("c" * 40,)]
    # A commit reached by two terms uses the budget twice, so the older commit is not examined.
    assert collect(H.examined_commits(lines, two, 3).select("commit")) == [("c" * 40,)]
    assert collect(H.examined_commits(lines, two, 4).select("commit")) == [("c" * 40,), ("e" * 40,)]
    pruned = H.scan_history(lines, two, max_commits=1)
    assert {r.commit for r in pruned.collect()} == {"c" * 12}
