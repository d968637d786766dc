import random

import pytest

from leakscope.sources.diff_log import read_diff_log


def make(rnd, commits):
    """A log, and the lines that it holds."""
    out, want = [], []
    for c in range(commits):
        name, ts = f"{rnd.randrange(16**10):040x}", 1700000000 + c * 60
        out += [f"commit {name}", "Author: a <a@b>", f"Date:   {ts}" if c % 3 else "Date:   2023-11-14T22:13:20Z", "", "    commit message", "    diff --git is only mentioned", ""]
        ts = ts if c % 3 else 1700000000
        for f in range(rnd.randrange(4)):
            path = f"src/f{f} b.py"
            body = [f"index {f}", f"--- a/{path}", f"+++ b/{path}", "@@ -1 +1 @@"]
            body += [rnd.choice("+- ") + rnd.choice(["commit x", "diff --git a/y b/y", "Date: 5", "", "é" * rnd.randrange(30), "text"]) for _ in range(rnd.randrange(30))]
            out += [f"diff --git a/{path} b/{path}", *body]
            want += [(name, ts, path, f + 1, n, line[:1], line) for n, line in enumerate(body, 1)]
        out.append("")
    return "\n".join(out) + "\n", want


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_lines_know_their_commit_in_any_split(spark, tmp_path, split):
    rnd, want = random.Random(split), []
    for i in range(3):
        text, lines = make(rnd, 25)
        (tmp_path / f"log{i}.txt").write_text(text)
        want += lines
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "patch.txt").write_text("diff --git a/x b/x\n+only\n")
    want.append((None, None, "x", 1, 1, "+", "+only"))
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in read_diff_log(spark, str(tmp_path)).collect()]
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tasks > 20 or split > 64


@pytest.mark.parametrize("split", [5000, 1 << 20])
def test_text_lines_are_those_of_text_files(spark, tmp_path, split):
    import gzip

    from leakscope.sources.text_lines import read_text_lines

    texts = {
        "a/long.txt": "line\n" * 5000 + "é" * 9000 + "\nlast", "b.txt": "x\0y\n" * 9, "c.TXT": "\n\n", "late.txt": "z" * 4096 + "\n\0 after the window\n",
        "edge.txt": "z" * 4094 + "\n\0", "empty.txt": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "pic.PNG").write_text("not text")
    (tmp_path / "d.txt.gz").write_bytes(gzip.compress(b"packed"))
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = [(r.path.rsplit("/", 1)[-1], r.line) for r in read_text_lines(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(n.rsplit("/", 1)[-1], x) for n in ("a/long.txt", "c.TXT", "late.txt") for x in texts[n].removesuffix("\n").split("\n")]
    assert sorted(got) == sorted(want)


def test_larger_files_are_left_out_on_request(spark, tmp_path):
    from leakscope.sources.text_lines import read_text_lines

    (tmp_path / "small.txt").write_text("abc\n")
    (tmp_path / "large.txt").write_text("abc\n" * 100)
    assert [r.line for r in read_text_lines(spark, str(tmp_path), max_bytes=4).collect()] == ["abc"]
    assert read_text_lines(spark, str(tmp_path)).count() == 101
