"""Runs, repeated passages and whitening against brute force, with nulls, empty tables, repeated rows and clashing columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.llm import html_text, langid, repeats, runs, warc, whiten

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, chunk long, words long, found int, group int, kept string, v int, id string, runs int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", 5, "y", 6) for i, t in rows], DOCS)


# --- 11 --------------------------------------------------------------------


def brute_runs(words, least):
    """All maximal stretches by comparing words at each distance."""
    out, n = set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            own = words[i : end + q]
            if len(own) >= max(least, 2 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.add((i, len(own), q))
            i = end
    return sorted(out)


def brute_collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def brute_lyndon(word):
    is_lyndon = lambda x: all(x < x[k:] for k in range(1, len(x)))
    return [max(m for m in range(1, len(word) - i + 1) if is_lyndon(word[i : i + m])) for i in range(len(word))]


def test_lyndon_lengths_are_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        texts = [[rnd.randint(1, 3) for _ in range(rnd.randint(0, 14))] for _ in range(3)]
        got, at = runs.lyndon_lengths(np.array([0] + [x for t in texts for x in [*t, 0]])), 1
        for t in texts:
            assert got[at : at + len(t)] == brute_lyndon(t)
            at += len(t) + 1


def test_runs_are_brute_force():
    rnd = random.Random(4)
    for _ in range(500):
        least, texts = rnd.choice([2, 3, 5, 12]), []
        for _ in range(4):
            own = [rnd.randint(0, rnd.choice([1, 2, 3, 8])) for _ in range(rnd.randint(0, 40))]
            if own and rnd.random() < 0.5:
                a, p = rnd.randrange(len(own)), rnd.randint(1, 8)
                own = [own[min(i, len(own) - 1) if i < a else min(a + (i - a) % p, len(own) - 1)] for i in range(len(own))]
            texts.append(own)
        ends = np.cumsum([0] + [len(t) for t in texts])
        want = sorted((s + e, n, q) for t, e in zip(texts, ends) for s, n, q in brute_runs(t, least))
        assert [tuple(r) for r in runs.runs_of(np.array([x for t in texts for x in t], dtype=np.int64), ends, least).tolist()] == want


@pytest.mark.parametrize("text,want", [
    (np.tile(np.arange(5000), 30), [(0, 150000, 5000)]),
    (np.zeros(150000, np.int64), [(0, 150000, 1)]),
    (np.arange(150000), []),
])
def test_long_texts_have_their_runs(text, want):
    assert [tuple(r) for r in runs.runs_of(text, np.array([0, len(text)]), 12).tolist()] == want


def test_run_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 64)
    twelve = " a\tb\x0bc" * 4
    rows = [(1, twelve), (1, twelve), (None, "x " * 11), (2, None), (3, ""), (4, " \n"), (5, "x y " * 12), (6, "é " * 13 + "ü " * 12), (7, "p q r s")]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.v) for r in runs.find_runs(docs(spark, rows).repartition(2), keep=("v",)).collect()]
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        found = brute_runs(words, 12)
        want.append((i, len(words), found, brute_collapsed(words, found), 5))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.find_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs(spark, []), least=1)


def test_cycles(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(300)] + [(None, "a b"), (11, None)]
    got = runs.with_cycles(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    for r, (i, t) in zip(got.collect(), rows):
        h = None if i is None else zlib.crc32(str(i).encode())
        words, want = (t or "").split(), t
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(words[k if k < a else a + (k - a) % p] for k in range(n))
        assert (r.doc_id, r.text) == (i, want)


# --- 12 --------------------------------------------------------------------


def brute_repeats(rows, least):
    first, words = {}, [(math.inf if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, own in words:
        for k in range(len(own) - least + 1):
            key = tuple(own[k : k + least])
            first[key] = min(first.get(key, math.inf), i)
    out = []
    for (i, own), (id, _) in zip(words, rows):
        gone = {k + j for k in range(len(own) - least + 1) if first[tuple(own[k : k + least])] < i for j in range(least)}
        spans = [(k, next(e for e in range(k, len(own) + 1) if e not in gone) - k) for k in sorted(gone) if k - 1 not in gone]
        out.append((id, len(own), len(gone), spans, b" ".join(w for k, w in enumerate(own) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,group,chunk,counted", [(13, 1 << 16, 2 << 20, 1 << 21), (13, 3, 200, 10), (2, 20, 3000, 10), (20, 3, 3000, 1000)])
def test_repeats_are_brute_force(spark, monkeypatch, least, group, chunk, counted):
    for name, value in (("GROUP", group), ("CHUNK", chunk), ("COUNTED", counted)):
        monkeypatch.setattr(repeats, name, value)
    rnd = random.Random(least + group)
    words = ["".join(rnd.choice("abcé\0.") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    lines, rows = [[rnd.choice(words) for _ in range(rnd.randint(1, 40))] for _ in range(8)], []
    for i in range(60):
        parts = [w for _ in range(rnd.randint(0, 6)) for w in (rnd.choice(lines) if rnd.random() < 0.5 else rnd.choices(words, k=rnd.randint(0, 30)))]
        rows.append((rnd.choice([None, i, i, i, 7]), rnd.choice([None, "", " \n"]) if rnd.random() < 0.1 else rnd.choice(["  ", "", "\t"]) + rnd.choice([" ", " \x0b"]).join(parts)))
    rows += rows[5:8]
    got = repeats.remove_repeats(docs(spark, rows).repartition(3), least=least).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(x) for x in r.repeats], r.kept) for r in got), key=str) == brute_repeats(rows, least)


def test_frequent_passages_are_split_by_all_their_words(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 5)
    passage = " ".join(f"common{k}" for k in range(14))
    rows = [(i, f"start{i} {passage} end{i} " + " ".join(f"own{i}x{k}" for k in range(9))) for i in range(80)]
    got = repeats.remove_repeats(docs(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 14 if i else 0 for i in range(80)}


def test_repeats_without_rows(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs(spark, []), least=1)


# --- 13 --------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, v int, n double, deviation string")


def brute_whitening(rows, scale=1024, offset=100000):
    x = np.floor(np.array(rows, float) * scale) + offset
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], axes[:, ::-1].T


def test_whitening_is_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = table.orderBy("vec_id").collect()
    x, centred, values, axes = brute_whitening([r.embedding for r in given])
    got = whiten.whitened_components(table.repartition(3)).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(r.vec_id, j) for r in given for j in range(1, 9)]
    mine = np.array([r.whitened for r in got]).reshape(-1, 8)
    want = centred @ axes[:8].T / np.sqrt(values[:8])
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-9
    exact = [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    assert [r.deviation for r in got[::8]] == exact and {r.n for r in got} == {len(x)}
    assert np.allclose([r.explained for r in got[:8]], values[:8] / values.sum(), rtol=1e-9) and got[0].identity_error < 1e-12


def test_components_of_nearly_dependent_columns(spark):
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(300, 5)) * [1e6, 1e3, 9, 1, 1])
    rows[:, 3] = rows[:, 0] + rows[:, 1]
    rows[:, 4] = 7
    model = whiten.fit(vectors(spark, [(i, [float(c) for c in r]) for i, r in enumerate(rows)]).repartition(4))
    _, centred, values, axes = brute_whitening(rows, 1, 0)
    assert len(model.variances) == 3 and np.allclose(model.variances, values[:3], rtol=1e-6)
    assert np.allclose(np.abs(model.components @ axes[:3].T), np.eye(3), atol=1e-6)


def test_odd_vectors(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0])]
    assert whiten.whitened_components(vectors(spark, [])).count() == 0
    assert whiten.whitened_components(vectors(spark, bad)).count() == 0
    assert whiten.whitened_components(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # no variance, no component
    rows = bad + [(None, [0.0, 0.0, 5.0]), (7, [1.0, 2.0, 5.0]), (7, [2.0, 4.0, 5.0]), (8, [1.0])]
    got = whiten.whitened_components(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in got) == [
        (0, 1, 3, 47185920, 1.224744871), (7, 1, 3, 0, 0.0), (7, 1, 3, 47185920, 1.224744871)]
    big = vectors(spark, [(i, [1e30 * (i % 3 - 1), float(i)]) for i in range(7)])
    model = whiten.fit(big, scale=1024, offset=100000)
    exact = {r.vec_id: r.deviation for r in whiten.whiten(big, model, 2).collect()}
    assert model.n == 7 and set(exact.values()) == {None}  # beyond 38 digits
    mid = vectors(spark, [(i, [2.0**60 * i, 0.5]) for i in range(3)])
    got = {r.vec_id: int(r.deviation) for r in whiten.whiten(mid, whiten.fit(mid), 2).collect()}
    assert got == {0: 9 * 2**120, 1: 0, 2: 9 * 2**120}
    assert got and whiten.whitened_components(mid, scale=1, offset=0).select(F.max("deviation")).first()[0] == 0


# --- 5 and 8 ---------------------------------------------------------------


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") > 5, F.repeat(F.lit("x"), 200)).alias("html"))
    warc.write_archives(warc.deduplicated(pages.coalesce(1)), str(tmp_path / "in"))
    index = warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    read = warc.read_records(index)
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in read.collect()}
    assert got == {i: (0, "response", None) if i < 6 else (200, "response", None) if i == 6 else (200, "revisit", 6) for i in range(40)}


def test_language_fit_holds_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"text number {i} of the batch" for i in range(4000)])
    tracemalloc.start()
    seen = sum(int(n.sum()) > 0 for _, n in langid._counts(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 4000 and peak < 16 << 20
    whole = {}
    for i, buckets in langid._trigrams(texts):
        whole[i] = whole.get(i, 0) + np.bincount(buckets, minlength=langid.BUCKETS)
    assert all((whole[i] == n).all() for i, n in langid._counts(texts))


# --- 6 ---------------------------------------------------------------------


def test_loose_text_is_kept_and_classified():
    nodes, blocks = html_text.parse("Intro text of the page.<div>a block of words</div> tail <b>text</b>")
    assert [t for _, t in blocks] == ["Intro text of the page.", "a block of words", "tail text"]
    assert nodes[blocks[0][0]].tag == "body" and blocks[0][0] == blocks[2][0] and len(html_text.features(nodes)) == 2
    assert html_text._texts(["Intro.<div>words</div>tail", "only text", ""], []) == ["Intro.\n\nwords\n\ntail", "only text", ""]


def test_siblings_are_numbered_in_any_number():
    nodes, _ = html_text.parse("<div>" + "<p>x y</p>" * 9000 + "<ul><li>z</ul></div>")
    rows = html_text.features(nodes)
    many = len(nodes[1].children)
    place = len(html_text.KINDS) + 13
    assert many == 9001 and [r[place] for r in rows[1:9002]] == [k / many for k in range(many)]


@pytest.mark.parametrize("page", [
    '<a href="x>y ' * 70000, "<p class='a>text</p>" * 50000, "<div>" * 100000 + "x", "<b>" * 250000 + "x", "<a><div>" * 60000 + "</a>" * 60000,
    '<a b="c ' * 100000, "< <x " * 200000, "<head>" * 100000, "</script" * 100000 + "<script>" * 1000, "<!--" * 200000, "<li>" * 100000, "<p>x<table>" * 60000,
], ids=lambda p: p[:12])
def test_hostile_pages_take_time_in_proportion(page):
    import time

    def seconds(text):
        start = time.process_time()
        nodes, _ = html_text.parse(text)
        html_text.decode(nodes, [0.5] * len(html_text.features(nodes)))
        return time.process_time() - start

    half, whole = seconds(page[: len(page) // 2]), seconds(page)
    assert whole < 3.2 * half + 0.3  # twice the page takes about twice the time


def test_tables_without_article_elements_have_texts(spark):
    import re

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").limit(120)
    marked = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", r"(?i)<(/?)(article|main)\b", "<$1div"))
    assert plain.where(F.col("html").rlike("(?i)<(article|main)")).count() == 0
    found = {r.page_id: r.text for r in html_text.extract_pages(plain).collect()}
    words = lambda t: set(re.findall(r"\w+", t))
    scores = []
    for i, text in marked.items():
        a, b = words(text), words(found[i])
        if a:
            scores.append(2 * len(a & b) / (len(a) + len(b)))
    assert sum(scores) / len(scores) > 0.9, sum(scores) / len(scores)
