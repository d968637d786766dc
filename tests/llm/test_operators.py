"""The operators against brute force, libraries and fixed cases, with nulls, empty tables and clashing columns."""

import gzip
import hashlib
import json
import math
import os
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from leakscope.llm import common, decontam, html_text, kneser, langid, preference, simhash, spm, topk, urls, warc
from leakscope.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fp string, entry int, score int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, l, "s", "x", 1, 2) for i, t, l in rows], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 ---------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {i: i for i in prints}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_simhash_is_brute_force(spark, sample):
    got = {r.doc_id: r for r in simhash.simhash_dedup(sample).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in sample.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


def test_hash_is_that_of_spark(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("n", [40, 400])
def test_links_of_crowded_entries_are_complete(spark, n):
    rng = random.Random(n)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < n:  # many share a half, more than are paired at once
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_neither_entries_nor_rows_are_sent(spark):
    """Entries repeat, so their files are small; Spark would send them, and the rows, by the size of the files."""
    prints = spark.createDataFrame([(0,), (1,), (1 << 40,), (7,)], "fp long")
    pairs = simhash.links(prints)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (0, 1 << 40), (1, 1 << 40), (1, 7)}
    rows = simhash.simhash_dedup(docs(spark, (1, "one", "en"), (2, "ONE", "en"), (3, "two", "en")))
    join = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in join
    assert sorted((r.doc_id, r.component_id) for r in rows.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_sent_shuffles_beyond_its_rows(spark, monkeypatch):
    ids = common.stored(spark.range(5), "ids")
    plan = lambda: spark.range(9).join(common.sent(ids), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan()
    monkeypatch.setattr(common, "SENT_ROWS", 4)
    assert "BroadcastExchange" not in plan()


def test_simhash_edges(spark):
    rows = docs(spark, (1, None, "en"), (2, "", "en"), (3, " \t", "en"), (4, "one", "en"), (4, "one", "en"), (None, "One", "en"), (9, "word " * 40000, "en"))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(rows).collect())
    assert [x[2] for x in got] == [4, 1, 1, 1, 4, 4, 9] and got[1][1] == "0" * 16
    assert simhash.simhash_dedup(docs(spark)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (7, 7), (5, 4), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


# --- 2 ---------------------------------------------------------------------


def test_masks_cover_all_substitutions():
    assert decontam.covers() and decontam.covers(decontam.SHORT_MASKS, 8, 1)


def test_overlaps_are_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    item = [rng.choice(words) for _ in range(25)]
    rows, want = [], set()
    for i in range(60):
        text = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            part = item[rng.randrange(5) :][: rng.randint(10, 20)]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "x"
            text[10:10] = part
        rows.append((i, " ".join(text).replace("w1 ", "W1, "), "en"))
        for s in range(-12, len(text)):
            for a in range(len(item) - 12):
                if 0 <= s + a and s + a + 13 <= len(text) and sum(x != y for x, y in zip(item[a : a + 13], text[s + a : s + a + 13])) <= 2:
                    want.add(i)
    tests = spark.createDataFrame([(7, " ".join(item)), (8, "w1 w2 w3"), (9, None)], "item_id long, text string")
    got = decontam.overlaps(docs(spark, *rows, (99, None, "en"), (98, "", "en")), tests).collect()
    assert {r.doc_id for r in got} == want and len(want) > 5 and {r.item_id for r in got} == {7}
    assert decontam.overlaps(docs(spark), tests).count() == 0
    assert decontam.overlaps(docs(spark, *rows), tests.limit(0)).count() == 0


def test_short_item_with_one_substitution(spark):
    tests = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 g7 h8")], "item_id long, text string")
    got = decontam.overlaps(docs(spark, (1, "x a1 b2 c3 zz e5 f6 g7 h8 y", "en"), (2, "a1 b2 zz d4 zz f6 g7 h8", "en"), (3, "A1 b2, c3 d4 e5 f6 g7 h8.", "en")), tests)
    assert sorted((r.doc_id, r.start, r.tokens, r.equal) for r in got.collect()) == [(1, 1, 8, 7), (3, 0, 8, 8)]


def test_items_of_few_tokens_and_scripts_without_spaces(spark):
    import pyarrow as pa

    assert decontam.tokens(pa.array(["Abc 中文x、ที่นี่ é1", "", None])).to_pylist() == [["abc", "中", "文", "x", "ที่", "นี่", "é1"], [""], None]
    items = [(1, "Who wrote Faust?"), (2, "Faust"), (3, "水在標準大氣壓下沸騰的溫度是多少"), (4, "ประเทศไทยมีเมืองหลวงชื่ออะไร"), (5, "..."), (6, "巴黎在哪"), (7, "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = docs(
        spark, (1, "so: who wrote  FAUST, they asked", "en"), (2, "who wrote a faust", "en"), (3, "問:水在標準大气壓下沸騰的温度是多少?", "zh"),
        (4, "ถามว่าประเทศไทยมีเมืองหลวงชื่ออะไรครับ", "th"), (5, "她問巴黎在哪裡", "zh"), (6, "巴黎在那", "zh"), (7, "who wrote it ...", "en"), (8, None, "en"),
    )
    got = decontam.overlaps(rows, tests).collect()
    assert sorted((r.doc_id, r.item_id, r.tokens - r.equal) for r in got) == [(1, 1, 0), (1, 2, 0), (2, 2, 0), (3, 3, 2), (4, 4, 0), (5, 6, 0)]
    assert {(r.doc_id, r.item_id): (r.start, r.tokens) for r in got if r.item_id != 4} == {(1, 1): (1, 3), (1, 2): (3, 1), (2, 2): (3, 1), (3, 3): (1, 16), (5, 6): (2, 4)}


# --- 3 ---------------------------------------------------------------------


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.Net/x?q", None), (2, "https://b.example.net/en/1", ""), (3, "http://example.com/de/2#t", "x"), (4, "http://example.com/den", None),
        (5, "http://q.org/fr/", None), (6, None, None), (7, "nothing", None), (8, "http://x.net", None), (9, "http://notnet/", None),
    ]
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.com", "/de/2", "example.com/de/", "block"),
        4: ("example.com", "/den", None, "block"), 5: ("q.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("x.net", "", None, "allow"), 9: ("notnet", "/", None, "allow"),
    }


def brute_scores(rows):
    """Trust, rank and distrust of hosts ``(host, action, html)`` by solving their equations; links are those of the rows' pages."""
    import re

    import numpy as np

    links, hosts = {}, sorted({h for h, _, _ in rows if h} | {t for h, _, html in rows if h for t in re.findall("http://([^/]+)", html)})
    for h, _, html in rows:
        for t in re.findall("http://([^/]+)", html):
            if h and t != h:
                links[h, t] = links.get((h, t), 0) + 1
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    w /= np.where(w.sum(axis=1) > 0, w.sum(axis=1), 1)[:, None]
    share = lambda action: np.array([np.mean([x == action for h, x, _ in rows if h == name] or [0]) for name in hosts])
    allowed, blocked, one = share("allow"), share("block"), np.eye(len(hosts))
    solve = np.linalg.solve
    found = (solve(one - 0.85 * w.T, allowed), solve(one - 0.85 * w.T, np.ones(len(hosts))), solve(one - 0.85 * (1 - allowed - blocked)[:, None] * w, blocked))
    return {h: tuple(float(x[i]) for x in found) for h, i in at.items()}


def test_scores_are_the_fixed_point(spark):
    html = lambda *to: "".join(f'<a href="http://{x}/">' for x in to)
    rows = [("bad", "block", ""), ("near", None, html("bad")), ("far", None, html("near", "good", "good")), ("good", "allow", html("next")), ("next", None, html("far"))]
    rows += [("half", "block", html("far", "only")), ("half", None, ""), ("", "block", html("far")), ("bad", "block", html("bad"))]
    table = spark.createDataFrame(rows, "host string, action string, html string")
    got = {r.host: (r.trust, r.rank, r.distrust) for r in urls.host_scores(table, tolerance=1e-12).collect()}
    want = brute_scores(rows)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h], abs=1e-6) for h in want)
    with pytest.raises(ArithmeticError):
        urls.host_scores(table, tolerance=1e-12, rounds=5)
    assert urls.host_scores(table.limit(0)).count() == 0


def test_verdicts_are_brute_force(spark):
    rng = random.Random(8)
    names = [f"h{i}.com" for i in range(14)] + ["a.net", "b.net", "c.net", "x.org", "y.org"]
    rows = []
    for i in range(60):
        host = rng.choice(names)
        path = "/fr/1" if host.endswith("org") and rng.random() < 0.8 else "/p"
        rows.append((i, f"http://{host.upper()}{path}?q", "".join(f'<a href="http://{x}/">' for x in rng.choices(names, weights=[1] * 14 + [6] * 3 + [2] * 2, k=rng.randrange(4)))))
    judged = []
    for _, url, html in rows:
        host, path = url[7:].split("/")[0].lower(), "/" + url[7:].split("/", 1)[1]
        judged.append((host, "block" if host.endswith(".net") else "allow" if host.endswith(".org") and path.startswith("/fr/") else None, html))
    scores = brute_scores(judged)
    want = {i: a or ("block" if scores[h][2] - scores[h][0] / scores[h][1] >= 0.5 else "allow") for (i, _, _), (h, a, _) in zip(rows, judged)}
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and len({want[i] for i, (_, a, _) in enumerate(judged) if a is None}) == 2


def test_verdicts_of_farms_and_hubs(spark):
    html = lambda *to: "".join(f'<a href="http://{x}/">' for x in to)
    rows = [("bad.net/", ""), ("worse.net/", ""), ("good.org/fr/", html("friend.com"))]
    rows += [(f"farm{i}.com/", html("bad.net")) for i in range(40)]  # many linkers of one blocked host
    rows += [("behind.com/", html("farm3.com", "farm4.com"))]  # two hops away
    rows += [("hub.com/", html("worse.net", *(f"clean{i}.com" for i in range(60))))]  # the only linker of worse.net
    rows += [("reader.com/", html("hub.com")), ("friend.com/", html("bad.net")), ("mixed.com/", html("bad.net", "a.com", "b.com"))]
    pages = spark.createDataFrame([(i, f"http://{u}", h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in urls.filter_urls(pages).collect()}
    blocked = {"bad.net", "worse.net", "behind.com", *(f"farm{i}.com" for i in range(40))}
    assert {h for h, v in got.items() if v == "block"} == blocked


# --- 4 ---------------------------------------------------------------------


def test_topk_is_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(8)]) for i in range(500)] + [(600 + i, [0.5] * 8) for i in range(30)]
    odd = [(1000, None), (1100, [None] * 8), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (None, [0.1] * 8), (1400, [0.25] * 3), (1500, [])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, distance int, rank int")
    got = sorted(tuple(r) for r in topk.topk(table, table.where("vec_id % 100 = 0"), pivots=16, block=3).collect())
    back = {r.vec_id: r.embedding for r in table.collect()}
    ints = {i: [math.floor(1024 * float(x)) for x in v] for i, v in back.items() if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    want = []
    for q in sorted(i for i in ints if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.topk(table.limit(0), table.limit(0)).count() == 0


def test_topk_of_long_vectors_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [rng.gauss(0, 1) * 10.0 ** rng.choice((4, 5, 6, 9, 30)) for _ in range(8)]) for i in range(40)]
    rows += [(400 + i, [1e5] * 8) for i in range(15)] + [(500 + i, [1e5] * 7 + [1e5 + i / 64]) for i in range(15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in topk.topk(table, table.where("vec_id % 100 in (0, 7)"), pivots=16, block=3).collect()), key=lambda r: r[:3])
    ints = {r.vec_id: [math.floor(1024 * float(x)) for x in r.embedding] for r in table.collect()}
    want = []
    for q in sorted(i for i in ints if i % 100 in (0, 7)):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, n, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(best, 1)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want, key=lambda r: r[:3])]
    assert {r[:3]: r[3] for r in got} == {r[:3]: r[3] for r in want}


# --- 5 ---------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "u\r\nX: y", long), (1, None, long), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "<p>" + "x" * 3_000_000), (3, "again", long), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    warc.write_archives(warc.deduplicated(pages), source)
    index = warc.normalise(spark, source, target)
    got = warc.read_records(index).collect()
    key = lambda x: tuple((y is not None, y) for y in x)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and i is not None and i > min(r[0] for r in rows if r[2] == html and r[0] is not None)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    for entry in index.collect():  # each member stands alone, and the sidecar lies beside its archive
        path = entry.archive.removeprefix("file:")
        with open(path, "rb") as f:
            f.seek(entry.offset)
            assert gzip.decompress(f.read(entry.length)).startswith(b"WARC/1.1\r\n")
        with open(path.replace(".warc.gz", ".index.json")) as f:
            assert any(json.loads(x)["offset"] == entry.offset for x in f)
    for name in os.listdir(source):
        if name.endswith(".gz"):  # one stream before
            with gzip.open(f"{source}/{name}") as f:
                assert f.read().startswith(b"WARC/1.1") or os.path.getsize(f"{source}/{name}") < 40
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------


def test_parser_blocks():
    nodes, blocks = html_text.parse('<p><b>a<br>b <i>c</i><p>d&amp;e<ul><li>x<li>y</ul><script>var t="</p>";</script><!-- no --><div>f<div>g</div>h</div>')
    assert [t for _, t in blocks] == ["a b c", "d&e", "x", "y", "f", "g", "h"]
    assert [nodes[i].tag for i, _ in blocks] == ["p", "p", "li", "li", "div", "div", "div"]
    assert html_text.parse("") [1] == [] and html_text.parse("<") [1] == [(0, "<")]


def test_decoding_is_the_best_closed_set():
    rng = random.Random(1)
    for _ in range(60):
        nodes = [html_text.Node("#", -1, 0)]
        for i in range(1, 9):
            parent = rng.randrange(i)
            nodes.append(html_text.Node("div", parent, 0))
            nodes[parent].children.append(i)
        chances = [rng.uniform(0.05, 0.95) for _ in nodes[1:]]
        value = lambda kept: sum(math.log(p if k else 1 - p) for p, k in zip(chances, kept[1:]))
        closed = []
        for bits in range(256):
            kept = [True] + [bool(bits >> i & 1) for i in range(8)]
            if all(kept[nodes[i].parent] or not kept[i] for i in range(1, 9)):
                closed.append(kept)
        assert value(html_text.decode(nodes, chances)) == pytest.approx(max(map(value, closed)))


def test_main_text_of_held_out_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "plain"), (-4, "u", "<article>" * 3000 + "deep")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_pages(pages.unionByName(odd), sample=60).collect()}
    assert got[-1].text == got[-2].text == "" and got[-3].text == "plain" and got[-1].n_chars == 0
    same = 0
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        same += got[r.page_id].text == "\n\n".join(t for _, t in html_text.parse(inner)[1])
    assert same >= 0.97 * pages.count()
    assert html_text.extract_pages(odd.limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------


def test_preferences(spark):
    turns = "conv_id long, turn long, role string, text string, pos int"
    chosen = [(1, 0, "user", "q", 9), (1, 1, "assistant", "good", 9), (2, 0, "user", "same", 9), (None, 0, "user", "x", 9), (3, 0, None, None, 9)]
    rejected = [(1, 0, "user", "q", 9), (1, 1, "assistant", "bad one", 9), (2, 0, "user", "same", 9)]
    rows = preference.format_preferences(spark.createDataFrame(chosen, turns), spark.createDataFrame(rejected, turns)).collect()
    got = {(r.conv_id, r.part): r for r in rows}
    assert set(got) == {(1, "prompt"), (1, "chosen"), (1, "rejected"), (2, "prompt"), (3, "chosen")}
    assert got[1, "prompt"].rendered == "<|user|>\nq<|end|>\n" and got[1, "prompt"].train_start is None
    r = got[1, "rejected"]
    assert r.rendered[r.train_start : r.train_end] == "bad one<|end|>\n" and got[3, "chosen"].rendered.startswith("<|unknown|>")
    empty = spark.createDataFrame([], turns)
    assert preference.format_preferences(empty, empty).count() == 0


# --- 8 ---------------------------------------------------------------------


def test_language_sample_counts_copies_once(spark):
    once = spark.createDataFrame([(lang, f"{word} number {i}") for lang, word in (("en", "house"), ("fr", "maison")) for i in range(60)], "lang string, text string")
    copies = once.unionByName(spark.range(900).select(F.lit("en").alias("lang"), F.lit("house number 7").alias("text")))
    for sample in (5, 40, 1000):
        (names, table), (again, other) = langid.fit(once, "text", "lang", sample), langid.fit(copies, "text", "lang", sample)
        assert names == again == ["en", "fr"] and (table == other).all()



def test_language_is_fitted_on_all_distinct_texts(spark):
    import numpy as np
    import pyarrow as pa

    rows = [(lang, f"{word} number {i}") for lang, word in (("en", "house"), ("fr", "maison")) for i in range(1500)] + [("en", "house number 7")] * 30
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    names, logs = langid.fit(table, "text", "lang")
    want = np.full((langid.BUCKETS, 2), 0.5)
    for lang, text in set(rows):
        for _, buckets in langid._trigrams(pa.array([text])):
            want[:, names.index(lang)] += np.bincount(buckets, minlength=langid.BUCKETS)
    assert (logs == np.log(want / want.sum(axis=0)).astype(np.float32)).all()
    # What is typical: quantiles over all those texts, each without itself.
    _, _, smoothed, chosen = langid._fit(table, "text", "lang", None)
    usual, least = langid.typical(chosen, names, smoothed)
    for j, lang in enumerate(names):
        means, distinct = [], []
        for text in sorted(t for x, t in set(rows) if x == lang):
            n = sum(np.bincount(b, minlength=langid.BUCKETS) for _, b in langid._trigrams(pa.array([text])))
            rest, at = want[:, j] - n, np.flatnonzero(n)
            means.append((n[at] * np.log(rest[at] / rest.sum())).sum() / n.sum())
            distinct.append(len(at))
        means, distinct = np.array(means), np.array(distinct)
        assert abs(usual[j] - np.median(means)) < 0.002
        score = (distinct * means + langid.PRIOR * usual[j]) / (distinct + langid.PRIOR)
        assert abs(least[j] - (np.median(score) - max(langid.NATS, langid.QUARTILES * (np.median(score) - np.quantile(score, 0.25))))) < 0.01


def test_language_of_held_out_texts(spark, sample):
    rows = sample.withColumn("train", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = langid.identify(rows, declared=None, host=None, train="train", keep=("lang",)).where("doc_id % 2 = 1").collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got) and all(r.accepted for r in got)


def test_evidence_decides_for_texts_that_say_nothing(spark, sample):
    odd = spark.createDataFrame([(-1, "a", "fr", "fr-host"), (-2, None, "de", None), (-3, "123 !!", None, None)] + [(-10 - i, t.text, None, "fr-host") for i, t in enumerate(sample.where("lang = 'fr'").limit(20).collect())], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.identify(sample.select(odd.columns).unionByName(odd)).collect()}
    assert got[-1].language == "fr" and not got[-2].accepted and not got[-3].accepted and got[-10].language == "fr"
    none = langid.identify(odd.where("doc_id = -3")).collect()
    assert none[0].language is None and not none[0].accepted
    assert langid.identify(odd.limit(0)).count() == 0


def test_texts_of_no_fitted_language_are_unknown(spark, sample):
    rng = random.Random(2)
    made = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(120))
    strange = [made("bcdfghjklmnpqrstvwxz") for _ in range(5)] + [made("абвгдежзийклмнопрст")]
    rows = sample.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(-1 - i, t, None, "s") for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r.accepted for r in langid.identify(rows).collect()}
    assert not any(got[-1 - i] for i in range(6)) and sum(got.values()) >= 0.99 * (len(got) - 6)


def test_every_language_is_fitted(spark):
    tags = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghi"]  # 72
    word = lambda t, i: " ".join(f"{t}{t[::-1]}{t[0]}{t}" for _ in range(9)) + f" {t * 3}{i}"
    rows = [(100 * n + i, word(t, i), (t, t.upper(), f"{t}-XX")[i % 3]) for n, t in enumerate(tags) for i in range(3 if n > 65 else 4)]
    table = spark.createDataFrame(rows + [(-1, word("hi", 7), None), (-2, "hello there", "und")], "doc_id long, text string, lang string")
    names, _ = langid.fit(table.withColumn("lang", langid.primary(F.col("lang"))), "text", "lang")
    got = {r.doc_id: r.language for r in langid.identify(table, host=None).collect()}
    assert names == tags and got[-1] == "hi" and all(got[i] == lang[:2].lower() for i, _, lang in rows)


def test_lookup_of_frequent_and_rare_values(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, [float(i)]) for i in range(40)], "doc_id long, host string, logs array<double>")
    values = spark.createDataFrame([("a", 39, 1.0), ("b", 1, 2.0), ("c", 0, 3.0)], "host string, n long, host_log double")
    for total in (1, 20_000, 10**9):  # all frequent, one of them, none
        got = langid._looked_up(rows, values, "host", total).collect()
        assert sorted(r.doc_id for r in got) == list(range(40))
        assert all(r.host_log == {"a": 1.0, "b": 2.0, None: None}[r.host] for r in got)


def test_markup_and_suffix(spark):
    row = spark.range(1).select(langid.markup_language(F.lit('<!doctype html><HTML class=x lang="fr-CA">')).alias("m"), langid.address_suffix(F.lit("a.b.De:80")).alias("s"), langid.address_suffix(F.lit("src1")).alias("n")).first()
    assert tuple(row) == ("fr", "de", None)


# --- 9 ---------------------------------------------------------------------


def test_pieces_are_those_of_the_library(spark, sample):
    import sentencepiece

    odd = ["", " ", "  a  b\n\tc <s> é 日本語\x01 x ", " " * 40, "a" * 30, "\n\n \n x", "<0x0A> 12345 3.14", "𝔘𝔫𝔦", " " * 17 + "a", "a" + " " * 20 + "b", "x" * 5000]
    texts = [r.text for r in sample.collect()] + odd
    model = spm.read_model()
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    got = {r.doc_id: r for r in spm.tokenize(rows).collect()}
    assert [got[i].token_ids for i in range(len(texts))] == [processor.encode(t) for t in texts]
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got.values()) and got[-1].token_ids == []
    back = spm.tokenize(rows).select("text", spm.decode(F.col("token_ids"), model).alias("b")).collect()
    assert all((r.text or "") == r.b for r in back)
    strange = spark.createDataFrame([(None,), ([],), ([-1, None, 99999, 0, 1, 13],)], "ids array<int>").select(spm.decode(F.col("ids"), model).alias("t"))
    assert [r.t for r in strange.collect()] == ["", "", "⁇ \n"]


# --- 10 --------------------------------------------------------------------


def brute_model(texts):
    """Log probability of each position by the formulas, with plain dictionaries."""
    n = kneser.ORDER
    grams = {k: {} for k in range(1, n + 1)}
    data = [bytes([kneser.BEGIN]) * (n - 1) + t.encode() + bytes([kneser.END]) for t in texts]
    for d in data:
        for i in range(n - 1, len(d)):
            g = d[i - n + 1 : i + 1]
            grams[n][g] = grams[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    discounts = {}
    for k, counts in grams.items():
        n1, n2, n3, n4 = (sum(c == x for c in counts.values()) for x in (1, 2, 3, 4))
        if not n1 or not n2:
            raw = (0.5, 1.0, 1.5)
        else:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            raw = [min(max(d, 0.01), j - 0.01) for j, d in enumerate(raw, 1)]
        discounts[k] = raw

    def p(context, byte):
        k = len(context) + 1
        low = 1 / kneser.SYMBOLS if k == 1 else p(context[1:], byte)
        own = {g: c for g, c in grams[k].items() if g[:-1] == context}
        if not own:
            return low
        cut = lambda c: min(c, discounts[k][min(c, 3) - 1])
        c, total = own.get(context + byte, 0), sum(own.values())
        return ((c - cut(c)) if c else 0) / total + sum(map(cut, own.values())) / total * low

    def score(text):
        d = bytes([kneser.BEGIN]) * (n - 1) + text.encode() + bytes([kneser.END])
        return sum(math.log(p(d[i - n + 1 : i], d[i : i + 1])) for i in range(n - 1, len(d)))

    return score


@pytest.mark.parametrize("entries", [1 << 20, 60])
def test_perplexity_is_brute_force(spark, entries):
    texts = ["abracadabra abra", "a cadabra", "brabra ä", "dab dab dab", "abracadabra abra"]
    asked = texts[:2] + ["zzz abra", "", "dabra" * 30]
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").select("doc_id", F.lit("en").alias("language"), "text", F.struct(F.lit(0)).alias("kept"))
    got = {r.doc_id: r.total for r in kneser.log_perplexity(rows, model, entries).collect()}
    score = brute_model(texts)
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(score(t), rel=1e-9, abs=1e-9), t


def test_long_texts_are_cut_without_a_seam(monkeypatch):
    import numpy as np

    texts = ["abc" * 50, "", "x", "déf" * 40]
    whole = [(f, c.tolist(), s.tolist()) for f, c, s in kneser._grams(texts)]
    monkeypatch.setattr(kneser, "CHUNK", 16)
    cut = [(f, c, s) for f, c, s in kneser._grams(texts)]
    assert np.concatenate([c for _, c, _ in cut]).tolist() == [x for _, c, _ in whole for x in c]
    assert sum(len(c) for _, c, _ in cut) == sum(len(t.encode()) + 1 for t in texts)


def test_quality_rejects_junk_and_keeps_clean(spark, sample):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = kneser.judge(sample, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.toxic], [r for r in rows if r.quality == 0]
    assert sum(r.accepted for r in good) >= 0.98 * len(good) and sum(not r.accepted for r in bad) >= 0.5 * len(bad)
    odd = docs(spark, (1, None, None), (1, "", "xx"), (None, "a b", "en"))
    assert all(r.accepted for r in kneser.judge(odd, labels.limit(0)).collect())
    assert kneser.judge(docs(spark), labels).count() == 0


def test_quality_keeps_clean_texts_it_was_not_trained_on(spark):
    sf = SF.replace("0.001", "0.01")
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = kneser.judge(texts, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.toxic], [r for r in rows if r.quality == 0]
    assert sum(r.accepted for r in good) >= 0.95 * len(good) and sum(not r.accepted for r in bad) >= 0.9 * len(bad)
    with pytest.raises(ValueError):
        kneser.judge(texts, labels, held_out=1)


def test_words_are_cut_at_marks_and_line_feeds():
    import re

    import pyarrow as pa

    words, rnd = re.compile(f"{spm.BLANK}+[^{spm.BLANK}\n]*|\n+|[^{spm.BLANK}\n]+"), random.Random(3)
    for _ in range(500):
        texts = ["".join(rnd.choice(" \naé▁\0日▀") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(5))]
        found, ends = spm._words(pa.array(texts, pa.string()))
        found = found.to_pylist()
        assert [found[a:b] for a, b in zip(ends, ends[1:])] == [words.findall(spm.BLANK + t.replace(" ", spm.BLANK)) if t else [] for t in texts]
