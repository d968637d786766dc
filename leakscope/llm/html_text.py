"""Main text of html pages: boosted trees over the features of DOM nodes, decoded along the tree.

A page becomes a tree of its block elements.  Gradient-boosted trees (Spark ML) give each node the
probability that it holds main text, from its subtree's text, link and tag densities, the tokens of its
attributes, its depth and its place among its siblings.  The decoding keeps a node only if its parent is
kept: of all such choices the most probable one, found from the leaves up.  So nothing comes out of a
dropped ancestor, and a kept article can still lose an advert.

The trees are fitted on a bounded sample of pages (``sample``, 300 by default), put together anew: the paragraphs of
their articles and the lines of their menus, footers and adverts, each in an element that is drawn from lists of
usual wrappers.  So labels are known by construction, and layouts occur that the sample lacks.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship, text_or_empty

ship(__name__)

#: A comment, a declaration, or a tag.  Nothing is tried twice: quantifiers do not give back.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: The same where the quotes of a page do not pair up: a tag ends at the next sign.
PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
OPEN = re.compile(r"<(?=[!?/a-zA-Z])")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")

# Fixed values of html: elements with a block of their own, without an end, with raw content, and ends that a start implies.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg object head".split())
CLOSES_P = BLOCKS - frozenset("button caption label legend option tbody td tfoot th thead tr html body".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}

# Tokens of attributes that speak against or for main text.
AGAINST = frozenset(
    "ad ads adv advert advertisement banner bar bottom breadcrumb breadcrumbs button captcha combx comment comments consent contact cookie cookies copyright disqus disclaimer "
    "discussion extra feedback foot footer form gdpr head header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notification "
    "outbrain overlay pager pagination popup privacy promo promoted recommend recommended related remark replies reply respond rss search share shared sharing shoutbox sidebar "
    "sidebars signup site skip social sponsor sponsored subscribe tags toolbar tool top widget warning alert aside complementary contentinfo none".split()
)
FOR = frozenset("article articlebody blog body column content entry hentry main news page post story text".split())
KINDS = ("article main", "nav menu", "footer", "header", "aside", "form fieldset button select option label legend search dialog", "section", "div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl li dt dd", "table tbody thead tr td th", "html body")
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}
FEATURES = len(KINDS) + 22


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "against", "for_", "label", "text", "links", "tags", "words", "stops", "inputs", "paragraphs", "own")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth, self.children = tag, parent, depth, []
        self.against = self.for_ = self.text = self.links = self.tags = self.words = self.stops = self.inputs = self.paragraphs = self.own = 0
        self.label = None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (0 is the root) and the text blocks as (node, text).

    Text outside all elements lies in a body of its own, or in the root of a page without elements.  Each step looks at the top of a stack, so the time grows with the page
    alone, however its tags are nested or left open.
    """
    nodes, blocks = [Node("#", -1, 0)], []
    open_, run, links, at = ["#"], [], 0, 0  # open elements
    within: dict[str, list[int]] = defaultdict(list)  # tag -> its places among the open elements
    held = [(0, 0)]  # open blocks as (place among the open elements, node)
    loose, endless, pattern = 0, set(), TAG

    def flush() -> None:
        nonlocal loose
        if run:
            text = SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
            run.clear()
            if text:
                i = held[-1][1]
                if not i:
                    if not loose:
                        loose = len(nodes)
                        nodes[0].children.append(loose)
                        nodes.append(Node("body", 0, 1))
                    i = loose
                owner = nodes[i]
                blocks.append((i, text))
                owner.own += len(text)
                owner.words += text.count(" ") + 1
                owner.stops += sum(text.count(c) for c in ".,;:!?")

    def cut(to: int) -> None:
        nonlocal links
        while len(open_) > to:
            tag = open_.pop()
            within[tag].pop()
            links -= tag == "a"
        while held[-1][0] >= to:
            held.pop()

    def close(to: int) -> None:
        flush()
        cut(to)

    def place_of(tags: tuple) -> int:
        return max((within[t][-1] for t in tags if within[t]), default=0)

    def implied(tags: tuple, borders: tuple) -> None:
        i = place_of(tags)
        if i > place_of(borders):
            close(i)

    def put(tag: str, block: bool) -> None:
        within[tag].append(len(open_))
        if block:
            held.append((len(open_), len(nodes)))
        open_.append(tag)

    def say(text: str) -> None:
        if text:
            run.append(text)
            if links:
                nodes[held[-1][1]].links += len(text.strip())

    while True:
        start = OPEN.search(page, at)
        if not start:
            break
        m = pattern.match(page, start.start())
        if not m and pattern is TAG:  # a quote that nothing closes: from here on tags end at the next sign
            pattern = PLAIN
            m = pattern.match(page, start.start())
        if not m:
            if page.find(">", start.start()) < 0:
                break  # no tag ends any more
            say(page[at : start.end()])
            at = start.end()
            continue
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not within[tag]:
                if tag in BLOCKS:
                    flush()
            elif tag in BLOCKS:
                close(within[tag][-1])
            elif held[-1][0] > within[tag][-1]:
                pass  # the end of a phrase that a block was opened in: the block goes on
            else:
                cut(within[tag][-1])
            continue
        nodes[held[-1][1]].tags += 1
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I).search(page, at)
                to = page.find(">", end.end()) + 1 if end else 0
                if not to:
                    endless.add(tag)
                at = to or (len(page) if tag != "head" else at)
            run.append(" " if tag in ("svg", "object") else "")
            continue
        if tag in VOID and tag not in BLOCKS:
            if tag == "br":
                run.append("\n")
            if tag == "input":
                nodes[held[-1][1]].inputs += 1
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                implied(("p",), ("button", "td", "th", "table"))
            if tag in SIBLINGS:
                implied(tuple(SIBLINGS[tag][0].split()), SIBLINGS[tag][1])
            if tag == "hr":
                continue
            parent = held[-1][1]
            node = Node(tag, parent, nodes[parent].depth + 1)
            nodes[parent].children.append(len(nodes))
            for name, value in ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "data-label" and value.isdigit():
                    node.label = int(value)
                elif name in ("class", "id", "role", "itemprop", "aria-label", "style", "hidden"):
                    found = {*TOKEN.findall(value)} | ({"hidden"} if name == "hidden" else set())
                    node.against += len(found & AGAINST)
                    node.for_ += len(found & FOR)
            put(tag, True)
            nodes.append(node)
        else:
            put(tag, False)
            links += tag == "a"
    say(page[at:])
    close(1)
    if loose and len(nodes) == 2:  # nothing but text: it is the root's own
        body = nodes.pop()
        nodes[0].children.clear()
        nodes[0].own, nodes[0].words, nodes[0].stops = body.own, body.words, body.stops
        blocks = [(0, text) for _, text in blocks]
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        n = nodes[i]
        n.text += n.own
        n.paragraphs += n.tag == "p" and n.own > 0
        if i:
            p = nodes[n.parent]
            for name in ("text", "links", "tags", "words", "stops", "inputs", "paragraphs"):
                setattr(p, name, getattr(p, name) + getattr(n, name))
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[float]]:
    """One row of numbers a node; all but the root."""
    whole, out = nodes[0].text or 1, [None]
    above = [(0, 0)] * len(nodes)
    places, alike = [0] * len(nodes), [Counter(nodes[c].tag for c in n.children) for n in nodes]
    for n in nodes:
        for k, c in enumerate(n.children):
            places[c] = k
    for i, n in enumerate(nodes[1:], 1):
        p = nodes[n.parent]
        above[i] = (above[n.parent][0] + p.against, above[n.parent][1] + (p.tag in ("article", "main")))
        place, many, same = places[i], len(p.children), alike[n.parent][n.tag]
        kinds = [0.0] * len(KINDS)
        if n.tag in KIND:
            kinds[KIND[n.tag]] = 1.0
        text = n.text or 1
        out.append([
            *kinds, float(n.depth), math.log1p(n.text), n.text / whole, n.links / text, n.tags / text, n.stops / (n.words or 1), n.text / (n.words or 1),
            math.log1p(n.words), n.own / text, float(n.paragraphs), n.paragraphs / (nodes[0].paragraphs or 1), float(n.inputs), float(len(n.children)),
            place / many, many - 1.0 - place, float(many), same / many, n.text / (p.text or 1), float(n.against), float(n.for_), float(above[i][0]), float(above[i][1]),
        ])
    return out[1:]


def decode(nodes: list[Node], chances: list[float]) -> list[bool]:
    """Most probable set of kept nodes in which each kept node's parent is kept."""
    keep, drop = [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = min(max(chances[i - 1], 1e-6), 1 - 1e-6)
        keep[i] += math.log(p)
        drop[i] += math.log(1 - p)
        keep[nodes[i].parent] += max(keep[i], drop[i])
        drop[nodes[i].parent] += drop[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


# --- training pages -----------------------------------------------------------

# Wrappers of main text and of all else, as start tags.
MAIN = ("article", "main", "div class=content", "div class=post", "div id=article-body", "section class=entry-content", "div", "div class=story", "div role=main", "section")
OTHER = (
    "nav", "nav class=menu", "div class=navbar", "ul class=menu", "div id=header", "header", "div class=breadcrumbs", "footer", "div class=footer", "div id=site-footer", "aside",
    "aside class=sidebar", "div class=sidebar", "div id=sidebar", "div class=ad", "div class=ads", "div class=advert", "div class=sponsored", "section class=promo", "div class=banner",
    "div class=cookie-notice", "div id=cookie-consent", "div class=notice", "div role=alert", "form", "form class=newsletter", "form class=search", "div class=subscribe", "div class=login",
    "section class=comments", "div id=comments", "div class=comment", "ol class=comment-list", "div class=related", "section class=recommended", "div class=share", "div class=social",
    "div class=popup", "div class=widget", "div class=pagination", "div role=navigation", "div role=complementary", "div style=display:none", "div hidden",
)


def _compose(main: list[str], other: list[str], links: list[str], draw: random.Random) -> str:
    """A page of given paragraphs and lines in drawn wrappers; ``data-label`` holds the truth."""

    def wrapped(start: str, inner: str, label: int) -> str:
        tag, _, attribute = start.partition(" ")
        name, _, value = attribute.partition("=")
        return f'<{tag} data-label={label}{f" {name}" if name else ""}{f'="{value}"' if value else ""}>{inner}</{tag}>'

    def aside() -> str:
        start = draw.choice(OTHER)
        if start.split()[0] in ("nav", "ul") or draw.random() < 0.25:
            inner = "".join(f'<li><a href="/x">{x}</a></li>' for x in draw.sample(links, min(len(links), draw.randint(2, 6))))
            inner = inner if start.startswith("ul") else f"<ul>{inner}</ul>"
        else:
            inner = draw.choice(other) if other else "x"
            if draw.random() < 0.6:
                inner = "".join(f"<p>{inner}</p>" for _ in range(draw.randint(1, 4)))
            if draw.random() < 0.3:
                size = draw.randint(1, 4)
                inner = f"<h{size}>{draw.choice(other or links)[:30]}</h{size}>{inner if draw.random() < 0.7 else ''}"
            if start.startswith("form"):
                inner += "<label>x</label><input><button>ok</button>"
        return wrapped(start, inner, 0)

    body = []
    for x in main:
        kind = draw.random()
        body.append(f"<p>{x}</p>" if kind < 0.8 else f"<h2>{x[:60]}</h2><p>{x}</p>" if kind < 0.88 else f"<ul><li>{x[:80]}</li><li>{x}</li></ul>" if kind < 0.95 else f"<blockquote>{x}</blockquote>")
    if draw.random() < 0.7 and main:
        body.insert(0, f"<h1>{main[0][:60]}</h1>")
    if draw.random() < 0.3:
        body.insert(draw.randint(0, len(body)), aside())
    article = wrapped(draw.choice(MAIN), "".join(body), 1)
    before, after = [aside() for _ in range(draw.randint(0, 4))], [aside() for _ in range(draw.randint(0, 4))]
    middle = "".join([*before, article, *after])
    return f"<html><body>{f'<div class="{draw.choice(("page", "wrapper", "container"))}">{middle}</div>' if draw.random() < 0.4 else middle}</body></html>"


def _labelled(nodes: list[Node]) -> list[tuple[float, list[float]]]:
    """Features of all nodes with their label: its own, else its parent's; a wrapper of main text is kept."""
    label = [n.label for n in nodes]
    for i, n in enumerate(nodes[1:], 1):
        label[i] = n.label if n.label is not None else label[n.parent]
    for i in range(len(nodes) - 1, 0, -1):
        if label[i] == 1 and label[nodes[i].parent] is None:
            label[nodes[i].parent] = 1
    return [(float(label[i + 1] or 0), row) for i, row in enumerate(features(nodes))]


def training_rows(page: str, seed: int, variants: int) -> list[tuple[float, list[float]]]:
    """Labelled node features of pages composed from the parts of one.

    Main text is that of article and main elements.  A page without them lends its paragraphs of ten words and more that lie in
    nothing that speaks against them, and as such a guess is no truth about the page itself, only the composed pages are learned from.
    """
    nodes, blocks = parse(page)
    marked = any(n.tag in ("article", "main") for n in nodes)
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = n.tag in ("article", "main") or (n.parent >= 0 and inside[n.parent] and n.tag not in ("nav", "aside", "footer", "form") and not n.against)
    if not marked:
        bad = [n.against > 0 or n.tag in ("nav", "aside", "footer", "form", "header") for n in nodes]
        for i, n in enumerate(nodes[1:], 1):
            bad[i] = bad[i] or bad[n.parent]
            inside[i] = n.tag not in ("li", "a", "button", "label") and n.own > 0 and n.words >= 10 and n.links < n.text / 2 and not bad[i]
    main = [html_lib.escape(t) for i, t in blocks if inside[i]]
    other = [html_lib.escape(t) for i, t in blocks if not inside[i] and nodes[i].tag != "li"] or ["x x x"]
    links = [html_lib.escape(t) for i, t in blocks if not inside[i] and nodes[i].tag == "li"] or ["x", "y"]
    if not main:
        return []
    for i, n in enumerate(nodes):
        n.label = int(inside[i]) if inside[i] or n.tag not in ("#", "html", "body", "div") else None
    draw, out = random.Random(seed), _labelled(nodes) if marked else []
    for _ in range(variants):
        # Some pages get short articles, some get asides that are as long as articles.
        size = draw.random()
        part = main if size < 0.5 else main[: draw.randint(1, len(main))] if size < 0.7 else [draw.choice(main)[: draw.randint(20, 200)]]
        made, _ = parse(_compose(part, other + draw.sample(main, min(len(main), 2)), links, draw))
        out += _labelled(made)
    return out


def fit(pages: DataFrame, text: str = "html", sample: int = 300, variants: int = 6, rounds: int = 25, depth: int = 5) -> list:
    """Trees as nested tuples ``(feature, border, low, high)`` with numbers as leaves; weights are multiplied in.

    Fitted on the ``sample`` pages of lowest text hash that have an article or main element, or of all pages if none has;
    no trees if there is nothing to tell apart.
    """
    has = F.col(text).rlike(r"(?i)<(article|main)\b")
    known = pages.where(has)
    known = pages.where(F.col(text).isNotNull()) if known.isEmpty() else known
    chosen = known.select(F.col(text).alias("html"), F.xxhash64(text).alias("h")).orderBy("h").limit(sample)

    def rows(batches):
        import pyarrow as arrow

        for batch in batches:
            made = [r for page, h in zip(batch.column("html").to_pylist(), batch.column("h").to_pylist()) for r in training_rows(page, h, variants)]
            if made:
                labels, numbers = zip(*made)
                yield arrow.RecordBatch.from_pydict({"label": arrow.array(labels), "numbers": arrow.array(numbers, arrow.list_(arrow.float64()))})

    made = chosen.mapInArrow(rows, "label double, numbers array<double>").select("label", array_to_vector("numbers").alias("features")).persist()
    try:
        if made.agg(F.count_distinct("label")).first()[0] < 2:
            return []
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=1).fit(made)
        return [_tree(tree.toDebugString, weight) for tree, weight in zip(model.trees, model.treeWeights)]
    finally:
        made.unpersist()


def _tree(text: str, weight: float):
    lines = iter(line.strip() for line in text.splitlines()[1:] if line.strip())

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return weight * float(line.split(":")[1])
        feature, border = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        next(lines)  # Else
        return int(feature), float(border), low, node()

    return node()


def _raw(tree, x, out, rows) -> None:
    """Add the tree's value to ``out`` for the given rows."""
    if isinstance(tree, float):
        out[rows] += tree
    elif len(rows):
        feature, border, low, high = tree
        left = x[rows, feature] <= border
        _raw(low, x, out, rows[left])
        _raw(high, x, out, rows[~left])


def _texts(pages: list[str], trees: list) -> list[str]:
    import numpy as np

    parsed = [parse(p) for p in pages]
    rows = [features(nodes) for nodes, _ in parsed]
    x = np.array([r for page in rows for r in page], dtype=np.float64).reshape(-1, FEATURES)
    raw = np.zeros(len(x))
    for tree in trees:
        _raw(tree, x, raw, np.arange(len(x)))
    chances, at, out = (1 / (1 + np.exp(-2 * raw))).tolist() if trees else [1.0] * len(x), 0, []
    for (nodes, blocks), own in zip(parsed, rows):
        kept = decode(nodes, chances[at : at + len(own)])
        at += len(own)
        out.append("\n\n".join(text for node, text in blocks if kept[node]))
    return out


def main_text(page: Column, trees: list) -> Column:
    """Main text of an html page: its kept blocks, white space made one blank, joined by an empty line."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        import pyarrow as arrow

        out, cut, size = [], [], 0
        for page in pages:
            cut.append(page.as_py())
            size += len(cut[-1])
            if size > 1 << 20:
                out += _texts(cut, trees)
                cut, size = [], 0
        return arrow.array(out + _texts(cut, trees), arrow.string())

    return extract(text_or_empty(page))


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", **fitting) -> DataFrame:
    """One row for each page: id, url, ``text``, ``n_chars`` (code points).

    A null or empty page has an empty text.  Text outside all block elements lies in a body of its own.  A table that
    nothing can be learned from, as no page has both main text and something else, keeps all text.  Repeated rows stay.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(id, url, main_text(F.col(html), fit(pages, html, **fitting)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
