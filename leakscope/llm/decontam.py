"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a window of tokens: it hashes the tokens at its ones and ignores
those at its zeros.  ``MASKS`` are such that within ``WINDOW`` tokens, whichever two are
substituted, some mask lies on tokens that all agree.  So every overlap of a training
text with a test item of that many tokens and at most two substitutions shares a hash with
it.  Around each shared hash the texts are aligned and the overlap is verified.

The test items are the stated query set: their hashes are sent in blocks of a bounded number of
tokens, one pass over the training texts a block.  Training texts are never shuffled, and only
verified overlaps leave a task.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship, stored

ship(__name__)

#: Tokens of an overlap, and substitutions among them.
WINDOW, SUBSTITUTIONS = 13, 2
#: Positions of the ones of each mask.  ``covers`` tests that they suffice.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Tokens of an item from which substitutions are allowed; shorter items are matched as they are.
LEAST = 8
#: For items of 8 to 12 tokens, with one substitution.
SHORT_MASKS = ((0, 1, 3, 4),)
#: Scripts that are written without spaces; a letter of them and its marks are a token.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}]"
#: Tokens of test items that are sent at once.
BLOCK = 1 << 20
#: Bytes of texts handled at once.
CHUNK = 1 << 21


def covers(masks: tuple = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> bool:
    """Whether for all places of the substitutions some mask fits into the window beside them."""
    from itertools import combinations

    places = [frozenset(s + p for p in m) for m in masks for s in range(window - max(m))]
    return all(any(not p & set(gone) for p in places) for gone in combinations(range(window), substitutions))


def tokens(texts: pa.Array) -> pa.Array:
    """Lists of lower-cased runs of letters, digits and marks; scripts without spaces are cut into letters."""
    import pyarrow as arrow
    import pyarrow.compute as compute

    clean = compute.replace_substring_regex(compute.utf8_lower(texts.cast(arrow.large_string())), r"[^\p{L}\p{N}\p{M}]+", " ")
    if compute.any(compute.match_substring_regex(clean, UNSPACED)).as_py():
        clean = compute.replace_substring_regex(clean, rf"({UNSPACED}\p{{M}}*)", r" \1 ")
        clean = compute.replace_substring_regex(clean, " +", " ")
    return compute.split_pattern(compute.utf8_trim(clean, " "), " ")


def _hashes(ids, mask):
    """Hash of each window of token numbers under a mask; windows with an unknown token (0) get 0."""
    import numpy as np

    n = len(ids) - max(mask)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for p in mask:
        part = ids[p : p + n]
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        known &= part > 0
    return np.where(known, out, np.uint64(0))


class Index:
    """Token numbers of a block of test items and their seed hashes, sorted for each mask."""

    def __init__(self, items: list[list[str]], window: int, least: int = LEAST):
        import numpy as np

        self.words = pa.array(sorted({w for item in items for w in item}), pa.large_string())
        number = {w: i + 1 for i, w in enumerate(self.words.to_pylist())}
        self.items = [np.array([number[w] for w in item], dtype=np.int64) for item in items]
        self.need = [min(window, len(item)) for item in items]
        self.least = least
        self.seeds = []
        whole = [(tuple(range(n)), n, n + 1) for n in sorted({len(item) for item in items if len(item) < least})]
        for mask, lo, hi in [(m, window, math.inf) for m in MASKS] + [(m, least, window) for m in SHORT_MASKS] + whole:
            found = [(_hashes(ids, mask), i) for i, ids in enumerate(self.items) if lo <= len(ids) < hi]
            code = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
            item = np.concatenate([np.full(len(h), i) for h, i in found] or [np.zeros(0, np.int64)])
            place = np.concatenate([np.arange(len(h)) for h, _ in found] or [np.zeros(0, np.int64)])
            order = np.argsort(code, kind="stable")
            self.seeds.append((mask, code[order], item[order], place[order]))

    def alignments(self, ids, starts):
        """Distinct (item, begin, text): a seed agrees in the text if the item's first token is put at ``begin``."""
        import numpy as np

        found = []
        for mask, code, item, place in self.seeds:
            own = _hashes(ids, mask)
            at = np.flatnonzero(own)
            low, high = np.searchsorted(code, own[at], "left"), np.searchsorted(code, own[at], "right")
            hit = np.flatnonzero(high > low)
            counts = (high - low)[hit]
            pos = np.repeat(at[hit], counts)
            entry = np.repeat(low[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            found.append(np.stack([item[entry], pos - place[entry], np.searchsorted(starts, pos, "right") - 1], axis=1))
        both = np.concatenate(found)
        return np.unique(both, axis=0) if len(both) else both

    def overlap(self, ids, item: int, begin: int, substitutions: int):
        """Longest verified stretch ``(first token of the item, tokens, equal tokens)`` of an alignment; None if none is long enough."""
        import numpy as np

        test = self.items[item]
        lo, hi = max(0, -begin), min(len(test), len(ids) - begin)
        need = self.need[item]
        if hi - lo < need:
            return None
        equal = (test[lo:hi] == ids[begin + lo : begin + hi]).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(equal)])
        allowed = substitutions if need >= WINDOW else int(need >= self.least)
        good = np.flatnonzero(sums[need:] - sums[:-need] >= need - allowed)
        if not len(good):
            return None
        runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
        longest = max(runs, key=len)
        a, b = int(longest[0]), int(longest[-1]) + need
        return lo + a, b - a, int(sums[b] - sums[a])


def overlaps(docs: DataFrame, tests: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", test: str = "text", least: int = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verified overlaps ``(id, item, start, tokens, equal)`` and ``keep``: one row for each alignment of a row with an item.

    ``start`` is the first token in the training text, ``tokens`` the length of the stretch, ``equal`` how many agree.
    An overlap has 13 tokens with at most two substitutions; an item of 8 to 12 must lie in the text as a
    whole, with at most one, and one of fewer than ``least`` (8 to 13) as a whole and unchanged; by ``tokens`` a caller can
    tell how much that proves.  Null texts have no tokens.  Repeated rows and items are reported each.
    """
    if not LEAST <= least <= WINDOW:
        raise ValueError(f"the masks cover items with a substitution from {LEAST} tokens on")
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("row_id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        import pyarrow as arrow

        return tokens(texts).cast(arrow.list_(arrow.string()))

    items = stored(tests.select(F.col(item).alias("item"), cut(F.col(test).cast("string")).alias("words")).where((F.size("words") > 0) & (F.col("words")[0] != "")), "items")
    whole = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-whole // BLOCK))
    out = None
    for i in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i).collect()
        names = [r["item"] for r in got]
        sent = spark.sparkContext.broadcast(Index([list(r["words"]) for r in got], WINDOW, least))
        part = _search(rows, sent, names, len(keep))
        out = part if out is None else out.unionByName(part)
    kinds = {"row_id": id, "item": item, **{f"keep_{i}": c for i, c in enumerate(keep)}}
    return out.select(*[F.col(c).alias(kinds.get(c, c)) for c in out.columns])


def _search(rows: DataFrame, sent, names: list, kept: int) -> DataFrame:
    kept_names = [f"keep_{i}" for i in range(kept)]

    def search(batches):
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute

        index = sent.value
        for batch in batches:
            at, found = 0, []
            texts = compute.fill_null(batch.column("text"), "")
            sizes = compute.binary_length(texts).to_numpy()
            while at < len(batch):
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
                words = tokens(texts[at:end])
                ends = np.concatenate([[0], np.cumsum(compute.list_value_length(words).to_numpy())])
                ids = compute.fill_null(compute.index_in(words.flatten(), index.words), -1).to_numpy().astype(np.int64) + 1
                # One search for all texts of the piece, with unknown tokens between them, so that no seed lies in two.
                starts = ends[:-1] + np.arange(end - at)
                gap = np.zeros(len(ids) + end - at, np.int64)
                gap[np.arange(len(ids)) + np.repeat(np.arange(end - at), np.diff(ends))] = ids
                for item, begin, t in index.alignments(gap, starts):
                    first = int(begin - starts[t])
                    hit = index.overlap(ids[ends[t] : ends[t + 1]], item, first, SUBSTITUTIONS)
                    if hit:
                        found.append((at + int(t), names[item], first + hit[0], hit[1], hit[2]))
                at = end
            if found:
                row, item, start, length, equal = zip(*found)
                own = batch.take(arrow.array(row))
                yield arrow.RecordBatch.from_arrays(
                    [own.column("row_id"), arrow.array(item, arrow.int64()), *[arrow.array(x, arrow.int32()) for x in (start, length, equal)], *[own.column(c) for c in kept_names]],
                    names=["row_id", "item", "start", "tokens", "equal", *kept_names],
                )

    kinds = dict(rows.dtypes)
    schema = f"row_id {kinds['row_id']}, item long, start int, tokens int, equal int" + "".join(f", {c} {kinds[c]}" for c in kept_names)
    return rows.mapInArrow(search, schema)
