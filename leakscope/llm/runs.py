"""Periodic runs of words, by Lyndon roots.

Every run has, under one of the two orders of its words (one, or its reverse), a root that is the longest
Lyndon word at its first position.  So the operator needs, for each order, the length of the longest Lyndon
word at every position (the Lyndon array), and then extends each such root to both sides as far as its period
holds.

The Lyndon arrays come from the first phase of Baier's suffix sorter, run once an order: positions are grouped
by their first word, and groups are taken from the greatest to the least.  Each position of a group looks for
the nearest earlier position that is not taken yet, and the group's word sequence is appended to that of the
position found, which moves to a new group just above its own.  At the end, a position's group stands for its
longest Lyndon word.  Extensions are longest common extensions: names of blocks of 1, 2, 4, ... words, equal
exactly if the blocks are, are compared from the longest to the shortest for all roots at once.

A run of ``least`` words or more repeats, at the distance of its period, a stretch of half as many words at
least, and each of its words lies in such a stretch.  So only stretches of words whose half-length grams occur
twice in the same text go through the sorter; the others can hold no part of a run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship

ship(__name__)

#: Bytes of texts handled at once; a longer text is handled alone.
CHUNK = 1 << 21
#: The six blanks between words.
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(texts):
    """Distinct words, number of the word at each place, and bounds of each text; null texts have no words."""
    import numpy as np
    import pyarrow as arrow
    import pyarrow.compute as compute

    parts = compute.ascii_split_whitespace(compute.fill_null(texts.cast(arrow.large_string()), ""))
    ends = np.concatenate([[0], np.cumsum(compute.list_value_length(parts).to_numpy())])
    coded = parts.flatten().dictionary_encode()
    ids, empty = coded.indices.to_numpy().astype(np.int64), compute.index(coded.dictionary, "").as_py()
    if empty >= 0:  # blanks at either end leave empty words
        real = ids != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        ids = ids[real]
    return coded.dictionary, ids, ends


def repeated(ids, ends, size: int):
    """Whether a place lies in a gram of ``size`` words that occurs twice in its text (by hash: some more may)."""
    import numpy as np

    n = len(ids) - size + 1
    inside = np.zeros(len(ids) + 1, np.int64)
    if n > 0:
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends)).astype(np.uint64)
        code = text[:n] * np.uint64(0xD6E8FEB86659FD93)
        mixed = (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        for k in range(size):
            code = (code ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
            code ^= code >> np.uint64(31)
        places = np.flatnonzero(text[:n] == text[size - 1 :])
        order = places[np.argsort(code[places], kind="stable")]
        same = code[order][1:] == code[order][:-1]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + size, -1)
    return np.cumsum(inside)[:-1] > 0


def lyndon_lengths(symbols) -> list[int]:
    """Length of the longest Lyndon word at each place; 0 is a separator that no word crosses, and stands first."""
    import numpy as np

    found, first = np.unique(np.sort(symbols), return_index=True)
    places = np.argsort(symbols, kind="stable").tolist()
    bounds = [*first.tolist(), len(places)]
    members = [places[a:b] for a, b in zip(bounds, bounds[1:])]  # a group's places in the order of the text
    n = len(members)
    group = np.searchsorted(found, symbols).tolist()
    length, below, above = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
    before = [-1] * len(places)  # of places taken: the nearest earlier place that was not
    current = n - 1
    while current > 0:  # the lowest group holds the separators
        met, times, last = [], [], -1
        for place in members[current]:
            if group[place] != current:
                continue
            earlier = place - 1
            while (back := before[earlier]) >= 0:
                earlier = back
            before[place] = earlier
            if earlier == last:
                times[-1] += 1
            else:
                met.append(earlier)
                times.append(1)
                last = earlier
        if met:
            size, moved = length[current], {}
            for place, count in zip(met, times):
                if group[place]:
                    moved.setdefault((count, group[place]), []).append(place)
            for count, old in sorted(moved, reverse=True):  # the more often appended, the greater
                new, upper = len(members), above[old]
                members.append(moved[count, old])
                length.append(length[old] + count * size)
                below.append(old)
                above.append(upper)
                above[old] = below[upper] = new
                for place in members[new]:
                    group[place] = new
        members[current] = ()
        current = below[current]
    return [length[g] for g in group]


class Extensions:
    """Longest common extensions within a sequence whose separators differ from all else."""

    def __init__(self, names, longest: int):
        import numpy as np

        self.levels = [names]
        while 2 << (len(self.levels) - 1) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            second = np.full(len(last), -1, np.int64)  # beyond the end: the block holds the last separator anyway
            second[: max(0, len(last) - half)] = last[half:]
            order = np.lexsort((second, last))
            new = (np.diff(last[order], prepend=-1) != 0) | (np.diff(second[order], prepend=-2) != 0)
            named = np.empty(len(last), np.int64)
            named[order] = np.cumsum(new)
            self.levels.append(named)

    def right(self, i, j):
        """Number of equal words from ``i`` and from ``j`` on."""
        import numpy as np

        i, j, n = i.copy(), j.copy(), len(self.levels[0])
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][np.minimum(i, n - 1)] == self.levels[k][np.minimum(j, n - 1)]
            i += same << k
            j += same << k
        return i - start

    def left(self, i, j):
        """Number of equal words before ``i`` and before ``j``."""
        import numpy as np

        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = (i >= 1 << k) & (self.levels[k][np.maximum(i - (1 << k), 0)] == self.levels[k][np.maximum(j - (1 << k), 0)])
            i -= same << k
            j -= same << k
        return start - i


def runs_of(ids, ends, least: int):
    """Runs ``(first place, length, period)`` in all texts, by place, then period."""
    import numpy as np

    inside = repeated(ids, ends, max(1, (least + 1) // 2))
    edge = np.zeros(len(ids) + 1, bool)
    edge[ends] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = stops - begins >= least
    begins, sizes = begins[long], (stops - begins)[long]
    if not len(begins):
        return np.zeros((0, 3), np.int64)
    # Stretches one after the other, with a separator before each and after the last.
    starts = np.cumsum(sizes + 1) - sizes
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)) + 1, sizes)
    origin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
    _, own = np.unique(ids[origin], return_inverse=True)
    symbols = np.zeros(sizes.sum() + len(sizes) + 1, np.int64)
    symbols[at] = own + 1
    top = int(own.max()) + 2
    names = symbols.copy()
    separators = np.concatenate([starts - 1, [len(symbols) - 1]])
    names[separators] = top + np.arange(len(separators))
    extend, found = Extensions(names, int(sizes.max())), []
    for order in (symbols, np.where(symbols > 0, top - symbols, 0)):
        period = np.array(lyndon_lengths(order), np.int64)[at]
        left, right = extend.left(at, at + period), extend.right(at, at + period)
        length = left + period + right
        good = length >= np.maximum(least, 2 * period)
        found.append(np.stack([(at - left)[good], length[good], period[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    stretch = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] += begins[stretch] - starts[stretch]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(text: Column, least: int = 12) -> Column:
    """Struct of the text's ``runs`` (array of ``start, length, period`` in words, by start, then period), ``n_words`` and ``collapsed``.

    A run is a stretch of words with smallest period q and of at least max(``least``, 2 q) words that no neighbouring
    word extends.  ``collapsed`` is the text without the words that any run holds after its first period, joined by one space.
    Null, empty and blank texts have no words, no runs and an empty ``collapsed``.  Whole texts are searched,
    in memory that grows with the longest text of a batch.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    @F.arrow_udf("struct<runs:array<struct<start:long,length:long,period:long>>,n_words:long,collapsed:string>")
    def search(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute

        sizes, at, out = compute.fill_null(compute.binary_length(texts), 0).to_numpy(), 0, []
        while at < len(texts):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
            words, ids, ends = words_of(texts[at:end])
            runs = runs_of(ids, ends, least)
            text_of = np.searchsorted(ends, runs[:, 0], "right") - 1
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
            rest = words.take(arrow.array(ids[kept])).cast(arrow.string())
            collapsed = compute.binary_join(arrow.ListArray.from_arrays(np.searchsorted(kept, ends).astype(np.int32), rest), " ")
            fields = [arrow.array(runs[:, 0] - ends[text_of]), arrow.array(runs[:, 1]), arrow.array(runs[:, 2])]
            rows = arrow.StructArray.from_arrays(fields, names=["start", "length", "period"])
            bounds = np.searchsorted(text_of, np.arange(end - at + 1)).astype(np.int32)
            lists = arrow.ListArray.from_arrays(bounds, rows)
            out.append(arrow.StructArray.from_arrays([lists, arrow.array(np.diff(ends)), collapsed], names=["runs", "n_words", "collapsed"]))
            at = end
        return arrow.concat_arrays(out) if out else arrow.array([], type=kind)

    kind = pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("n_words", pa.int64()), ("collapsed", pa.string())])
    return search(text.cast("string"))


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, ``runs``, ``n_words``, ``collapsed``, then ``keep``; see ``periodic_runs``.

    Rows stay where they are; null ids and repeated rows are rows like others.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("row_id"), F.struct(F.lit(0), *keep).alias("kept"), periodic_runs(F.col(text), least).alias("found"))
    return rows.select(F.col("row_id").alias(id), "found.runs", "found.n_words", "found.collapsed", *[F.col("kept")[c].alias(c) for c in keep])


def with_cycles(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which one in ten documents, by the checksum of its id, repeats a stretch from some word on to its end.

    Rows without an id, and texts without words, are left as they are.
    """
    names = docs.columns
    checksum = F.crc32(F.col(id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")
    rows = docs.select("*", F.floor(checksum / 10).alias("_g"), F.when(checksum % 10 == 0, words).alias("_words"))
    n = F.size("_words").cast("long")
    rows = rows.select("*", n.alias("_n")).select("*", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).alias("_a"))
    rows = rows.select("*", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).alias("_p"))
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", source(i).cast("int")))
    changed = F.when(F.col("_n") > 0, F.array_join(turned, " ")).otherwise(F.col(text))
    return rows.select(*[changed.alias(c) if c == text else F.col(c) for c in names])


def digests(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Numbers and checksums of the rows of ``find_runs``: count, the longest run, all runs, the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select(id, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        id, "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / (-F.col("best.short"))).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same rows by pairs of equal half-length grams; the minimal period of a stretch is the least one that it has.
SQL = r"""
WITH ids AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS name,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sums AS (
  SELECT rid, doc_id, w, len(w) AS n, CASE WHEN name IS NULL THEN NULL ELSE xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ord(substr(name, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) END AS h
  FROM ids
), cycles AS (
  SELECT rid, doc_id, w, n, h, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS k FROM sums
), texts AS (
  SELECT rid, doc_id, n, list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) AS w FROM cycles
), grams AS (
  SELECT rid, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM (SELECT rid, w, unnest(range(n - 5)) AS i FROM texts WHERE n > 5)
), pairs AS (
  SELECT a.rid, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i
), islands AS (
  SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT rid, i, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island
), runs AS (
  SELECT rid, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY rid, start, length
), per_text AS (
  SELECT rid, count(*) AS n_runs, arg_max(start, (length, -start, -period)) AS start, max(length) AS length,
    arg_max(period, (length, -start, -period)) AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    list({'a': start + period, 'b': start + length}) AS spans
  FROM runs GROUP BY rid
), collapsed AS (
  SELECT rid, array_to_string(list_transform(list_filter(range(n), lambda i: len(list_filter(spans, lambda s: s.a <= i AND i < s.b)) = 0), lambda i: w[i + 1]), ' ') AS kept
  FROM texts JOIN per_text USING (rid)
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM texts LEFT JOIN per_text USING (rid) LEFT JOIN collapsed USING (rid)
"""
