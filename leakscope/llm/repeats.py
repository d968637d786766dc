"""Repeated passages by prefix-partitioned suffix trees.

The suffixes of all texts, word by word, are sorted in groups that fit into memory.  Suffixes that agree in
their first ``least`` words must meet in a group, so a group is given by a prefix: that of the suffix's anchor,
the 8-gram of lowest hash among its first ``least`` words, which equal suffixes share with its place.
Neighbouring suffixes mostly have the same anchor, so one record of their common words carries all of them.
Where an anchor has more records than a group may hold, its prefix is extended to all ``least`` words.  Small
prefixes share a group.

1. Texts are packed into chunks, which are stored.
2. Each chunk counts its anchors; the counts are added up by anchor.  Suffixes whose anchor occurs once have no
   partner and need no tree.
3. Each chunk deals out the records of the others.  Equal records of a chunk go once, with the least id.
4. Each group sorts its suffixes into the leaves of a suffix tree.  Depths of common prefixes of neighbours
   bound its internal nodes; each node of depth ``least`` or more is a repeat, known by its words and not by a
   hash, with the least id among its leaves.  Leaves of larger ids go back to their chunks as word numbers.
5. Each chunk joins repeats that overlap in a text into maximal spans.

Texts are shuffled packed, and only to meet the flags of their chunk.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ship, stored
from .runs import words_of

ship(__name__)

#: Words of an anchor.
ANCHOR = 8
#: Bytes of the texts of a chunk; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Anchors that are counted together, and records of a group.
COUNTED, GROUP = 1 << 21, 1 << 16
#: Number that stands for a null id: such texts come last.
LAST = 2**63 - 1


def pack(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(chunk, ids, sizes, texts, words)``: ids, bytes and compressed texts of a chunk, and its number of words."""

    def packed(batches):
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute
        from pyspark import TaskContext

        first, held, room, made = TaskContext.get().partitionId() << 32, [], CHUNK, 0

        def chunk():
            ids, texts = (arrow.concat_arrays(x) for x in zip(*held))
            sizes = compute.binary_length(texts).to_numpy()
            data = "".join(texts.to_pylist()).encode("utf-8", "surrogatepass")
            return arrow.RecordBatch.from_pydict({
                "chunk": arrow.array([first + made]),
                "ids": arrow.ListArray.from_arrays(arrow.array([0, len(ids)], arrow.int32()), ids),
                "sizes": arrow.ListArray.from_arrays(arrow.array([0, len(ids)], arrow.int32()), arrow.array(sizes.astype(np.int64))),
                "texts": arrow.array([arrow.compress(data, "zstd", asbytes=True)], arrow.binary()),
                "words": arrow.array([int(words_of(texts)[2][-1])], arrow.int64()),
            })

        for batch in batches:
            at, texts = 0, compute.fill_null(batch.column("text"), "")
            sizes = np.cumsum(compute.binary_length(texts).to_numpy(), dtype=np.int64)
            while at < len(batch):
                done = int(sizes[at - 1]) if at else 0
                end = max(int(np.searchsorted(sizes, done + room, "right")), at + (not held))
                if end > at:
                    held.append((batch.column("id")[at:end], texts[at:end]))
                    room -= int(sizes[end - 1]) - done
                at = end
                if at < len(batch):
                    yield chunk()
                    held, room, made = [], CHUNK, made + 1
        if held:
            yield chunk()

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(packed, "chunk long, ids array<long>, sizes array<long>, texts binary, words long")


class Chunk:
    """The words of a chunk: distinct ones, the number of the one at each place, bounds of the texts, their ids."""

    def __init__(self, row: dict):
        import numpy as np
        import pyarrow as arrow

        sizes = np.array(row["sizes"], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = arrow.decompress(row["texts"], int(ends[-1]), "zstd")
        texts = arrow.LargeStringArray.from_buffers(len(sizes), arrow.py_buffer(ends), data)
        self.given = row["ids"]
        self.ids = np.array([LAST if i is None else i for i in self.given], dtype=np.int64)
        self.words, self.at, self.ends = words_of(texts)
        self.text = np.repeat(np.arange(len(sizes)), np.diff(self.ends))

    def hashes(self):
        """64-bit hash of the word at each place."""
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        own = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in self.words.to_pylist()), np.uint64, len(self.words))
        return own[self.at]

    def windows(self, least: int):
        """Places at which ``least`` words of a text begin, the place of the anchor of each, and the anchor's hash."""
        import numpy as np

        size = min(ANCHOR, least)
        span, m = least - size + 1, len(self.at) - least + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        codes = sequence_hash(self.hashes(), np.arange(len(self.at) - size + 1), size)
        bits = np.uint64((span - 1).bit_length())
        best = np.full(m, 2**64 - 1, np.uint64)
        for k in range(span):  # the first of equal ones: its place is in the lowest bits
            np.minimum(best, (codes[k : k + m] >> bits << bits) | np.uint64(k), out=best)
        places = np.flatnonzero(self.text[:m] == self.text[least - 1 :])
        anchors = places + (best[places] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        return places, anchors, codes[anchors]


def sequence_hash(hashes, starts, size: int):
    """64-bit hash of the ``size`` words from each start on."""
    import numpy as np

    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out = (out ^ hashes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _anchor_codes(anchors, codes):
    """Hashes of the anchors, each once, in order, and the number of places of each."""
    import numpy as np

    _, first = np.unique(anchors, return_index=True)
    return np.unique(codes[first], return_counts=True)


def _short(codes, bits: int):
    """The part (highest bits) and the 32 bits after it."""
    import numpy as np

    return (codes >> np.uint64(64 - bits)).astype(np.int64), (codes >> np.uint64(32 - bits)).astype(np.uint32)


def count_anchors(chunks: DataFrame, least: int, bits: int) -> DataFrame:
    """``(chunk, part, flags, records)``: which anchors of a chunk, in order, occur more than once in all.

    Rows of a null chunk hold the anchors with more than ``GROUP`` records, cut to their highest ``32 + bits`` bits.
    """

    def count(batches):
        import numpy as np
        import pyarrow as arrow

        for batch in batches:
            for row in batch.to_pylist():
                _, anchors, codes = Chunk(row).windows(least)
                codes, counts = _anchor_codes(anchors, codes)
                part, key = _short(codes, bits)
                parts, first = np.unique(part, return_index=True)
                bounds = [*first.tolist(), len(part)]
                counts = np.minimum(counts, 65535).astype(np.uint16)
                yield arrow.RecordBatch.from_pydict({
                    "chunk": arrow.array([row["chunk"]] * len(parts), arrow.int64()),
                    "part": arrow.array(parts, arrow.int64()),
                    "keys": arrow.array([key[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], arrow.binary()),
                    "counts": arrow.array([counts[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], arrow.binary()),
                })

    def add(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as arrow

        chunk, blobs = table["chunk"].to_pylist(), [np.frombuffer(b, np.uint32) for b in table["keys"].to_pylist()]
        keys = np.concatenate(blobs)
        counts = np.concatenate([np.frombuffer(b, np.uint16) for b in table["counts"].to_pylist()])
        own, place = np.unique(keys, return_inverse=True)
        whole = np.bincount(place, weights=counts).astype(np.int64)
        flags, ends = whole[place] > 1, np.cumsum([0] + [len(b) for b in blobs])
        part = table["part"][0].as_py()
        often = (np.uint64(part) << np.uint64(32)) | own[whole > GROUP].astype(np.uint64)
        packed = [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
        records = int(whole[whole > 1].sum())
        return arrow.table({
            "chunk": arrow.array([*chunk, None], arrow.int64()), "part": arrow.array([part] * (len(chunk) + 1), arrow.int64()),
            "flags": arrow.array([*packed, often.tobytes()], arrow.binary()), "records": arrow.array([0] * len(chunk) + [records], arrow.int64()),
        })

    counted = chunks.mapInArrow(count, "chunk long, part long, keys binary, counts binary")
    return counted.groupBy("part").applyInArrow(add, "chunk long, part long, flags binary, records long")


def deal(chunks: DataFrame, least: int, bits: int, groups: int, often) -> DataFrame:
    """Records of suffixes that may have a partner, by group: words, least id, number of suffixes, places in the chunk.

    ``chunks`` have ``flags``.  A row without texts holds the places that equal records of the same chunk settle.
    """

    def split(batches):
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute

        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                places, anchors, codes = chunk.windows(least)
                own, _ = _anchor_codes(anchors, codes)
                ends = np.searchsorted(_short(own, bits)[0], np.arange((1 << bits) + 1))
                open_ = np.zeros(len(own), bool)
                for f in row["flags"] or []:
                    a, b = ends[f["part"]], ends[f["part"] + 1]
                    open_[a:b] = np.unpackbits(np.frombuffer(f["flags"], np.uint8), count=b - a)
                live = open_[np.searchsorted(own, codes)] if len(own) else np.zeros(0, bool)
                places, anchors, codes = places[live], anchors[live], codes[live]
                if not len(places):
                    continue
                alone = np.isin(codes >> np.uint64(32 - bits), often.value)
                begins = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]) | alone)
                start, size = places[begins], np.diff(np.append(begins, len(places)))
                code = codes[begins]
                if alone.any():
                    code[alone[begins]] = sequence_hash(chunk.hashes(), start[alone[begins]], least)
                # Equal records: one goes, with the least id; texts of larger ids are settled here.
                width = int(size.max()) + least - 1
                at = start[:, None] + np.arange(width)
                inside = np.arange(width) < (size + least - 1)[:, None]
                matrix = np.where(inside, chunk.at[np.minimum(at, len(chunk.at) - 1)], -1).astype(np.int32)
                order, leaf = _sorted_rows(matrix)
                owner = chunk.ids[chunk.text[start]]
                bounds = np.flatnonzero(np.diff(leaf, prepend=-1))
                smallest = np.minimum.reduceat(owner[order], bounds)
                later = owner[order] > smallest[leaf]
                settled = _places(start[order[later]], size[order[later]])
                first = order[~later]
                _, lead = np.unique(leaf[~later], return_index=True)
                times = np.diff(np.append(lead, len(first)))
                record = first[lead]
                group = ((code[record] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
                by = np.argsort(group, kind="stable")
                starts = np.repeat(lead[by], times[by])
                nth = np.arange(len(starts)) - np.repeat(np.cumsum(times[by]) - times[by], times[by])
                where, record, times, group = start[first[starts + nth]], record[by], times[by], group[by]
                length = size[record] + least - 1
                flat = np.repeat(start[record] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                words = chunk.words.take(arrow.array(chunk.at[flat])).cast(arrow.string())
                lines = compute.binary_join(arrow.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), words), " ")
                found, cut = np.unique(group, return_index=True)
                cut = np.append(cut, len(group))
                pages = compute.binary_join(arrow.ListArray.from_arrays(cut.astype(np.int32), lines), "\n").to_pylist()
                cuts, until = list(zip(cut[:-1], cut[1:])), np.append(0, np.cumsum(times))
                yield arrow.RecordBatch.from_pydict({
                    "group": arrow.array([*found, row["chunk"] % groups], arrow.int64()),
                    "chunk": arrow.array([row["chunk"]] * (len(found) + 1), arrow.int64()),
                    "bytes": arrow.array([*(len(p.encode()) for p in pages), 0], arrow.int64()),
                    "texts": arrow.array([*(arrow.compress(p.encode(), "zstd", asbytes=True) for p in pages), None], arrow.binary()),
                    "ids": arrow.array([*(owner[record[a:b]].tobytes() for a, b in cuts), b""], arrow.binary()),
                    "sizes": arrow.array([*(size[record[a:b]].astype(np.int32).tobytes() for a, b in cuts), b""], arrow.binary()),
                    "times": arrow.array([*(times[a:b].astype(np.int32).tobytes() for a, b in cuts), b""], arrow.binary()),
                    "places": arrow.array([*(where[until[a] : until[b]].astype(np.int32).tobytes() for a, b in cuts), settled.astype(np.int32).tobytes()], arrow.binary()),
                })

    return chunks.mapInArrow(split, "group long, chunk long, bytes long, texts binary, ids binary, sizes binary, times binary, places binary")


def _sorted_rows(matrix):
    """Order of the rows of numbers, from the first column on, and for each row in order the number of its class."""
    import numpy as np

    base, per = int(matrix.max()) + 2, 1
    while base ** (per + 1) < 2**62:
        per += 1
    keys = []
    for at in range(0, matrix.shape[1], per):  # several numbers to a key
        key = np.zeros(len(matrix), np.int64)
        for column in range(at, min(at + per, matrix.shape[1])):
            key = key * base + (matrix[:, column] + 1)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(matrix), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.cumsum(new)


def _places(starts, sizes):
    """All places from each start on."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def grow_trees(records: DataFrame, least: int) -> DataFrame:
    """``(chunk, places)`` of the suffixes whose first ``least`` words are a node with a leaf of a smaller id."""

    def grow(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute

        rows = table.to_pylist()
        trees = [r for r in rows if r["texts"] is not None]
        out = [(r["chunk"], r["places"]) for r in rows if r["texts"] is None and r["places"]]
        if trees:
            lines = arrow.array([x for r in trees for x in arrow.decompress(r["texts"], r["bytes"], "zstd", asbytes=True).decode().split("\n")], arrow.large_string())
            parts = compute.split_pattern(lines, " ")
            starts = parts.offsets.to_numpy()[:-1]
            at = parts.flatten().dictionary_encode().indices.to_numpy()
            of = {c: np.concatenate([np.frombuffer(r[c], kind) for r in trees]) for c, kind in (("ids", np.int64), ("sizes", np.int32), ("times", np.int32))}
            # Leaves: the suffixes of all records, by their words.
            suffix = _places(starts, of["sizes"])
            record = np.repeat(np.arange(len(starts)), of["sizes"])
            order, node = _sorted_rows(at[suffix[:, None] + np.arange(least)])
            owner = of["ids"][record]
            bounds = np.flatnonzero(np.diff(node, prepend=-1))
            smallest = np.minimum.reduceat(owner[order], bounds)
            gone = np.zeros(len(suffix), bool)
            gone[order] = owner[order] > smallest[node]
            # Back to every place of the records.
            until = np.append(0, np.cumsum([len(r["ids"]) // 8 for r in trees]))
            for r, a, b in zip(trees, until[:-1], until[1:]):
                own = _between(gone, record, a, b)
                if not len(own):
                    continue
                places, times = np.frombuffer(r["places"], np.int32).astype(np.int64), of["times"][a:b]
                first = (np.cumsum(times) - times)[record[own] - a]
                number = times[record[own] - a]
                which = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
                shift = np.repeat(suffix[own] - starts[record[own]], number)
                out.append((r["chunk"], np.sort(places[which] + shift).astype(np.int32).tobytes()))
        chunk, places = zip(*out) if out else ((), ())
        return arrow.table({"chunk": arrow.array(chunk, arrow.int64()), "places": arrow.array(places, arrow.binary())})

    return records.groupBy("group").applyInArrow(grow, "chunk long, places binary")


def _between(gone, record, a, b):
    """Places where ``gone`` holds among those of records a to b; records are in order."""
    import numpy as np

    lo, hi = np.searchsorted(record, (a, b))
    return lo + np.flatnonzero(gone[lo:hi])


def _kept(chunks: DataFrame, least: int) -> DataFrame:
    """One row a text: ``(id, n_words, n_removed, repeats, kept)``; ``chunks`` have ``found``, lists of places."""

    def cut(batches):
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as compute

        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                edges = np.zeros(len(chunk.at) + 1, np.int64)
                for places in row["found"] or []:
                    places = np.frombuffer(places, np.int32)
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + least, -1)
                gone = np.cumsum(edges)[:-1] > 0
                border = np.zeros(len(gone) + 1, bool)
                border[chunk.ends] = True
                begins = np.flatnonzero(gone & (border[:-1] | ~np.concatenate([[False], gone[:-1]])))
                stops = np.flatnonzero(gone & (border[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
                of = chunk.text[begins]
                fields = [arrow.array(begins - chunk.ends[of]), arrow.array(stops - begins)]
                spans = arrow.StructArray.from_arrays(fields, names=["start", "length"])
                rest = np.flatnonzero(~gone)
                words = chunk.words.take(arrow.array(chunk.at[rest])).cast(arrow.string())
                yield arrow.RecordBatch.from_pydict({
                    "id": arrow.array(chunk.given, arrow.int64()),
                    "n_words": arrow.array(np.diff(chunk.ends)),
                    "n_removed": arrow.array(np.diff(np.append(0, np.cumsum(gone))[chunk.ends])),
                    "repeats": arrow.ListArray.from_arrays(np.searchsorted(of, np.arange(len(chunk.given) + 1)).astype(np.int32), spans),
                    "kept": compute.binary_join(arrow.ListArray.from_arrays(np.searchsorted(rest, chunk.ends).astype(np.int32), words), " "),
                })

    return chunks.mapInArrow(cut, "id long, n_words long, n_removed long, repeats array<struct<start:long,length:long>>, kept string")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 13) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``n_removed``, ``repeats``, ``kept``.

    A stretch of ``least`` words (runs of other than the six ASCII blanks, unchanged) is repeated if the same words also
    begin in a text of a smaller id.  ``repeats`` are the maximal spans ``(start, length)`` of words that such stretches
    cover, judged on the input, and ``kept`` the other words, joined by one space.  Ids are long; a null id is larger than any,
    and rows of one id, or of none, repeat nothing of each other.  Null texts have no words.  A text is never split, so memory
    grows with the longest.
    """
    if not 2 <= least <= 4096:
        raise ValueError("least must be 2 to 4096 words")
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    chunks = stored(pack(docs, id, text), "chunks")
    words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = max(1, (-(-words // (3 * COUNTED))).bit_length())  # about one word in three is an anchor
    counts = stored(count_anchors(chunks, least, bits), "anchors")
    totals = counts.where("chunk is null")
    groups = max(1, -(-(totals.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]) // GROUP))
    import numpy as np

    # At most one for each GROUP records of the corpus.
    often = spark.sparkContext.broadcast(np.frombuffer(b"".join(bytes(r["flags"]) for r in totals.where("length(flags) > 0").select("flags").collect()), np.uint64))
    flags = counts.where("chunk is not null").groupBy(F.col("chunk").alias("at")).agg(F.collect_list(F.struct("part", "flags")).alias("flags"))
    records = deal(chunks.join(flags, F.col("chunk") == F.col("at"), "left").drop("at"), least, bits, groups, often)
    gone = stored(grow_trees(records, least), "repeats")
    often.destroy()
    found = gone.groupBy(F.col("chunk").alias("at")).agg(F.collect_list("places").alias("found"))
    out = _kept(chunks.join(found, F.col("chunk") == F.col("at"), "left").drop("at"), least)
    return out.withColumnRenamed("id", id)


#: The same rows by joining all stretches.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), stretches AS (
  SELECT rid, doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(len(w) - 12)) AS i FROM texts WHERE len(w) > 12)
), firsts AS (
  SELECT s, min(doc_id) AS least FROM stretches GROUP BY s
), gone AS (
  SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i FROM stretches JOIN firsts USING (s) WHERE least < coalesce(doc_id, 9223372036854775807)), range(13) AS r(k)
), places AS (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""
