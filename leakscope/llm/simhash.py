"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits are cut into two halves.
Either one half is equal, or each half differs in exactly one bit.  So an index of
the two halves as they are, and of the left half with one bit left open (one
variant for each of its 32 bits), has a common entry for every such pair.  Equal
index entries are joined and the bit distance is verified.  Neither the entries, 34 a
fingerprint, nor the rows are sent through the driver.

An index entry that many fingerprints share is not paired: its members are indexed
once more by the halves of the bits that are still free, and so on.  Nothing is
dropped, and no task meets more than ``PAIRED`` fingerprints of an entry.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dealt, ship, stored, text_or_empty
from .components import components

ship(__name__)

#: Entries with more members than this are indexed anew by their free bits.
PAIRED = 64
#: Shingles that are hashed before their bits are counted: bounds the memory for long texts.
CHUNK = 1 << 15


def _fingerprint(text: str, words: int) -> int:
    """Majority of the bits of the XXH64 hashes of all shingles."""
    import numpy as np
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only, and exactly the six ASCII blanks
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    n, digest, join = len(parts) - words + 1, xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, CHUNK):
        end = min(n, start + CHUNK)
        shingles = zip(*(parts[start + k : end + k] for k in range(words)))
        hashes = np.fromiter((digest(join(s), 42) for s in shingles), dtype=np.uint64, count=end - start)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit fingerprint as a long.  Null and blank texts have fingerprint zero."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as arrow

        values = np.fromiter((_fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        return arrow.array(values.view(np.int64))

    return simhash(text_or_empty(text))


def _entries(members: DataFrame) -> DataFrame:
    """Index entries of members ``(entry, fp, lo, hi, bits)``: ``bits`` may still differ within ``[lo, hi)``."""
    mid = F.expr("(lo + hi) div 2")
    low = F.expr("shiftrightunsigned(fp, lo) & (shiftleft(1L, mid - lo) - 1)")
    high = F.expr("shiftrightunsigned(fp, mid) & (shiftleft(1L, hi - mid) - 1)")

    def entry(value: Column, kind: Column, lo: str, hi: str, bits: Column) -> Column:
        return F.struct(F.xxhash64("entry", "lo", "hi", kind, value).alias("entry"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), bits.alias("bits"))

    equal_low = entry(F.col("low"), F.lit(-1), "mid", "hi", F.col("bits"))
    equal_high = entry(F.col("high"), F.lit(-2), "lo", "mid", F.col("bits"))
    one_open = F.transform(
        F.expr("sequence(0, mid - lo - 1)"),
        lambda p: entry(F.expr("low").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), p))), p, "mid", "hi", F.lit(1)),
    )
    found = F.when(F.col("bits") > 1, F.concat(F.array(equal_low, equal_high), one_open)).otherwise(F.array(equal_low, equal_high))
    return members.withColumns({"mid": mid.cast("int")}).withColumns({"low": low, "high": high}).select("fp", F.explode(found).alias("e")).select("e.*", "fp")


def links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of distinct fingerprints ``(fp)`` at ``max_bits`` (0 to 2) differing bits or fewer."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two halves with one open bit cover distances of 0 to 2")
    members = fingerprints.select(F.lit(0).cast("long").alias("entry"), "fp", F.lit(0).alias("lo"), F.lit(64).alias("hi"), F.lit(max_bits).alias("bits"))
    found = None
    while True:
        entries = _entries(members)
        shared = entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
        entries = stored(entries.join(dealt(shared), "entry"), "entries")
        paired = entries.where(F.col("n") <= PAIRED)
        a, b = paired.select("entry", F.col("fp").alias("u")), paired.select("entry", F.col("fp").alias("v"))
        pairs = a.join(dealt(b), "entry").where(F.expr(f"u < v and bit_count(u ^ v) <= {max_bits}")).select("u", "v")
        found = pairs if found is None else found.unionByName(pairs)
        members = entries.where(F.col("n") > PAIRED).select("entry", "fp", "lo", "hi", "bits")
        if members.isEmpty():
            return found.distinct()


def simhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2, keep: tuple[str, ...] = (), group: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``, then ``keep``.

    ``group`` names one more column, a key of the component: ``component_id`` is none, as it may be
    null, or the smallest id of several components if one id has several texts.

    Words are split at ASCII blanks after A-Z are lower-cased.  A text of fewer than
    ``words`` words is one shingle; a null or blank text has fingerprint zero, and
    such rows are linked like any others.  Repeated rows stay.  Null ids get the
    smallest id of their component, null if it has none.  Equal fingerprints
    are one node, so copies cost nothing after the first aggregate.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp"), *keep), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    labels = components(links(nodes, max_bits))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "label").select("fp", "component_id", *([F.col("label").alias(group)] if group else []))
    return rows.join(dealt(named), "fp").select(F.col("doc_id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep, *([group] if group else []))
