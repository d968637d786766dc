"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

Training counts all n-grams of all trusted rows: each task hands on the distinct n-grams of a
chunk, and sums, continuation counts, context totals and interpolation are aggregates and joins
sharded by n-gram.  The model is a table of (order, n-gram, log probability) and of
(order, context, log of the back-off weight).

Scoring looks up each position's longest known n-gram.  A position needs only entries whose
n-gram ends in its last two bytes before the one to predict and that one, so the model is cut
into shards by those, each of a bounded size; one pass over the documents a shard gives a
partial sum for each row, and the passes are added up.  Texts are never shuffled.

A row is rejected if its log perplexity per byte exceeds its language's threshold, which is made of
quantiles over trusted texts of that language.  A model finds the texts it was trained on too easy, so one
in four distinct trusted texts, by hash, is kept out of the training and only those give the thresholds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sent, ship, stored, text_or_empty

ship(__name__)

ORDER = 5
#: Bytes handled at once, entries of a shard, and symbols that a position may have.
CHUNK, SHARD, SYMBOLS = 1 << 20, 1 << 21, 257
#: Trusted ids that are sent at once.
IDS = 1 << 21
BEGIN, END = 2, 3  # control bytes that stand around a text


def _grams(texts):
    """For chunks of texts: the n-gram ending at each position as an integer, and the positions at which each text begins.

    Yields (number of the first text, codes, starts); a long text comes in several chunks.
    """
    import numpy as np

    def codes(data):
        a = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        out = a[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            out |= a[ORDER - 1 - k : len(a) - k] << (8 * k)
        return out

    lead, pieces, size, first = bytes([BEGIN]) * (ORDER - 1), [], 0, 0

    def chunk():
        import numpy as np

        whole = codes(b"".join(pieces))
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        # Positions whose n-gram begins in one text and ends in the next one's lead are left out.
        keep = np.ones(len(whole), dtype=bool)
        for s in starts[1:]:
            keep[s - ORDER + 1 : s] = False
        return first, whole[keep], starts - np.arange(len(starts)) * (ORDER - 1)

    for i, text in enumerate(texts):
        data = lead + text.encode("utf-8", "replace") + bytes([END])
        for at in range(0, len(data) - ORDER + 1, CHUNK):
            if pieces and (size + CHUNK > 2 * CHUNK or at):
                yield chunk()
                pieces, size = [], 0
            if not pieces:
                first = i
            pieces.append(data[at : at + CHUNK + ORDER - 1])
            size += len(pieces[-1])
            if size >= CHUNK:
                yield chunk()
                pieces, size = [], 0
    if pieces:
        yield chunk()


def count_grams(texts: DataFrame) -> DataFrame:
    """``(gram, n)`` of the longest n-grams of all rows ``(text)``; summed within chunks and tasks before the shuffle."""

    def count(batches):
        import numpy as np
        import pyarrow as arrow

        for batch in batches:
            for _, codes, _ in _grams(t or "" for t in batch.column("text").to_pylist()):
                gram, n = np.unique(codes, return_counts=True)
                for at in range(0, len(gram), 1 << 16):
                    yield arrow.RecordBatch.from_pydict({"gram": arrow.array(gram[at : at + (1 << 16)]), "n": arrow.array(n[at : at + (1 << 16)])})

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order from its counts of counts."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first())
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1)]


def train(texts: DataFrame) -> DataFrame:
    """Model table ``(kind, size, code, log)``: kind ``p`` for n-grams of ``size`` bytes, ``g`` for contexts of ``size`` bytes.

    The highest order has the counts themselves, lower ones the number of distinct bytes before
    the n-gram; p(w | context) = max(n - D(n), 0) / N + g(context) p(w | shorter context), and the
    shortest is interpolated with the uniform distribution.  No rows give an empty model.
    """
    counts = {ORDER: stored(count_grams(texts), "grams")}
    for size in range(ORDER - 1, 0, -1):
        cut = F.col("gram").bitwiseAND((1 << (8 * size)) - 1)
        counts[size] = stored(counts[size + 1].select(cut.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    lower, out = None, None
    for size in range(1, ORDER + 1):
        d = _discounts(counts[size])
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts[size].select("gram", F.shiftright("gram", 8).alias("context"), "n", F.least(F.col("n").cast("double"), discount).alias("d"))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("all"), F.sum("d").alias("taken")).withColumn("g", F.col("taken") / F.col("all"))
        rows = rows.join(contexts, "context").withColumn("own", (F.col("n") - F.col("d")) / F.col("all"))
        if lower is None:
            rows = rows.withColumn("p", F.col("own") + F.col("g") / SYMBOLS)
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (size - 1))) - 1))
            rows = rows.join(lower, "suffix").withColumn("p", F.col("own") + F.col("g") * F.col("lower"))
        rows = stored(rows.select("gram", "p"), "interpolated")
        lower = rows.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        part = rows.select(F.lit("p").alias("kind"), F.lit(size).alias("size"), F.col("gram").alias("code"), F.log("p").alias("log"))
        weights = contexts.select(F.lit("g").alias("kind"), F.lit(size - 1).alias("size"), F.col("context").alias("code"), F.log("g").alias("log"))
        out = part.unionByName(weights) if out is None else out.unionByName(part).unionByName(weights)
    return stored(out, "model")


def _shard_of(code, shards: int):
    """Shard of a position, by the two bytes before it."""
    return ((code >> 8) & 0xFFFF) * 40503 % 65521 % shards


class Lookup:
    """A shard of the model as sorted arrays, with a hashed table of the frequent longest n-grams before them."""

    def __init__(self, parts: dict):
        import numpy as np

        self.parts = {k: (np.ascontiguousarray(c), np.ascontiguousarray(v)) for k, (c, v) in parts.items()}
        codes, logs = self.parts.get(("p", ORDER), (np.zeros(0, np.int64), np.zeros(0)))
        self.bits = max(4, int(len(codes) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        order = np.argsort(logs, kind="stable")  # the most probable are written last and so stay
        at = self._slot(codes[order])
        self.keys[at], self.values[at] = codes[order], logs[order]

    def _slot(self, codes):
        import numpy as np

        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _find(self, key, codes):
        import numpy as np

        known, logs = self.parts.get(key, (np.zeros(0, np.int64), np.zeros(0)))
        if not len(known):
            return np.zeros(len(codes), bool), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return known[at] == codes, logs[at]

    def logs(self, codes):
        """Log probability of the last byte of each n-gram."""
        import numpy as np

        at = self._slot(codes)
        out = np.where(hit := self.keys[at] == codes, self.values[at], 0.0)
        left = np.flatnonzero(~hit)
        for size in range(ORDER, 0, -1):
            if not len(left):
                return out
            tail = codes[left] & ((1 << (8 * size)) - 1)
            hit, logs = self._find(("p", size), tail)
            out[left[hit]] += logs[hit]
            left, tail = left[~hit], tail[~hit]
            seen, logs = self._find(("g", size - 1), tail >> 8)
            out[left] += np.where(seen, logs, 0.0)
        out[left] -= np.log(SYMBOLS)
        return out


def _shards(model: DataFrame, entries: int):
    """Parts of the model of about ``entries`` rows; n-grams of one and contexts of no or one byte are in each."""
    import numpy as np

    n = max(1, -(-model.count() // entries))
    last = F.when(F.col("kind") == "p", F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(0xFFFF)
    every = (F.col("kind") == "p") & (F.col("size") < 3) | (F.col("kind") == "g") & (F.col("size") < 2)
    for shard in range(n):
        rows = model.where(every | (last * 40503 % 65521 % n == shard)).toArrow() if n > 1 else model.toArrow()
        parts = {}
        kinds, sizes = np.array(rows["kind"].to_pylist(), dtype="U1"), rows["size"].to_numpy()
        codes, logs = rows["code"].to_numpy(), rows["log"].to_numpy()
        for kind, size in {*zip(kinds.tolist(), sizes.tolist())}:
            own = np.flatnonzero((kinds == kind) & (sizes == size))
            own = own[np.argsort(codes[own])]
            parts[kind, size] = codes[own], logs[own]
        yield shard, n, parts


def _sums(text: Column, shard: int, shards: int, sent) -> Column:
    """Sum of the log probabilities of the positions of a text that belong to the shard."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as arrow

        if "lookup" not in sent.value:  # once a worker, not once a batch
            sent.value["lookup"] = Lookup(sent.value)
        lookup, out = sent.value["lookup"], np.zeros(len(texts))
        for first, codes, starts in _grams(t.as_py() for t in texts):
            if shards > 1:
                own = np.flatnonzero(_shard_of(codes, shards) == shard)
                logs = np.zeros(len(codes))
                logs[own] = lookup.logs(codes[own])
            else:
                logs = lookup.logs(codes)
            out[first : first + len(starts)] += np.add.reduceat(logs, starts)
        return arrow.array(out)

    return score(text)


def log_perplexity(rows: DataFrame, model: DataFrame, entries: int = SHARD) -> DataFrame:
    """Stored rows ``(doc_id, key, kept, language, bytes, total)`` of ``rows(doc_id, language, text, kept)``; key is a hash of the text."""
    spark = rows.sparkSession
    rows = rows.withColumns({"key": F.xxhash64("text"), "bytes": F.octet_length("text").cast("long")})
    parts = []
    for shard, n, arrays in _shards(model, entries):
        sent = spark.sparkContext.broadcast(arrays)
        parts.append(stored(rows.select("doc_id", "key", "kept", "language", "bytes", _sums(F.col("text"), shard, n, sent).alias("total")), "scores"))
        sent.destroy()
    if len(parts) == 1:
        return parts[0]
    sums = None
    for i, part in enumerate(parts):  # equal texts have equal sums, so one for each text is enough
        one = part.groupBy("key").agg(F.max("total").alias("t"))
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy("key").agg(F.sum("t").alias("total"))
    return stored(parts[0].drop("total").join(sums, "key"), "scores")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` is among ``ids(trusted_id)``.

    The texts stay where they are: the ids are sent in blocks of about ``IDS``, a bounded size, with a
    pass over the rows for each.
    """
    blocks = max(1, -(-ids.count() // IDS))
    out = None
    for i in range(blocks):
        block = ids.where(F.pmod(F.xxhash64("trusted_id"), F.lit(blocks)) == i)
        part = rows.join(F.broadcast(block), rows["doc_id"] == block["trusted_id"], "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def judge(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang",
    quantile: float = 0.99, margin: float = 2.0, prior: float = 200.0, held_out: int = 4, least: int = 30, entries: int = SHARD, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row: id, ``log_perplexity`` (nats a byte), ``threshold``, ``accepted``, then ``keep``.

    Trusted are the ids that ``labels`` (id, quality, toxic) call good and not toxic; repeated labels count once.
    One in ``held_out`` distinct trusted texts gives means and thresholds, each text once however often it is copied; the
    model is trained on all rows of the others.  The log perplexity is shrunk towards its language's mean as if by ``prior``
    more bytes, as that of a short text varies.  The threshold of a language is its median plus ``margin`` times the distance
    from the median to the ``quantile``.  A language without held-out texts, or null, has
    the threshold of all of them together, one of fewer than ``least`` the larger of the two; without any, everything is
    accepted.  Null texts are empty; they and repeated rows are scored like others.
    """
    if held_out < 2:
        raise ValueError("held_out must leave texts to train on")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(language), F.lit("")).alias("language"), text_or_empty(F.col(text)).alias("text"), F.struct(F.lit(0), *keep).alias("kept"))
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    good = stored(good, "trusted")
    trained = _of_ids(rows.select("doc_id", "text"), good).where(F.pmod(F.xxhash64("text"), F.lit(held_out)) != 0)
    scores = log_perplexity(rows, train(trained.select("text")), entries)
    known = scores.where(F.pmod("key", F.lit(held_out)) == 0).join(good, scores["doc_id"] == good["trusted_id"], "left_semi")
    known = stored(known.select("language", "key", "bytes", "total").dropDuplicates(["language", "key"]), "held_out")
    means = stored(known.groupBy("language").agg((-F.sum("total") / F.sum(F.col("bytes") + 1)).alias("mean")), "means")
    mean = known.agg((-F.sum("total") / F.sum(F.col("bytes") + 1)).alias("m")).first()[0]

    def shrunk(df: DataFrame) -> DataFrame:
        m = F.coalesce("mean", F.lit(mean if mean is not None else 0.0))
        return df.join(sent(means), "language", "left").withColumn("log_perplexity", (m * prior - F.col("total")) / (F.col("bytes") + 1 + prior))

    quantiles = F.percentile_approx("log_perplexity", [0.5, quantile], F.lit(10000)).alias("q")
    border = (F.col("q")[0] + margin * (F.col("q")[1] - F.col("q")[0])).alias("border")
    # One row a language: few, and added up before the shuffle; so no row moves by its language.
    limits = stored(shrunk(known).where("mean is not null").groupBy("language").agg(quantiles, F.count("*").alias("n")).select("language", border, "n"), "limits")
    whole = F.lit(shrunk(known).agg(quantiles).select(border).first()[0]).cast("double")
    own = F.when(F.col("n") < least, F.greatest("border", whole)).otherwise(F.coalesce("border", whole))
    out = shrunk(scores).join(sent(limits), "language", "left").withColumn("threshold", own)
    accepted = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)).alias("accepted")
    return out.select(F.col("doc_id").alias(id), "log_perplexity", "threshold", accepted, *[F.col("kept")[c].alias(c) for c in keep])
