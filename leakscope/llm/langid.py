"""Language of a text by Bayesian evidence fusion.

Evidence of a row: its text (byte trigrams, naive Bayes), the language that its markup or its
record declares, the suffix of its address, and its host.  How far declarations and suffixes
are to be trusted, and which languages a host has, are grouped aggregates over all rows: each
row counts with what its text alone says.  Host priors are smoothed towards those of the host's
domain, and these towards the whole table.

The posterior only weighs the fitted languages against each other.  So a text must also be typical of the
language that is found: its log likelihood a trigram, shrunk by its number of distinct trigrams, must not lie
far below that of the language's own texts, each under a model without it.  Else its language is unknown.

The trigram model and what is typical come from all distinct texts that have a label; ``sample`` bounds them if it is given.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, sent, ship, stored, text_or_empty

ship(__name__)

#: Size of the hashed trigram table, and bytes handled at once.
BUCKETS, CHUNK = 1 << 15, 1 << 20
#: A value that holds more than one row in so many is joined by itself.
FREQUENT = 1000
#: Trigrams overlap, so each counts as this share of an independent observation.
INDEPENDENT = 0.2
#: Languages whose counts are held by a task, or sent to the driver, at once.
BLOCK = 64
#: Fixed values of ISO 639: tags that name no language.
NO_LANGUAGE = ("und", "zxx", "mul", "mis")
#: Distinct trigrams as which the language's usual likelihood counts beside a text's own.
PRIOR = 200
#: Digits to which likelihoods are rounded for their quantiles.
DIGITS = 3
#: A text is typical down to so many times the distance of the lower quartile from the median, and to so many nats a trigram at least.
QUARTILES, NATS = 4.0, 2.0


def markup_language(html: Column) -> Column:
    """Primary subtag that the ``html`` element declares; null if none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def primary(tag: Column) -> Column:
    """Primary subtag of a language tag in lower case; null if it names no language."""
    found = F.element_at(F.split(F.lower(F.trim(tag)), "[-_]"), 1)
    return F.when((found != "") & ~found.isin(*NO_LANGUAGE), found)


def address_suffix(host: Column) -> Column:
    """Last label of a host name; null for one without a dot or an address of digits."""
    last = F.lower(F.regexp_extract(host, r"\.([A-Za-z]{2,})(?::\d+)?$", 1))
    return F.when(last != "", last)


def domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(F.lower(host), ".", -2)


def _trigrams(texts):
    """Buckets of all byte trigrams of the lower-cased texts, with the bounds of each text; cut into chunks."""
    import numpy as np
    import pyarrow as arrow
    import pyarrow.compute as compute

    texts = compute.utf8_lower(compute.fill_null(texts.cast(arrow.large_string()), ""))
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    for i in range(len(texts)):
        a, b = int(ends[i]), int(ends[i + 1])
        for start in range(a, max(b - 2, a + 1), CHUNK):
            piece = data[start : min(b, start + CHUNK + 2)].astype(np.uint32)
            if len(piece) < 3:
                yield i, np.zeros(0, np.uint32)
                continue
            yield i, (((piece[:-2] << 16) | (piece[1:-1] << 8) | piece[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def _counts(texts):
    """Number of each text and how often it has each bucket; holds the counts of one text at a time."""
    import numpy as np

    last, own = None, None
    for i, buckets in _trigrams(texts):
        n = np.bincount(buckets, minlength=BUCKETS)
        if i == last:
            own += n
            continue
        if last is not None:
            yield last, own
        last, own = i, n
    if last is not None:
        yield last, own


def _borders(labelled: DataFrame, counts: dict[str, int], sample: int) -> dict[str, int]:
    """For each language the ``sample``-th smallest hash of its distinct texts, or the largest if it has fewer.

    Only the lowest share of the hash range is sorted, some four times the sample for each language.  Where
    copies leave too few distinct texts in that share, it is widened and looked at again.
    """
    hashed = labelled.select("language", F.xxhash64("text").alias("hash"))
    order = Window.partitionBy("language").orderBy("hash")
    shares, borders = {name: min(1.0, 4.0 * sample / n) for name, n in counts.items()}, {}
    while shares:
        low = reduce(
            lambda a, b: a | b,
            [(F.col("language") == name) & (F.col("hash") <= min(int(share * 2**64) - 2**63, 2**63 - 1)) for name, share in shares.items()],
        )
        near = hashed.where(low).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
        found = {r["language"]: r for r in near.groupBy("language").agg(F.max("n").alias("n"), F.max("hash").alias("border")).collect()}
        for name in [x for x in shares if shares[x] == 1.0 or (x in found and found[x]["n"] == sample)]:
            borders[name] = found[name]["border"]
            del shares[name]
        shares = {name: min(1.0, 16 * share) for name, share in shares.items()}
    return borders


def _distinct(labelled: DataFrame) -> DataFrame:
    """Each text of a language once; only texts whose hash occurs again move."""
    hashed = labelled.select("language", "text", F.xxhash64("text").alias("hash"))
    again = stored(hashed.groupBy("language", "hash").count().where("count > 1").select("language", "hash"), "again")
    copies = hashed.join(sent(again), ["language", "hash"], "left_semi").select("language", "text").distinct()
    return hashed.join(sent(again), ["language", "hash"], "left_anti").select("language", "text").unionByName(copies)


def _sampled(labelled: DataFrame, counted: dict[str, int], sample: int) -> DataFrame:
    """The ``sample`` distinct texts of lowest hash of each language."""
    borders = _borders(labelled, counted, sample)
    border = reduce(lambda c, name: c.when(F.col("language") == name, borders[name]), counted, F.when(F.lit(False), F.lit(0).cast("long")))
    hashed = labelled.withColumn("hash", F.xxhash64("text"))
    chosen = hashed.where(F.col("hash") <= border).groupBy("language", "hash").agg(F.min("text").alias("text")).select("language", "text")
    return stored(chosen, "sample")


def fit(rows: DataFrame, text: str, language: str, sample: int | None = None) -> tuple[list[str], object]:
    """Names of the languages and the table of log probabilities (bucket by language).

    All values that have a text; for each all its distinct texts, or the ``sample`` ones of lowest hash.
    """
    return _fit(rows, text, language, sample)[:2]


def _fit(rows: DataFrame, text: str, language: str, sample: int | None) -> tuple[list[str], object, object, DataFrame]:
    """As ``fit``, then the smoothed counts and the texts ``(language, text)`` that were counted."""
    import numpy as np

    labelled = rows.select(F.col(text).alias("text"), F.col(language).alias("language")).where("language is not null and length(text) > 2")
    counted = {r["language"]: r["count"] for r in labelled.groupBy("language").count().orderBy("language").collect()}
    names = sorted(counted)
    table = np.full((BUCKETS, len(names)), 0.5)
    if not names:
        return names, table, table, labelled
    chosen = _distinct(labelled) if sample is None else _sampled(labelled, counted, sample)

    def count(batches):
        import numpy as np
        import pyarrow as arrow

        def rows(table):
            for name, counts in table.items():
                at = np.flatnonzero(counts)
                yield arrow.RecordBatch.from_pydict({"language": arrow.array([name] * len(at), arrow.string()), "bucket": arrow.array(at, arrow.int32()), "n": arrow.array(counts[at])})

        table = {}
        for batch in batches:
            names = batch.column("language").to_pylist()
            for i, buckets in _trigrams(batch.column("text")):
                if names[i] not in table:
                    if len(table) >= BLOCK:
                        yield from rows(table)
                        table = {}
                    table[names[i]] = np.zeros(BUCKETS, np.int64)
                # A long text fills a table of its own; of a short one only the buckets that it has are touched.
                if len(buckets) * 4 > BUCKETS:
                    table[names[i]] += np.bincount(buckets, minlength=BUCKETS)
                else:
                    np.add.at(table[names[i]], buckets, 1)
        yield from rows(table)

    counts = chosen.mapInArrow(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = stored(counts, "trigrams")  # at most as many rows as the table has numbers
    for at in range(0, len(names), BLOCK):
        block = counts.where(F.col("language").isin(names[at : at + BLOCK])).toPandas()
        for name, own in block.groupby("language"):
            table[own["bucket"].to_numpy(), names.index(name)] += own["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32), table, chosen


def typical(chosen: DataFrame, names: list[str], smoothed) -> tuple[object, object]:
    """Usual log likelihood a trigram of each language, and the least that is typical of it.

    Each text that was counted is measured under the model of its language without that text.
    """
    import numpy as np

    place = {name: j for j, name in enumerate(names)}

    def measure(batches):
        import numpy as np
        import pyarrow as arrow

        for batch in batches:
            labels, out = batch.column("language").to_pylist(), []
            for i, n in _counts(batch.column("text")):
                at = np.flatnonzero(n)
                if len(at):
                    rest = smoothed[:, place[labels[i]]]
                    logs = np.log((rest[at] - n[at]) / (rest.sum() - n.sum()))
                    out.append((labels[i], len(at), float((n[at] * logs).sum() / n.sum())))
            if out:
                yield arrow.RecordBatch.from_pydict({c: arrow.array(v, t) for c, v, t in zip(("language", "d", "mean"), zip(*out), (arrow.string(), arrow.int64(), arrow.float64()))})

    measured = stored(chosen.mapInArrow(measure, "language string, d long, mean double"), "measured")  # three numbers a text
    # Rounded, so that a quantile has few values to tell apart however many texts there are.
    middle = measured.groupBy("language").agg(F.percentile(F.round("mean", DIGITS), 0.5).alias("usual"))
    score = (F.col("d") * F.col("mean") + PRIOR * F.col("usual")) / (F.col("d") + PRIOR)
    quartiles = F.percentile(F.round(score, DIGITS), [0.25, 0.5]).alias("q")
    usual, least = np.zeros(len(names)), np.full(len(names), -np.inf)
    for r in measured.join(F.broadcast(middle), "language").groupBy("language").agg(F.first("usual").alias("usual"), quartiles).collect():
        low, median = r["q"]
        usual[place[r["language"]]], least[place[r["language"]]] = r["usual"], median - max(NATS, QUARTILES * (median - low))
    return usual, least


def likelihood(text: Column, table, usual=None, least=None) -> Column:
    """Array of the log likelihood of the text for each language, tempered, and its greatest set to zero.

    With ``usual`` and ``least``, as many numbers follow: 1 if the text is typical of the language, else 0.
    """

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as arrow

        out = np.zeros((len(texts), table.shape[1]))
        count, distinct = np.zeros((len(texts), 1)), np.zeros((len(texts), 1))
        columns = [np.ascontiguousarray(table[:, j]) for j in range(table.shape[1])]
        for i, buckets in _trigrams(texts):
            for j, column in enumerate(columns):
                out[i, j] += column[buckets].sum(dtype=np.float64)
            count[i] += len(buckets)
            if usual is not None:
                distinct[i] = max(distinct[i, 0], np.count_nonzero(np.bincount(buckets, minlength=BUCKETS)))
        logs = (out - out.max(axis=1, keepdims=True)) * INDEPENDENT
        if usual is not None:
            score = (distinct * out / np.maximum(count, 1) + PRIOR * usual) / (distinct + PRIOR)
            logs = np.concatenate([logs, (score >= least).astype(np.float64)], axis=1)
        return arrow.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * logs.shape[1], logs.ravel())

    return evidence(text)


def _posterior(logs: Column) -> Column:
    """Softmax of an array."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, c: a + c))


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Sum of the text posteriors and number of rows for each value of ``key``; added up before the shuffle."""
    added = F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(n)])
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(added.alias("s"), F.count("*").alias("n"))


def _looked_up(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the column ``{key}_log`` of ``values(key, n, {key}_log)``, null where there is none.

    Values with more than one row in ``FREQUENT`` are sent to the executors: there are fewer than ``FREQUENT``.
    The others are joined by a shuffle, in which the rows that are served already, and those without a value,
    are dealt out evenly.
    """
    name = f"{key}_log"
    often = F.col("n") * FREQUENT > total
    served = rows.join(F.broadcast(values.where(often).select(key, F.col(name).alias("_often"))), key, "left")
    open_ = F.col(key).isNotNull() & F.col("_often").isNull()
    # Not a column of its own: a constant on one side would be folded and not take part in the shuffle.
    dealt = F.concat(F.lit("\0"), F.xxhash64("doc_id", "logs").cast("string"))
    served = served.withColumns({"_open": open_, "_at": F.when(open_, F.col(key)).otherwise(dealt)})
    rest = values.where(~often).select(F.col(key).alias("_at"), F.col(name).alias("_rest"))
    found = F.coalesce("_often", F.when(F.col("_open"), F.col("_rest")))
    return served.join(rest, "_at", "left").withColumn(name, found).drop("_often", "_rest", "_open", "_at")


def _smoothed(s: Column, parent: Column, weight: float) -> Column:
    total = F.aggregate(s, F.lit(0.0), lambda a, c: a + c)
    return F.zip_with(s, parent, lambda x, p: (x + weight * p) / (total + weight))


def _given_language(sums: DataFrame, key: str, whole: Column) -> DataFrame:
    """``log P(key | language)``, smoothed by a small count; one row for each value of ``key``."""
    return sums.select(key, "n", F.zip_with("s", whole, lambda x, t: F.log((x + 0.1) / (t + 1.0))).alias(f"{key}_log"))


def identify(
    rows: DataFrame, id: str = "doc_id", text: str = "text", declared: Column | str | None = "lang", host: Column | str | None = "source", suffix: Column | str | None = None,
    train: Column | str | None = None, sample: int | None = None, weight: float = 20.0, least: float = 0.5, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row: id, ``language``, ``confidence``, ``accepted``, then ``keep``.

    ``declared``, ``host`` and ``suffix`` are columns or None; null values are no evidence.  Language
    tags count by their primary subtag in lower case, and each that has a text is a language.  ``train`` (by default
    ``declared``) labels the texts that the trigram model is fitted on, all of them or ``sample`` distinct ones a language.  A row is not accepted if its text has no
    letter, its confidence is below ``least`` or its text is not typical of the language; without any labelled text, all languages are null and nothing
    is accepted.  Null texts are empty.  Repeated rows stay, and count again in the aggregates.
    """
    bounded_batches(rows.sparkSession)
    of = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    named = rows.select(
        F.col(id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"), primary(of(declared)).alias("declared"), of(host).alias("host"), of(suffix).alias("suffix"),
        primary(of(declared if train is None else train)).alias("label"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
    )
    names, table, smoothed, chosen = _fit(named, "text", "label", sample)
    n, kept = len(names), [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    if not n:
        return named.select(F.col("doc_id").alias(id), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), *kept)
    letters = F.col("text").rlike(r"\p{L}")
    seen = named.drop("label").withColumns({"both": likelihood(F.col("text"), table, *typical(chosen, names, smoothed)), "letters": letters}).drop("text")
    seen = seen.withColumns({"logs": F.slice("both", 1, n), "fits": F.slice("both", n + 1, n)}).drop("both")
    seen = stored(seen.withColumn("p", F.when(F.col("letters"), _posterior(F.col("logs")))), "evidence")  # no texts: a few numbers a row

    whole = seen.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)], F.count("*").alias("n")).first()
    *whole, rows_seen = whole
    total = sum(whole) + n
    everywhere = F.array(*[F.lit((s + 1.0) / total) for s in whole])
    sums = F.array(*[F.lit(float(s)) for s in whole])

    hosts = _sums(seen, "host", n).withColumn("domain", domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("d"))
    domains = domains.select("domain", _smoothed(F.col("d"), everywhere, weight).alias("d"))
    priors = hosts.join(domains, "domain").select("host", "n", F.transform(_smoothed(F.col("s"), F.col("d"), weight), lambda x: F.log(x)).alias("host_log"))
    out = _looked_up(seen, priors, "host", rows_seen)
    for key in ("declared", "suffix"):
        out = _looked_up(out, _given_language(_sums(seen, key, n), key, sums), key, rows_seen)
    zero = F.array(*[F.lit(0.0)] * n)
    parts = ["logs", F.coalesce("host_log", F.transform(everywhere, lambda x: F.log(x))), F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero)]
    added = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    out = out.withColumn("q", _posterior(added))
    best = F.array_max("q")
    place = F.array_position("q", best).cast("int")
    language, fits = F.element_at(F.array(*[F.lit(x) for x in names]), place), F.element_at("fits", place) > 0
    return out.select(F.col("doc_id").alias(id), language.alias("language"), best.alias("confidence"), (F.col("letters") & (best >= least) & fits).alias("accepted"), *kept)
