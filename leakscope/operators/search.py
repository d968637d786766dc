"""Keyword retrieval for tables of questions, and a stored inverted index over findings."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import shared_dir
from .findings import check_positive
from .retrieve import _context, _text, check_query, tokens
from .top import top_per_key
from .vectors import _column

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different questions that one pass over the findings answers; a larger table is answered in so many passes.
QUESTIONS = 20_000
#: Rows that a task holds at most, and questions that it scores at once.
HELD, AT_ONCE = 1 << 20, 1 << 14
#: Sets of words of which a task knows how many rows had them.
ALIKE = 100_000
#: Buckets of a stored index; words are dealt out by their SHA-1.
BUCKETS = 64


# --- a table of questions ---------------------------------------------------


def _automaton(words: Sequence[str]):
    """Finds all of the words within a text in one go."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, i)
    found.make_automaton()
    return found


class _Held:
    """The best ``k`` rows of each question, from rows that come best first by severity and tie.

    A later row gets in only by a greater score.  So the commonest words of a question, as many as cannot reach more than its
    ``k``-th score together, bring up no row for it any more; they still count in the score.  What is held does not grow with the rows.
    """

    def __init__(self, words: int, k: int, start: np.ndarray, word: np.ndarray, times: np.ndarray):
        """``word`` and ``times`` of question q lie from ``start[q]`` to ``start[q + 1]``, the commonest word first."""
        n = len(start) - 1
        self.k, self.start, self.word, self.times, self.marked = k, start, word, times, np.zeros(words, bool)
        who, place = np.repeat(np.arange(n), np.diff(start)), np.arange(len(word)) - np.repeat(start[:-1], np.diff(start))
        self.sums = np.cumsum(times) - np.repeat(np.concatenate([[0], np.cumsum(times)])[start[:-1]], np.diff(start))
        by, ends = np.argsort(word, kind="stable"), np.searchsorted(np.sort(word), np.arange(1, words))
        self.live = list(zip(np.split(who[by], ends), np.split(place[by], ends)))
        self.score, self.row = np.zeros((n, k), np.int64), np.full((n, k), -1, np.int64)
        self.closed = np.zeros(n, np.int64)
        self.alike: dict[tuple, int] = {}

    def add(self, row: int, found: set[int]) -> bool:
        """Whether the row with these words is among the best of a question."""
        alike = tuple(sorted(found))
        times = self.alike.get(alike, 0)
        if times >= self.k:  # so many better rows have the same words
            return False
        if len(self.alike) >= ALIKE:
            self.alike.clear()
        self.alike[alike] = times + 1
        met = []
        for w in found:
            who, place = self.live[w]
            open_ = place >= self.closed[who]
            if not open_.all():
                who, place = self.live[w] = who[open_], place[open_]
            met.append(who)
        met = np.unique(np.concatenate(met))
        self.marked[alike,] = True
        entered = False
        for at in range(0, len(met), AT_ONCE):
            entered |= self._enter(row, met[at : at + AT_ONCE])
        self.marked[alike,] = False
        return entered

    def _words(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of these questions lie, one question after another, where each begins there, and their numbers."""
        sizes = self.start[who + 1] - self.start[who]
        first = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.start[who] - first, sizes), first, sizes

    def _enter(self, row: int, who: np.ndarray) -> bool:
        at, first, _ = self._words(who)
        score = np.add.reduceat(self.times[at] * self.marked[self.word[at]], first)
        better = score > self.score[who, -1]
        who, score = who[better], score[better]
        if not len(who):
            return False
        scores = np.column_stack([self.score[who], score])
        rows = np.column_stack([self.row[who], np.full(len(who), row)])
        order = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.score[who], self.row[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)
        at, first, sizes = self._words(who)
        self.closed[who] = np.add.reduceat((self.sums[at] <= np.repeat(self.score[who, -1], sizes)).astype(np.int64), first)
        return True


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyword_topk_table(findings: DataFrame, questions: DataFrame, k: int = 5, *, tie: Sequence[str] = ("ts", "finding_id"), per_pass: int = QUESTIONS) -> DataFrame:
    """The ``k`` findings whose text contains most words of each question ``(query_id, text)``, worst severity first.

    All words of the questions are looked for in a text at once.  Each task reads its findings in the order that decides between equal
    scores, holds the best ``k`` of every question and hands them on when it ends.  Questions without a word of three letters, and null ones, find nothing; a blank
    question is an error, as for a single one.  Repeated question ids are answered each, as one question of all their words; ids that ask the same share one search.
    """
    check_positive("k", k)
    asked = questions.select("query_id", F.col("text").cast("string").alias("text")).where("text is not null")
    kinds, id_type = dict(asked.dtypes), asked.select("query_id").limit(0).toArrow().schema.field(0).type
    ids = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    distinct = _stored(ids.groupBy("texts").agg(F.min("query_id").alias("_question")), "questions")
    passes = max(1, -(-distinct.count() // max(1, min(per_pass, HELD // k))))
    names = [f"_tie{i}" for i in range(len(tie))]
    context = ["id", "summary", "severity", "snippet", "url"]
    rows = findings.select(
        *_context(), *[F.col(c).alias(name) for c, name in zip(tie, names)], S.severity_rank("severity").alias("_severity"), _text().alias("_text")
    )
    order = [F.col("_severity").desc(), *[F.col(c) for c in names]]
    if passes > 1:
        rows = _stored(rows, "texts")
    rows = rows.sortWithinPartitions(*order)
    types = dict(rows.dtypes)
    schema = ", ".join([f"_question {kinds['query_id']}", *[f"{c} {types[c]}" for c in (*context, *names, "_severity")], "score long"])
    parts = []
    for part in range(passes):
        block = distinct.where(F.pmod(F.xxhash64("texts"), F.lit(passes)) == part).collect()
        asking, words, counts = [], {}, []
        for r in block:
            times: dict[int, int] = {}
            for text in r["texts"]:
                for w in tokens(check_query(text)):
                    i = words.setdefault(w, len(words))
                    times[i] = times.get(i, 0) + 1
            if times:
                asking.append(r["_question"])
                counts.append(times)
        if not words:
            continue
        common = np.bincount([w for times in counts for w in times], minlength=len(words))
        listed = [sorted(times.items(), key=lambda x: -common[x[0]]) for times in counts]
        start = np.cumsum([0, *[len(x) for x in listed]])
        flat = np.array([x for times in listed for x in times], np.int64)
        sent = findings.sparkSession.sparkContext.broadcast((list(words), start, flat[:, 0].copy(), flat[:, 1].copy(), asking))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, start, word, times, asking = sent.value
            find, held = _automaton(vocabulary), _Held(len(vocabulary), k, start, word, times)
            kept, numbers, bound, seen = None, np.zeros(0, np.int64), 0, 0
            for batch in batches:
                new = []
                for at, text in enumerate(batch.column("_text").to_pylist()):
                    found = {i for _, i in find.iter(text)}
                    if found and held.add(seen + at, found):
                        new.append(at)
                if new:
                    own = pa.Table.from_batches([batch]).drop_columns(["_text"]).take(pa.array(new))
                    kept, numbers = pa.concat_tables([kept, own]) if kept is not None else own, np.concatenate([numbers, np.array(new) + seen])
                    if len(numbers) > 2 * bound:  # rows that no question holds any more go
                        stay = np.flatnonzero(np.isin(numbers, held.row))
                        kept, numbers, bound = kept.take(pa.array(stay)).combine_chunks(), numbers[stay], max(len(stay), 10_000)
                seen += batch.num_rows
            who, place = np.nonzero(held.row >= 0)
            for at in range(0, len(who), 10_000):
                q, p = who[at : at + 10_000], place[at : at + 10_000]
                piece = kept.take(pa.array(np.searchsorted(numbers, held.row[q, p]))).combine_chunks()
                named = pa.array([asking[i] for i in q], id_type)
                columns = [named, *[_column(piece, c) for c in (*context, *names, "_severity")], pa.array(held.score[q, p])]
                yield pa.RecordBatch.from_arrays(columns, names=["_question", *context, *names, "_severity", "score"])

        parts.append(rows.mapInArrow(search, schema))
    if not parts:
        return rows.limit(0).select(F.lit(None).cast(kinds["query_id"]).alias("query_id"), F.lit(0).alias("rank"), *context, F.lit(0).cast("long").alias("score"))
    ranked = top_per_key(reduce(DataFrame.unionByName, parts), ["_question"], [F.col("score").desc(), *order], k)
    who = ids.join(distinct, "texts").select("query_id", F.col("_question").alias("_same"))
    return ranked.join(who, F.col("_question").eqNullSafe(F.col("_same"))).select("query_id", "rank", *context, "score")


# --- stored inverted index --------------------------------------------------


def _bucket(token: Column | str) -> Column:
    return (F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def postings(findings: DataFrame) -> DataFrame:
    """``token, finding_id, tf``: words of three letters and more in summary and snippet."""
    text = F.lower(F.concat_ws(" ", "summary", "snippet"))
    words = findings.select("finding_id", F.explode(F.split(text, r"[^\p{L}\p{N}_]+")).alias("token"))
    return words.where(F.length("token") > 2).groupBy("token", "finding_id").agg(F.count(F.lit(1)).alias("tf"))


def _scans(spark: SparkSession, path: str) -> DataFrame:
    """One row for each added scan; those that are not listed here are not read."""
    return spark.read.schema("scan string, n long").json(f"{path}/scans")


def add_scan(spark: SparkSession, path: str, findings: DataFrame, scan: str | None = None) -> bool:
    """Add the findings of a scan to the index at ``path``; False, and nothing changes, if a scan of that name is in it.

    Postings lie in folders by bucket of their word and by scan, with the number of documents of each word beside them.  An
    id that an earlier scan has already is left out, so each finding is indexed once; null ids are left out too.
    """
    scan = scan or uuid.uuid4().hex
    known = _known(spark, path)
    if scan in known:
        return False
    rows = findings.where("finding_id is not null").dropDuplicates(["finding_id"])
    if known:
        old = spark.read.schema("finding_id string, scan string").parquet(f"{path}/ids").where(F.col("scan").isin(list(known)))
        rows = rows.join(old.select("finding_id"), "finding_id", "left_anti")
    found = postings(rows).withColumn("bucket", _bucket("token"))
    # Sorted by word within a bucket; a bucket with many postings goes to several files.
    dealt = found.repartitionByRange("bucket", "token", "finding_id").sortWithinPartitions("bucket", "token")
    dealt.withColumn("scan", F.lit(scan)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan", "bucket").parquet(f"{path}/postings")
    written = spark.read.schema("token string, finding_id string, tf long, scan string, bucket int").parquet(f"{path}/postings").where(F.col("scan") == scan)
    counts = written.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"))
    counts.withColumn("scan", F.lit(scan)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan", "bucket").parquet(f"{path}/counts")
    rows.select("finding_id", F.lit(scan).alias("scan")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan").parquet(f"{path}/ids")
    n = spark.read.schema("finding_id string, scan string").parquet(f"{path}/ids").where(F.col("scan") == scan).count()
    spark.createDataFrame([(scan, n)], "scan string, n long").coalesce(1).write.mode("append").json(f"{path}/scans")
    return True


def _known(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and numbers of findings of the scans of an index."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/scans")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {}
    return {r["scan"]: r["n"] for r in _scans(spark, path).collect()}


def search_stored(spark: SparkSession, path: str, query: str, k: int = 10) -> DataFrame:
    """``finding_id, score``: the sum of tf * ln(N / df) over the words of the query; only the buckets of its words are read.

    Document counts are added up over the scans, so the scores are those of an index that was built at once.
    """
    check_positive("k", k)
    words = sorted(set(tokens(check_query(query))))
    known = _known(spark, path)
    if not words or not sum(known.values()):
        return spark.createDataFrame([], "finding_id string, score double")
    asked = spark.createDataFrame([(w,) for w in words], "token string").select("token", _bucket("token").alias("bucket")).collect()
    buckets = sorted({r["bucket"] for r in asked})

    def of_words(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, scan string, bucket int").parquet(f"{path}/{name}")
        return rows.where(F.col("bucket").isin(buckets) & F.col("scan").isin(list(known)) & F.col("token").isin(words))

    df = of_words("counts", "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))  # as many rows as words
    weighted = of_words("postings", "token string, finding_id string, tf long").join(F.broadcast(df), "token")
    score = F.round(F.sum(F.col("tf") * F.ln(F.lit(float(sum(known.values()))) / F.col("df"))), 6)
    return weighted.groupBy("finding_id").agg(score.alias("score")).orderBy(F.col("score").desc(), "finding_id").limit(k)
