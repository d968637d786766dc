"""The corpus pipeline: stages over the documents table, each written as Parquet before the next.

A stage that takes rows out finds them by id and text hash, both null-safe, and joins without the
texts on the other side; it returns the columns that it was given.  Columns whose names begin
with an underscore are the stages' own and must not be in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.common import sent, stored, table
from leakscope.llm.decontam import overlaps
from leakscope.llm.kneser import judge
from leakscope.llm.langid import identify, primary
from leakscope.llm.simhash import simhash_dedup
from leakscope.llm.spm import tokenize


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key``: a hash of all that the decisions look at, so rows of one id and key share every decision."""
    return docs.withColumn("_key", F.xxhash64("text", "lang", "source"))


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` that have (semi) or lack (anti) a partner in ``rows(doc_id, _key)``.

    Texts move only if the decided rows are too many to be sent.
    """
    rows = sent(stored(rows.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).distinct(), "decided"))
    keyed = _keyed(docs)
    return keyed.join(rows, keyed["doc_id"].eqNullSafe(rows["_id"]) & (keyed["_key"] == rows["_k"]), how).drop("_key")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; ``lang`` becomes the language that was found where it is null or another."""
    found = stored(identify(_keyed(docs), declared="lang", host="source", keep=("_key", "lang")), "language")
    kept = _matched(docs, found.where("not accepted"), "left_anti")
    other = found.where(F.col("accepted") & ~F.col("language").eqNullSafe(primary(F.col("lang"))))
    other = sent(stored(other.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.min("language").alias("_language")), "found"))
    keyed = _keyed(kept)
    named = keyed.join(other, keyed["doc_id"].eqNullSafe(other["_id"]) & (keyed["_key"] == other["_k"]), "left")
    return named.withColumn("lang", F.coalesce("_language", "lang")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a perplexity beyond their language's threshold go."""
    judged = stored(judge(_keyed(docs), table(spark, sf_dir, "labels"), keep=("_key",)), "quality")
    return _matched(docs, judged.where("not accepted"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays, once; of groups without any id one row.

    Groups are told apart by their own label: ids may be null or occur with several texts.
    """
    groups = simhash_dedup(_keyed(docs), words=3, max_bits=2, keep=("_key",), group="_group")
    rows = stored(groups.groupBy("_group", "doc_id", "_key").agg(F.count("*").alias("n")), "groups")
    first = rows.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "n")).alias("first"))
    first = stored(first.select("first.doc_id", "first._key", "first.n"), "first")
    once = _matched(docs, first.where("n = 1"), "left_semi")
    again = first.where("n > 1")
    if again.isEmpty():
        return once
    repeated = _matched(docs, again, "left_semi")
    return once.unionByName(_keyed(repeated).dropDuplicates(["doc_id", "_key"]).drop("_key"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    hits = stored(overlaps(_keyed(docs), table(spark, sf_dir, "benchmark"), keep=("_key",)), "overlaps")
    return _matched(docs, hits, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with a test that they decode to its text."""
    return tokenize(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: SQL can express none of the models, nor 64-bit XXH64; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
