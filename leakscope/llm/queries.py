"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import overlaps
from .html_text import extract_pages
from .kneser import judge
from .langid import address_suffix, identify, markup_language
from .preference import SQL as PREFERENCE_SQL, format_preferences, shortened_answers
from .repeats import SQL as REPEATS_SQL, remove_repeats
from .runs import SQL as RUNS_SQL, digests, find_runs, with_cycles
from .simhash import simhash_dedup
from .spm import tokenize
from .topk import SQL as TOPK_SQL, topk
from .urls import filter_urls, host_of
from .warc import SQL as WARC_SQL, round_trip
from .whiten import whitened_components


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk(rows, rows.where("vec_id % 100 = 0"), k=10, scale=1024)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "conversations")
    return format_preferences(chosen, shortened_answers(chosen))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: declared language and source beside the text."""
    return identify(table(spark, sf_dir, "documents"), declared="lang", host="source")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: language of the markup, host and its suffix beside the text, which here is the whole html."""
    host = host_of(F.col("url"))
    return identify(table(spark, sf_dir, "pages"), "page_id", "html", declared=markup_language(F.col("html")), host=host, suffix=address_suffix(host))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents")).select("doc_id", "token_ids", "n_tokens", "round_trip")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(with_cycles(table(spark, sf_dir, "documents"))))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), least=13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_topk": op4_topk,
    "op5_warc": op5_warc,
    "op6_main_text": op6_main_text,
    "op7_preferences": op7_preferences,
    "op8_language": op8_language,
    "page_language": page_language,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality": op10_quality,
    "op11_runs": op11_runs,
    "op12_repeats": op12_repeats,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {"op4_topk": TOPK_SQL, "op5_warc": WARC_SQL, "op7_preferences": PREFERENCE_SQL, "op11_runs": RUNS_SQL, "op12_repeats": REPEATS_SQL}
