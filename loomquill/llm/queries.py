"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard, langid, licence, linededup, media, packing, toxicity, urlfilter

TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_spans(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every URL of the table on an advertising, gambling or spam host."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.url_filter(pages, pages.select("url").where(urlfilter.host(F.col("url")).rlike(urlfilter.SPAM_HOST)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, f"{TOKENIZERS}/piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in tokens of op4's vocabulary, so a text without blanks is cut like any other."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", bpe.token_count(F.col("text").cast("string"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken").alias("n_tokens"))
    return packing.best_fit(sized, length_col="n_tokens")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.licence_scan(table(spark, sf_dir, "documents"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column: the raw bytes of every page."""
    return media.media_chunks(table(spark, sf_dir, "pages"), id_col="page_id", payload_col="html")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.containment(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_media_chunks": op9_media_chunks,
    "op10_fingerprints": op10_fingerprints,
}
ORACLE: dict[str, str] = {"op2_line_dedup": linededup.SQL, "op3_url_filter": urlfilter.SQL, "op5_ngram_jaccard": jaccard.SQL}
