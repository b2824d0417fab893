"""Corpus pipeline: toxicity, language, repeated lines, near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
`docs`; the last one returns the packing.  Between stages the rows are written as Parquet in the shared folder and read again,
which cuts the lineage and survives the loss of executors.  See the operators' docstrings for nulls, empty and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquill.llm import bpe, jaccard, langid, linededup, packing, toxicity
from loomquill.llm.queries import TOKENIZERS, table
from loomquill.llm.support import fresh, rested, written


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which the field finds a toxic span."""
    rested(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without wordless documents and those that are surely of another language than they say."""
    rested(spark)
    return langid.keep_identified(docs, langid.fit(docs, f"{TOKENIZERS}/piece_bpe_32k.model"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier place has; n_chars follows the text."""
    rested(spark)
    got = linededup.dedup_text(docs)
    clean, _, dropped = got.columns[-3:]
    size = F.when(F.col(dropped) > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.withColumns({"n_chars": size, "text": F.col(clean)}).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    rested(spark)
    return jaccard.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left, in tokens of the vocabulary of bpe."""
    rested(spark)
    size = fresh(docs, "n_tokens")
    return packing.best_fit(docs.withColumn(size, bpe.token_count(F.col("text").cast("string"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")), length_col=size)


STAGES = [("toxicity", clean_speech), ("language", known_language), ("line_dedup", fresh_lines), ("near_duplicates", one_of_each), ("packing", packed)]
#: The trained stages are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
