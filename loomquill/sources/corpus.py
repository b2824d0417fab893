"""Speech and tweet tables: gated scans, combined sources, exports, landing of listings."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquill import schema
from loomquill.operators import ingest, quality, sampling


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("protocol_date", F.to_date(F.try_to_timestamp(F.col("protocol_date").cast("string"))))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date_col: str = "protocol_date") -> DataFrame:
    """Rows from `start` to `end`, both included."""
    out = df if start is None else df.where(F.col(date_col) >= F.to_date(F.lit(start)))
    return out if end is None else out.where(F.col(date_col) <= F.to_date(F.lit(end)))


def load_corpus(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The archive: an error on repeated ids, unreadable dates dropped, both bounds included.  Sort at the sink, not here."""
    df = quality.assert_unique(spark.read.parquet(path))
    return date_range(_dated(df).where("protocol_date is not null"), start, end)


def load_historical(spark: SparkSession, path: str | None) -> DataFrame:
    """The archive with readable dates; without a path an empty frame of four columns."""
    if not path:
        return spark.createDataFrame([], "id string, protocol_date date, party string, text string")
    return _dated(spark.read.parquet(path))


def jdbc_options(url: str, table: str, key: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": "10000"}


def fetch_speeches(spark: SparkSession, options: Mapping[str, str], start: str | None = None, end: str | None = None, columns: Iterable[str] = ("id", "protocol_date", "speaker", "party", "text")) -> DataFrame:
    """A table read by ranges of its key, in parallel; columns and the date range are pushed to the server."""
    return date_range(spark.read.format("jdbc").options(**options).load().select(*columns), start, end)


def count_speeches(df: DataFrame) -> int:
    return df.count()


def latest_date(df: DataFrame):
    """The last date, None for an empty table."""
    return df.agg(F.max("protocol_date")).first()[0]


def random_speeches(df: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    return sampling.random_rows(df, limit, seed)


def combined(archive: DataFrame, live: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return date_range(ingest.union_sources(archive, live), start, end)


def tweets(df: DataFrame) -> DataFrame:
    return df.select("created_at", "username", "text", "url")


def tweets_since(df: DataFrame, since) -> DataFrame:
    return df.where(F.col("created_at") >= F.lit(since)).agg(F.count("*").alias("n"))


def export(df: DataFrame, path: str, partitions: int = 8, codec: str = "zstd") -> None:
    """One row for each id, sorted by date and id, as Parquet: range partitions, so no single task sorts it all."""
    one = ingest.first_of_each(df, "id", ["protocol_date"])
    one.repartitionByRange(partitions, "protocol_date", "id").sortWithinPartitions("protocol_date", "id").write.option("compression", codec).mode("overwrite").parquet(path)


def backup(df: DataFrame, path: str) -> None:
    """All columns as Parquet; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("nothing to back up")
    df.write.option("compression", "snappy").parquet(path)


def rebuild(protocols: DataFrame, path: str, partitions: int = 8, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse, check for rows and repeated ids, write sorted; returns a report of what was written and the protocols that gave nothing."""
    protocols = ingest.first_protocols(protocols, limit)
    records = ingest.parse_records(protocols)
    if records.isEmpty():
        raise ValueError("no protocol has a speech")
    export(quality.assert_unique(records), path, partitions)
    stored = protocols.sparkSession.read.parquet(path)
    return ingest.rebuild_report(stored), ingest.unparsed(protocols, stored)


def by_protocol(df: DataFrame, path: str) -> None:
    """Replace whole protocols of a table partitioned by protocol: others aren't touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("protocol_id").parquet(path)


def listings(spark: SparkSession, path: str) -> DataFrame:
    """(protocol_id, protocol_date, file_url, listed_in) from XML listings."""
    kind = "dok_id string, datum string, filbilaga struct<fil: array<struct<url: string>>>"
    rows = spark.read.format("xml").option("rowTag", "dokument").schema(kind).load(path).withColumn("listed_in", F.input_file_name())
    return rows.select(F.lower("dok_id").alias("protocol_id"), F.col("datum").alias("protocol_date"), F.try_element_at("filbilaga.fil", F.lit(1))["url"].alias("file_url"), "listed_in")


def landed_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(protocol_id, path, content) of downloaded binary files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.lower(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("protocol_id"), "path", "content")


def generation_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines keyed by (model, topic, kind, sample); of several the last line of the last file by name counts."""
    rows = spark.read.schema("model string, topic string, kind string, sample int, text string").json(path)
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}  # lines of a block are in order
    rows = rows.withColumns(place).withColumn("_key", F.concat_ws("\x1f", "model", "topic", "kind", "sample"))
    return ingest.first_of_each(rows, "_key", [F.desc(c) for c in place]).drop("_key", *place)


def write_json(df: DataFrame, *paths: str) -> None:
    """A small report as one JSON array in each place, for static sites.  Reports are bounded by groups times years."""
    body = json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, default=str)
    for p in paths:
        Path(p).parent.mkdir(parents=True, exist_ok=True)
        Path(p).write_text(body, encoding="utf-8")


def training_rows(speeches: DataFrame, others: DataFrame | None = None, first_year: int | None = None, last_year: int | None = None, parties: Iterable[str] = schema.PARTIES) -> DataFrame:
    """(text, label, speaker): cleaned texts of known parties within the years, and other labelled texts."""
    rows = speeches.where(F.col("party").isin(list(parties)))
    if first_year is not None:
        rows = rows.where(F.col("year") >= first_year)
    if last_year is not None:
        rows = rows.where(F.col("year") <= last_year)
    out = rows.select(F.trim(F.regexp_replace("text", "\n", " ")).alias("text"), F.col("party").alias("label"), F.coalesce("speaker", F.lit(schema.UNKNOWN_SPEAKER)).alias("speaker"))
    return out if others is None else out.unionByName(others.select("text", "label", "speaker").where(F.col("label").isin(list(parties))))
