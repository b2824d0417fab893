"""Incremental ingest: keyed upserts by micro-batch, de-duplication within a watermark, windowed counts, quotas.

The state of each query is bounded by its watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomquill.operators import ingest


def read_files(spark, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def upsert_stream(changes: DataFrame, target: str, checkpoint: str, key: str = "id", version: str = "version", buckets: int = 32) -> StreamingQuery:
    """Keep a table of the row with the highest version of each key (of equal versions the later batch's), partitioned by key_bucket.

    A batch reads and rewrites only the buckets of its keys: they are merged beside the table, then put in place.  A late row with an older
    version changes nothing, and a batch that is run again merges to the same table.
    """

    def merge(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = batch.withColumn("key_bucket", bucket)
        touched = [r[0] for r in new.select("key_bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        both = new.withColumn("_batch", F.lit(1))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.schema(new.schema).parquet(target).where(F.col("key_bucket").isin(touched))
            both = both.unionByName(old.withColumn("_batch", F.lit(0)))
        rest = [F.desc(F.to_json(F.struct(*batch.columns)))]
        staged = f"{target.rstrip('/')}-staged"
        ingest.first_of_each(both, key, [F.desc(version), F.desc("_batch"), *rest]).drop("_batch").write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket").parquet(target)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """With a watermark, which needs a timestamp with time zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_seen(events: DataFrame, key: str = "id", ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """Each key once within the watermark."""
    return _timed(events, ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 week", group_col: str = "event_type", delay: str = "1 day") -> DataFrame:
    """(start, group, n) for tumbling windows; late rows beyond `delay` are left out."""
    timed = _timed(events, ts, delay) if events.isStreaming else events
    counts = timed.groupBy(F.window(ts, size), group_col).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), group_col, "n")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", group_col: str = "user_id", delay: str = "1 day") -> DataFrame:
    timed = _timed(events, ts, delay) if events.isStreaming else events
    counts = timed.groupBy(F.session_window(ts, gap), group_col).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), group_col, "n")


def monthly_quota(events: DataFrame, quota: int, id_col: str = "event_id", ts: str = "ts", group_col: str = "event_type", delay: str = "1 day") -> DataFrame:
    """The rows that fit into a monthly quota of each group, in the order of time and id within a micro-batch.

    What an earlier micro-batch admitted stays admitted.  The state is one number a group and month, and goes when the watermark has
    passed the month; rows that come later than that are left out.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        take = None
        for pdf in batches:  # a group may come in several parts: only the first rows of all of them so far are held
            both = pdf if take is None else pd.concat([take, pdf])
            take = both.sort_values([ts, id_col], kind="stable").head(max(0, quota - used))
        n = 0 if take is None else len(take)
        state.update((used + n,))
        end = int((pd.Timestamp(f"{key[0]}-01", tz="UTC") + pd.offsets.MonthBegin(1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if n:
            yield take[[id_col, "month", group_col]]

    kinds = dict(events.dtypes)
    keyed = _timed(events, ts, delay).select(id_col, ts, group_col, F.date_format(F.trunc(ts, "month"), "yyyy-MM").alias("month"))
    schema = f"{id_col} {kinds[id_col]}, month string, {group_col} {kinds[group_col]}"
    return keyed.groupBy("month", group_col).applyInPandasWithState(admit, schema, "used long", "append", GroupStateTimeout.EventTimeTimeout)
