from loomquill.streaming import incremental as N
from pyspark.sql import functions as F


def _rows(spark, out):
    return {(r.id, r.version, r.v) for r in spark.read.parquet(out).collect()}


def test_upsert_stream_keeps_the_highest_version(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    kind = "id string, version int, v string"
    steps = [[("a", 2, "x"), ("b", 1, "x")], [("a", 1, "late old"), ("b", 2, "y"), ("c", 1, "y"), ("c", 2, "z")], [("c", 2, "again")]]
    want = [{("a", 2, "x"), ("b", 1, "x")}, {("a", 2, "x"), ("b", 2, "y"), ("c", 2, "z")}, {("a", 2, "x"), ("b", 2, "y"), ("c", 2, "again")}]
    for rows, after in zip(steps, want):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        N.upsert_stream(N.read_files(spark, src, kind), out, ck).awaitTermination()
        assert _rows(spark, out) == after
    N.upsert_stream(N.read_files(spark, src, kind), out, ck).awaitTermination()
    assert _rows(spark, out) == want[-1]
    # from the start again, in one batch
    N.upsert_stream(N.read_files(spark, src, kind), out, str(tmp_path / "ck2")).awaitTermination()
    assert {r[:2] for r in _rows(spark, out)} == {r[:2] for r in want[-1]}


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    kind = "id string, version int, v string"
    spark.createDataFrame([(str(i), 1, "x") for i in range(200)], kind).write.parquet(src)
    N.upsert_stream(N.read_files(spark, src, kind), out, ck).awaitTermination()
    files = {str(p) for p in (tmp_path / "out").rglob("*.parquet")}
    spark.createDataFrame([("7", 2, "y")], kind).write.mode("append").parquet(src)
    N.upsert_stream(N.read_files(spark, src, kind), out, ck).awaitTermination()
    after = {str(p) for p in (tmp_path / "out").rglob("*.parquet")}
    assert len({f.split("key_bucket=")[1].split("/")[0] for f in files ^ after}) == 1 and len(_rows(spark, out)) == 200


def _events(spark):
    kind = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")


def _all(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_equal_the_batch_form(spark):
    batch = N.windowed_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    got = _all(spark, N.windowed_counts(_events(spark)), "weeks", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_first_seen(spark):
    got = _all(spark, N.first_seen(_events(spark), "user_id", delay="60 days"), "seen")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()


def test_quota(spark):
    got = _all(spark, N.monthly_quota(_events(spark), 7), "quota")
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").count()
    assert {(r.month, r.event_type): r["count"] for r in got.groupBy("month", "event_type").count().collect()} == {(r.month, r.event_type): min(7, r["count"]) for r in whole.collect()}


def test_quota_admits_the_first_in_time_over_several_arrow_batches(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.sql("select id as event_id, timestamp'2024-01-20' - make_interval(0, 0, 0, 0, id, 0, 0) as ts, 'x' as event_type from range(20)").coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = _all(spark, N.monthly_quota(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), 4), "early")
        assert {r.event_id for r in got.collect()} == {16, 17, 18, 19}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quota_state_goes_with_the_month(spark, tmp_path):
    """A second run in the same checkpoint: January's state has expired, February's holds."""
    src, out, ck = (str(tmp_path / x) for x in ("e", "out", "ck"))
    kind = "event_id long, ts timestamp, event_type string"
    for k, day in enumerate(("2024-01-05", "2024-02-10", "2024-02-11", "2024-03-20")):
        spark.sql(f"select id + {k * 10} as event_id, timestamp'{day}' as ts, 'x' as event_type from range(3)").coalesce(1).write.mode("append").parquet(src)
        quota = N.monthly_quota(N.read_files(spark, src, kind), 4)
        quota.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert got == [0, 1, 2, 10, 11, 12, 20, 30, 31, 32]
    state = spark.read.format("statestore").load(ck).collect()
    assert {r.key.month for r in state} == {"2024-03"}
