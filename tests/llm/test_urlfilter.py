import oracle
from pyspark.sql import functions as F

from loomquill.llm import urlfilter as U
from loomquill.llm.queries import QUERIES
from loomquill.llm.support import Bloom, collect_bloom


def test_canonical_forms(spark):
    same = ["http://www.A.com/x/", "https://a.com:443/x?utm_source=q", "HTTP://user@A.com/x#f"]
    other = ["https://a.com/x?b=1&a=2", "nothing", None, "http://a.com:8080/x", "http://[2001:DB8::1]:80/x", "http://[::1]:8080"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in same + other], "u string").select(U.canonical(F.col("u"))).collect()]
    assert got == ["a.com/x"] * 3 + ["a.com/x?a=2&b=1", None, None, "a.com:8080/x", "[2001:db8::1]/x", "[::1]:8080"]


def test_lists_exactly_what_is_listed_with_and_without_filter(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.com/p{i % 7}") for i in range(1000)] + [(None, "http://h1.com/p1"), (5, None), (6, ""), (6, "")], "page_id long, url string").withColumn("h", F.lit(1)).withColumn("listed", F.lit("x"))
    listed = spark.createDataFrame([(f"https://www.h{i}.com/p1/",) for i in range(0, 50, 3)] * 2 + [(None,)], "url string")
    want = {f"h{i}.com/p1" for i in range(0, 50, 3)}
    for size in (64 << 20, 0):
        rows = U.url_filter(pages, listed, size).collect()
        assert len(rows) == 1004
        assert all(r.listed == (r.canonical_url in want) for r in rows) and any(r.listed for r in rows)
    assert not any(r.listed for r in U.url_filter(pages, listed.limit(0)).collect())
    assert U.url_filter(pages.limit(0), listed).count() == 0


def test_very_long_urls_and_clashing_columns(spark):
    long = "http://a.com/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long), (2, long + "/"), (3, long + "y")], "page_id long, url string").withColumns({c: F.lit(1) for c in ("canonical_url", "_block", "w0", "block")})
    rows = U.url_filter(pages, spark.createDataFrame([(long,)], "url string")).collect()
    assert {r.page_id: r.listed for r in rows} == {1: True, 2: True, 3: False}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    b = collect_bloom(keys, "h", 5000)
    import numpy as np

    h = keys.toPandas().h.to_numpy().view(np.uint64)
    assert isinstance(b, Bloom) and b.hit(h).all()
    out = spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h")).toPandas().h.to_numpy().view(np.uint64)
    assert b.hit(out).mean() < 0.05
    small = collect_bloom(keys, "h", 5000, 64)
    assert len(small.table) == 2 and small.hit(h).all()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not oracle.difference(QUERIES["op3_url_filter"](spark, sf), U.SQL, sf)
