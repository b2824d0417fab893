import hashlib
from collections import Counter

from pyspark.sql import functions as F

from loomquill.llm import media as M
from loomquill.llm import textkit as tk


def payloads(rng):
    block = [rng.randbytes(9000) for _ in range(3)]
    rows = [(i, rng.randbytes(rng.randrange(300)) + rng.choice(block) + rng.randbytes(rng.randrange(3000)) + rng.choice(block)) for i in range(60)]
    return rows + [(1, rows[1][1]), (None, rows[2][1]), (100, b""), (101, None), (102, block[0] * 50), (103, b"\xff\xfe" * 9000)]


def test_round_trip_and_sharing(spark, rng):
    rows = payloads(rng)
    df = spark.createDataFrame(rows, "media_id long, payload binary").withColumn("uid", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("refs", F.lit(1))
    got = M.media_chunks(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), p) for i, p in rows if p is not None)
    assert sorted((str(r.media_id), bytes(r.payload)) for r in got if r.payload is not None) == want
    for r in got:
        if r.media_id == 101:
            assert r.payload is None and r.verified is None and r.chunks is None
        else:
            assert r.verified and r.sha256 == hashlib.sha256(bytes(r.payload)).hexdigest() and r.n_bytes == len(r.payload)
    assert sum(r.n_shared > 0 for r in got) > 50
    # chunks by their definition: how often each one occurs in the whole table
    count = Counter(c for r in got for c in r.chunks or ())
    assert all(r.n_shared == sum(count[c] > 1 for c in r.chunks or ()) for r in got)


def test_a_tiny_filter_changes_nothing(spark, rng, monkeypatch):
    from loomquill.llm import chunkstore as cs

    df = spark.createDataFrame(payloads(rng), "media_id long, payload binary")
    want = sorted(map(str, M.media_chunks(df).collect()))
    full = cs.collect_bloom
    monkeypatch.setattr(cs, "collect_bloom", lambda h, c, n: full(h, c, n, 32))
    assert sorted(map(str, M.media_chunks(df).collect())) == want


def test_chunks_are_what_the_cutter_says(spark, rng):
    import numpy as np
    import xxhash

    rows = payloads(rng)[:10]
    got = {r.media_id: r.chunks for r in M.media_chunks(spark.createDataFrame(rows, "media_id long, payload binary")).collect()}
    for i, p in rows:
        (cuts,) = tk.cdc_cuts(np.frombuffer(p, dtype=np.uint8), np.array([0, len(p)]), *M.SIZES)
        assert got[i] == [xxhash.xxh3_128_hexdigest(p[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]


def test_damaged_store_is_noticed(spark, rng):
    from loomquill.llm import chunkstore as cs

    rows = payloads(rng)[:20]
    media = spark.createDataFrame(rows, "media_id long, payload binary")
    held = cs.repeated(media.select("payload"), M.SIZES, "t")
    store = cs.store(media.select("payload"), M.SIZES, held, bytes)
    kept = M.manifest(media, held)
    bad = store.withColumn("payload", F.concat("payload", F.lit(b"!")))
    assert M.reconstruct(kept, store).where("verified").count() == kept.count() > 0
    assert M.reconstruct(kept, bad).where("verified or payload is not null").count() == 0


def test_empty_table(spark):
    assert M.media_chunks(spark.createDataFrame([], "media_id long, payload string")).count() == 0


def test_boundaries_move_with_the_content(rng):
    import numpy as np

    data = rng.randbytes(200_000)
    shifted = b"inserted" + data
    ends = lambda x: {x[a:b] for c in tk.cdc_cuts(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]), *M.SIZES) for a, b in zip([0, *c[:-1]], c)}
    a, b = ends(data), ends(shifted)
    assert len(a & b) >= len(a) - 4
