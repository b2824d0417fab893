import math

import pytest
from loomquill.functions import stats
from loomquill.operators import lexical as L
from loomquill.operators import tone as T
from pyspark.sql import functions as F


def z_of_the_paper(y, n, rest, rest_n, words, alpha=0.01):
    """Monroe, Colaresi and Quinn (2008), with a prior of alpha times the background counts."""
    prior = alpha * (y + rest)
    a0 = alpha * words
    d = math.log((y + prior) / (n + a0 - y - prior)) - math.log((rest + prior) / (rest_n + a0 - rest - prior))
    return d / math.sqrt(1 / (y + prior) + 1 / (rest + prior))


@pytest.mark.parametrize("c", [(50, 1000, 200, 10000), (2, 1000, 200, 10000), (20, 1000, 200, 10000), (0, 500, 200, 10000), (1, 5, 9, 100)])
def test_cell_z(spark, c):
    h, n, bh, bn = c
    got = spark.range(1).select(stats.cell_z(*map(F.lit, c), 0.01)).first()[0]
    assert got == pytest.approx(z_of_the_paper(h, n, bh - h, bn - n, bn), rel=1e-9)


@pytest.mark.parametrize("c", [(0, 0, 10, 100), (10, 100, 10, 100), (0, 10, 0, 100), (10, 10, 100, 100)])
def test_undefined_z(spark, c):
    assert spark.range(1).select(stats.cell_z(*map(F.lit, c), 0.01)).first()[0] is None


def test_smoothing(spark):
    value = lambda *c: spark.range(1).select(stats.smoothed_rate(*map(F.lit, c), 0.01, 1000.0)).first()[0]
    assert value(0, 0, 160, 8000) == pytest.approx(20.0) and value(2, 10, 160, 8000) == pytest.approx(40.0)
    assert value(1, 10, 0, 0) == 100.0


@pytest.mark.parametrize("c", [(-1, 1, 1, 1), (2, 1, 5, 5), (1, 1, 5, 4), (3, 5, 2, 9)])
def test_impossible_counts(spark, c):
    with pytest.raises(Exception, match="impossible counts"):
        spark.range(1).select(stats.checked_counts(F.lit(1.0), *map(F.lit, c))).collect()


def test_lix(spark):
    assert spark.range(1).select(stats.lix(F.lit(10), F.lit(2), F.lit(3)), stats.lix(F.lit(0), F.lit(2), F.lit(0))).first()[:] == (35.0, 0.0)


@pytest.fixture
def two(spark):
    rows = [("a", "skatt " * 100 + "klimat " * 2 + "vård " * 40), ("b", "skatt " * 2 + "klimat " * 100 + "vård " * 40), ("c", None), (None, "skatt")]
    return spark.createDataFrame(rows, "party string, text string")


def test_log_odds_are_symmetric(two):
    z = {(r.party, r.word): r.z for r in L.log_odds(L.token_table(two, ["party"]), min_count=5).collect()}
    assert z["a", "skatt"] == pytest.approx(-z["b", "skatt"]) and z["a", "skatt"] > 3 and abs(z["a", "vård"]) < 1e-9
    assert z["a", "skatt"] == pytest.approx(z_of_the_paper(100, 142, 2, 142, 284))
    top = L.top_words(L.log_odds(L.token_table(two, ["party"]), min_count=5), top_n=5).collect()
    assert {(r.party, r.word) for r in top} == {("a", "skatt"), ("b", "klimat")}


def test_dense_table_and_unseen_words(spark):
    df = spark.createDataFrame([("a", "x1x " * 9), ("b", "yyy " * 9 + "zzz")], "party string, text string")
    counts = L.token_table(df, ["party"], min_length=1)
    dense = {(r.party, r.word): r.z for r in L.dense_log_odds(counts, min_count=5).collect()}
    assert set(dense) == {(p, w) for p in "ab" for w in ("x", "yyy")} and dense["a", "yyy"] < 0


def test_divergence_of_equal_and_disjoint_groups(spark):
    rows = [(2010, "a", "ett " * 9), (2010, "b", "tvåå " * 9), (2020, "a", "ett tvåå " * 9), (2020, "b", "ett tvåå " * 5), (2021, "a", "ett " * 9), (2022, "a", "ett"), (2022, "b", "tre")]
    df = spark.createDataFrame(rows, "year int, party string, text string")
    got = {r.year: r.divergence for r in L.divergence_by_year(df, 5).collect()}
    assert set(got) == {2010, 2020} and got[2010] == pytest.approx(1) and got[2020] == pytest.approx(0, abs=1e-12)


def test_trajectories_and_frames(spark):
    df = spark.createDataFrame([(2018, "S", "skatt " + "ord " * 199), (2019, "S", None)], "year int, party string, text string")
    assert {(r.year, r.term): r.rate for r in L.term_trajectories(df, ["Skatt"], 10_000).collect()} == {(2018, "skatt"): 50.0, (2019, "skatt"): 0.0}
    assert {(r.frame, r.year): r.rate for r in L.frame_trajectories(df, {"f": ["kat"]}).collect()} == {("f", 2018): 50.0, ("f", 2019): 0.0}
    with pytest.raises(ValueError):
        L.frame_trajectories(df, {"f": ["två ord"]})


def test_movers_and_years(spark):
    df = spark.createDataFrame([(2010, "gammal sak")] * 30 + [(2020, "nytt ting")] * 30, "year int, text string")
    got = {(r.era, r.word) for r in L.top_movers(df).collect()}
    assert got == {("early", "gammal"), ("early", "sak"), ("late", "nytt"), ("late", "ting")}
    d = spark.createDataFrame([("2019-03-01",), ("2022-11-15",), ("not-a-date",), (None,)], "protocol_date string")
    assert [r.year for r in L.add_year(d).collect()] == [2019, 2022]


def test_name_stopwords(spark):
    df = spark.createDataFrame([("Statsrådet ANNA ÖST (S)",), ("BO",), (None,)], "speaker string")
    assert {r.word for r in L.name_stopwords(df, exclude=["anna"]).collect()} == {"öst"}


def test_cells_pool_before_they_divide(spark):
    df = spark.createDataFrame([("S", 2020, 1, 1), ("S", 2020, 0, 99), ("M", 2020, 5, 100), ("M", 2021, 0, 10), (None, 2020, 7, 7)], "party string, year int, hits int, n int")
    got = {(r.party, r.year): r for r in T.aggregate_cells(df).collect()}
    assert got["S", 2020].rate == 10.0 and got["S", 2020].speeches == 2 and got["M", 2021].z is None
    assert got["S", 2020].smoothed == pytest.approx((1 + 0.06) / (100 + 2) * 1000)
    assert {(r.party, r.year) for r in T.suppress_thin_cells(T.aggregate_cells(df), 2).collect()} == {("S", 2020)}


def test_density(spark):
    rows = [("S", y, h, 10, 1) for y, h in [(1, 0), (2, 0), (3, 4), (4, 0), (5, 2)]] + [("M", 1, 0, 10, 1), ("M", 2, 8, 10, 1)]
    got = T.hit_density(spark.createDataFrame(rows, "party string, year int, hits int, n int, speeches int")).first()
    assert got[:] == (4.0, 0.25, 3.0, 14.0)
    none = T.hit_density(spark.createDataFrame([], "party string, year int, hits int, n int, speeches int")).first()
    assert none[:] == (0.0, 1.0, 0.0, 0.0)


def test_lix_measures(spark):
    df = spark.createDataFrame([("S", 2020, "Kort mening här. " * 30), ("S", 2020, "För kort"), ("S", 2020, None)], "party string, year int, text string")
    m = T.measure_lix(df)
    assert [r.included for r in m.collect()] == [True, False, False]
    assert T.excluded_share(m).first()[0] == pytest.approx(2 / 3)
    assert T.aggregate_lix(m).count() == 0 and T.aggregate_lix(m, min_sentences=30).first().rate == pytest.approx(3.0)


def test_receipts_highlight_the_pattern(spark):
    from loomquill.functions.text import Patterns

    df = spark.createDataFrame([(str(i), "S", 2020, f"Före {i}. Här är folk idag! Efter. Sist.") for i in range(9)], "id string, party string, year int, text string")
    got = T.sample_receipts(df, Patterns(("folk",)), "d").collect()
    assert len(got) == 3 and all(r.context[r.hl_start : r.hl_end] == "folk" and r.context.startswith("Före") and r.context.endswith("Efter.") for r in got)
    more = df.unionByName(df.withColumn("year", F.lit(2021)))
    again = [r for r in T.sample_receipts(more, Patterns(("folk",)), "d").collect() if r.year == 2020]
    assert {r.speech_id for r in got} == {r.speech_id for r in again}
    assert all(r.hl_start is None for r in T.sample_receipts(df, Patterns(("folk",)), "d", evidentiary=False).collect())


def test_dimensions():
    from loomquill.functions.text import Patterns

    ok = T.Dimension("t1", "structural", lambda df: df)
    T.register(ok)
    with pytest.raises(ValueError):
        T.register(ok)
    with pytest.raises(ValueError):
        T.Dimension("x", "lexical", lambda df: df)
    with pytest.raises(ValueError):
        T.Dimension("x", "stylometric", lambda df: df)
    T.Dimension("x", "stylometric", lambda df: df, evidentiary=False)
    T.Dimension("x", "lexical", lambda df: df, patterns=Patterns(("a",)))


@pytest.mark.parametrize("kind", ["spans", "receipts", "patterns"])
def test_offsets_of_a_batch_take_little_memory(spark, monkeypatch, kind):
    """200 000 sentences, each with a match: their offsets are kept as numbers, never as objects."""
    import tracemalloc

    import pyarrow as pa
    from loomquill.functions.text import Patterns

    made = []
    monkeypatch.setattr(T.F, "arrow_udf", lambda _: lambda f: lambda c: made.append(f) or c)
    {"spans": T.sentence_spans, "receipts": lambda c: T.receipts_of(c, Patterns(("folk",))), "patterns": lambda c: T.find_spans(c, Patterns(("folk",)))}[kind](F.col("text"))
    texts = pa.array(["Ett folk kom hit. " * 400] * 500 + [None, ""])
    tracemalloc.start()
    got = made[0](texts)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert [len(x) for x in got.to_pylist()] == [400] * 500 + [0, 0] and most < 25


def test_receipts_count_characters_outside_the_first_plane(spark):
    from loomquill.functions.text import Patterns

    df = spark.createDataFrame([("1", "S", 2020, "Bort. Före \U0001f600 nu. Här \U0001f600 är Folk idag! Efter \U0001f600. Sist."), ("2", "S", 2020, None), ("3", "S", 2020, "folk")], "id string, party string, year int, text string")
    got = {r.speech_id: (r.context, r.context[r.hl_start : r.hl_end], r.pattern) for r in T.sample_receipts(df, Patterns(("folk",)), "d").collect()}
    assert got == {"1": ("Före \U0001f600 nu. Här \U0001f600 är Folk idag! Efter \U0001f600.", "Folk", "folk"), "3": ("folk", "folk", "folk")}
