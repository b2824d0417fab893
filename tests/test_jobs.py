import json

from loomquill import jobs
from loomquill.operators import dimensions, ingest, tone
from loomquill.plans import etl, views
from loomquill.sources import corpus

SF = "/root/testdata/sf0.001"


def test_site_reports_are_written_to_every_folder(spark, tmp_path):
    s = views.speeches(spark, SF)
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    names = jobs.build_site(s, folders, split_year=2012, frames=views.FRAMES, curated=("que", "the"), stopwords=views.STOP)
    assert names == ["meta", "distinctive", "movers", "trajectories", "divergence", "year_signatures", "party_frames"]
    for n in [*names, "domain"]:
        a, b = (json.loads((tmp_path / f / f"{n}.json").read_text()) for f in "ab")
        assert a == b and a
    assert sum(r["speeches"] for r in json.loads((tmp_path / "a" / "meta.json").read_text())) == s.count()
    assert {r["term"] for r in json.loads((tmp_path / "a" / "trajectories.json").read_text())} >= {"que", "the"}


def test_etl_and_backfill(spark):
    docs = etl._protocols(spark, SF)
    got = []
    out = jobs.run_etl(spark, lambda: docs, lambda df: got.append(df.count()), lambda: None, lambda df: got.append("never"))
    assert out["speeches"] == got[0] == ingest.parse_records(docs).count() and out["tweets"] == 0

    def fetch(year):
        if year == 2001:
            raise OSError("no such year")
        return docs

    assert jobs.backfill([2000, 2001, 2002], fetch, lambda df: None) == {2000: got[0], 2001: None, 2002: got[0]}


def test_launched_dimensions():
    launched = dimensions.launch(views.SIDES) if "klasskonflikt" in tone.REGISTRY else None
    if launched is None:
        tone.register(dimensions.klasskonflikt(views.SIDES, "article"))
        launched = dimensions.launch(views.SIDES)
    assert set(launched) == {"lix", "hen", "klasskonflikt"}
    assert launched["hen"].per == 100_000 and not launched["lix"].evidentiary and launched["klasskonflikt"].patterns.words


def test_last_line_of_the_last_file_counts(spark, tmp_path):
    line = lambda n, t: json.dumps({"model": "m", "topic": "t", "kind": "k", "sample": n, "text": t}) + "\n"
    (tmp_path / "a.jsonl").write_text(line(1, "old") + line(2, "first") + line(2, "second"))
    (tmp_path / "b.jsonl").write_text(line(1, "new"))
    assert {r.sample: r.text for r in corpus.generation_cache(spark, str(tmp_path)).collect()} == {1: "new", 2: "second"}


def test_repeated_changes_without_an_order_are_settled_by_content(spark):
    kind = "id string, v int"
    changes = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], kind)
    for parts in (1, 3):
        assert [tuple(r) for r in ingest.upsert(spark.createDataFrame([("a", 0)], kind), changes.repartition(parts)).collect()] == [("a", 3)]


def test_words_within_others_are_counted_too(spark):
    df = spark.createDataFrame([("the end of the day. Day", "S", 2000)], "text string, party string, year int")
    rows = tone.pair_report(df, [("the", "end of the day", "ratio"), ("day", None, "decline")], min_mentions=0).where("level = 'all'").collect()
    assert {(r.gendered, r.gendered_hits, r.neutral_hits) for r in rows} == {("the", 2, 1), ("day", 2, 0)}


def test_rebuild_reports_what_gave_nothing(spark, tmp_path):
    docs = etl._protocols(spark, SF).unionByName(spark.createDataFrame([("Hx", "2020-01-01", "nothing", None)], "protocol_id string, protocol_date string, text string, file_url string"))
    report, gone = corpus.rebuild(docs, str(tmp_path / "out"), 2)
    assert report.first().speeches == ingest.parse_records(docs).count() and ("Hx", "no speech marker") in {tuple(r) for r in gone.collect()}
