import datetime as dt

import pytest
from loomquill.operators import ingest as I
from loomquill.operators import quality as Q
from loomquill.operators import sampling as S
from loomquill.operators import series
from loomquill.sources import corpus, listing, tables
from pyspark.sql import functions as F

TALK = "Anf. 1 Anna Andersson (S): Hej på er. Anf. 2 Erik Eriksson (M) replik: Nej. Anf. 3 ANNA ANDERSSON (s): Igen. Anf. 4 Ola Ek (XX): bort Anf. 5 Per Pil (fp):   Anf. 6 Lo Lind (FP): Ja. Anf. 7 TALMANNEN: Anf. 8 Eva (V): Sist"


def protocols(spark, *texts):
    return spark.createDataFrame([(f"H{i}", "2020-01-02", t, None) for i, t in enumerate(texts)], "protocol_id string, protocol_date string, text string, file_url string")


def test_parser(spark):
    got = {r.id: (r.speaker, r.party, r.text) for r in I.parse_records(protocols(spark, TALK)).collect()}
    assert got == {
        "H0_anna-andersson_s": ("ANNA ANDERSSON", "S", "Hej på er.\n\nIgen."),
        "H0_erik-eriksson_m": ("Erik Eriksson", "M", "Nej."),
        "H0_lo-lind_l": ("Lo Lind", "L", "Ja."),
        "H0_eva_v": ("Eva", "V", "Sist"),
    }


def test_ids_do_not_depend_on_earlier_speeches(spark):
    a = {r.id for r in I.parse_records(protocols(spark, TALK)).collect()}
    b = {r.id for r in I.parse_records(protocols(spark, "Anf. 1 Ny Talare (C): Först. " + TALK)).collect()}
    assert b - a == {"H0_ny-talare_c"} and a <= b
    assert I.parse_records(protocols(spark, "ingen talare", "", None)).count() == 0


def test_furniture_and_protocol_text(spark):
    lines = [("d", c, i, x) for c in range(4) for i, x in enumerate(["Prot. 2019/20:1", "Kammaren i dag", "ord-", f"sak {c}", "12", "3 mars", "----", ""])]
    df = spark.createDataFrame(lines, "doc string, column_no int, line_no int, line string")
    assert {(r.line, r.n) for r in I.furniture_lines(df).collect()} >= {("Kammaren i dag", 4), ("ord-", 4)}
    few = df.where("column_no < 2")
    assert I.protocol_text(few).first().text == "Kammaren i dag ordsak 0 Kammaren i dag ordsak 1"


def test_page_columns(spark):
    two = [("d", 1, 100.0, 5.0, 45.0)] * 20 + [("d", 1, 100.0, 55.0, 95.0)] * 20
    one = [("d", 2, 100.0, 5.0, 95.0)] * 20
    got = {r.page: (r.gutter, r.straddle, r.two_columns) for r in I.page_columns(spark.createDataFrame(two + one, "doc string, page int, width double, x0 double, x1 double")).collect()}
    assert got == {1: (46.0, 0, True), 2: (40.0, 20, False)}


def test_upserts(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    c = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "id string, v int")
    assert {tuple(r) for r in I.upsert(t, c, order=[F.desc("v")]).collect()} == {("a", 1), ("b", 3), ("c", 2)}
    assert {tuple(r) for r in I.insert_if_absent(t, c, order=["v"]).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    again = I.upsert(I.upsert(t, c, order=[F.desc("v")]), c, order=[F.desc("v")])
    assert again.count() == 3
    with pytest.raises(ValueError):
        I.trim(t, t.limit(0), "2020-01-01", date_col="v")


def test_speaker_names(spark):
    df = spark.createDataFrame([("Statsrådet ANNA Ek",), ("Anna Ek",), (None,)], "s string")
    assert [r[0] for r in df.select(I.normalise_speaker(F.col("s"))).collect()] == ["ANNA EK", "ANNA EK", ""]


def test_sources(spark, tmp_path):
    rows = [("a", "2020-01-02", "S", "t1"), ("b", "bad", "M", "t2"), ("c", "2021-05-01", "V", "t3")]
    df = spark.createDataFrame(rows, "id string, protocol_date string, party string, text string")
    df.write.parquet(str(tmp_path / "x"))
    assert [r.id for r in corpus.load_corpus(spark, str(tmp_path / "x"), "2020-01-02", "2020-12-31").collect()] == ["a"]
    df.unionByName(df).write.parquet(str(tmp_path / "y"))
    with pytest.raises(ValueError, match="more than once"):
        corpus.load_corpus(spark, str(tmp_path / "y"))
    assert corpus.load_historical(spark, None).count() == 0
    good = corpus.load_historical(spark, str(tmp_path / "x"))
    assert corpus.latest_date(good) == dt.date(2021, 5, 1) and corpus.latest_date(good.limit(0)) is None
    corpus.export(good.where("protocol_date is not null"), str(tmp_path / "z"), 2)
    assert spark.read.parquet(str(tmp_path / "z")).count() == 2
    with pytest.raises(ValueError):
        corpus.backup(good.limit(0), str(tmp_path / "q"))
    corpus.write_json(good.select("id"), str(tmp_path / "o" / "a.json"), str(tmp_path / "p.json"))
    assert (tmp_path / "p.json").read_text() == (tmp_path / "o" / "a.json").read_text()
    p = str(tmp_path / "parts")
    corpus.by_protocol(spark.createDataFrame([("a", "P1"), ("b", "P2")], "id string, protocol_id string"), p)
    corpus.by_protocol(spark.createDataFrame([("c", "P1")], "id string, protocol_id string"), p)
    assert {(r.id, r.protocol_id) for r in spark.read.parquet(p).collect()} == {("c", "P1"), ("b", "P2")}


def test_listings_and_files(spark, tmp_path):
    (tmp_path / "l.xml").write_text("<dokumentlista><dokument><dok_id>H1</dok_id><datum>2020-01-01</datum><filbilaga><fil><url>u</url></fil></filbilaga></dokument><dokument><dok_id>H2</dok_id></dokument></dokumentlista>")
    got = {r.protocol_id: r.file_url for r in corpus.listings(spark, str(tmp_path / "l.xml")).collect()}
    assert got == {"h1": "u", "h2": None}
    (tmp_path / "H9.pdf").write_bytes(b"x")
    assert [r.protocol_id for r in corpus.landed_files(spark, str(tmp_path)).collect()] == ["h9"]
    (tmp_path / "c.jsonl").write_text('{"model":"m","topic":"t","kind":"k","sample":1,"text":"old"}\n{"model":"m","topic":"t","kind":"k","sample":1,"text":"new"}\n')
    assert [r.text for r in corpus.generation_cache(spark, str(tmp_path / "c.jsonl")).collect()] == ["new"]


def test_fetching(tmp_path):
    answers = iter([(429, b""), (200, b"ok")])
    waits = []
    assert listing.fetch_with_retry(lambda u: next(answers), "u", sleep=waits.append) == b"ok" and waits == [60.0]
    assert listing.fetch_with_retry(lambda u: (500, b""), "u", sleep=waits.append) is None
    with pytest.raises(RuntimeError):
        listing.fetch_with_backoff(lambda u: (503, b""), "u", sleep=waits.append)
    assert listing.fetch_cached(lambda u: (200, b"pdf"), "u", tmp_path / "f").read_bytes() == b"pdf"
    asked = []
    assert listing.widening_listing(lambda a, b: (asked.append((b - a).days) or (len(asked) == 3, b"x")), dt.date(2020, 1, 31)) == b"x" and asked == [7, 14, 21]
    assert listing.widening_listing(lambda a, b: (0, b""), dt.date(2020, 1, 31)) is None
    assert list(listing.all_pages(lambda p: (5, [1, 2] if p < 3 else [3]))) == [1, 2, 1, 2, 3]


def test_tables(tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("pattern,slot,subtype,exclude_next\n Folk ,ingroup,,\nde rikaste,outgroup,economic,länderna|kommunerna\n")
    p = tables.pattern_table(str(f))
    assert p.words == ("folk", "de rikaste") and p.excludes == {"de rikaste": ("länderna", "kommunerna")} and p.subset("outgroup", "economic").words == ("de rikaste",)
    with pytest.raises(FileNotFoundError):
        tables.pattern_table(str(tmp_path / "none.csv"))
    for body in ("pattern\n", "x\n1\n", "pattern\na\nA\n", 'pattern,x\n" ",1\n'):
        g = tmp_path / f"{abs(hash(body))}.csv"
        g.write_text(body)
        with pytest.raises(ValueError):
            tables.pattern_table(str(g))
    (tmp_path / "l.csv").write_text("ord,kategori,vikt\nBra,pos,1.5\nbra,pos,2\ninte alls,neg,x\n")
    lex = tables.lexicon(tmp_path / "l.csv")
    assert lex.singles == {"pos": {"bra": 2.0}, "neg": {}} and lex.phrases["neg"] == {"inte alls": 0.0}
    (tmp_path / "s.txt").write_text("# c\nOch\n\n")
    assert tables.stopwords(tmp_path / "s.txt") == {"och"}
    (tmp_path / "q.csv").write_text("gendered,neutral,measure\nlärarinna,lärare,ratio\nfru,,decline\n")
    assert tables.pair_table(str(tmp_path / "q.csv")) == (("lärarinna", "lärare", "ratio"), ("fru", None, "decline"))


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(str(i), f"s{i % 40}", "A" if i % 3 else "B") for i in range(400)], "id string, speaker string, party string")
    b = S.balanced_sample(df, 10)
    assert {r.party: r["count"] for r in b.groupBy("party").count().collect()} == {"A": 10, "B": 10}
    held = S.held_out_speakers(df, 0.3)
    train, test = S.speaker_split(df, held)
    assert train.count() + test.count() == 400 and not {r.speaker for r in train.collect()} & {r.speaker for r in test.collect()}
    more = S.held_out_speakers(df.unionByName(df.withColumn("speaker", F.concat(F.lit("new"), "speaker"))), 0.3)
    assert {r.speaker for r in held.collect()} == {r.speaker for r in more.collect() if not r.speaker.startswith("new")}
    assert {round(r.weight * r.n) for r in S.class_weights(df, "party").collect()} == {1}
    assert S.random_rows(df, 7).count() == 7


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1), (1, 1), (1, 0)], "label int, pred int")
    m = S.metrics(df, [0, 1, 2]).first()
    assert m.accuracy == pytest.approx(4 / 6) and m.macro_f1 == pytest.approx((0.75 + 0.5 + 0) / 3)
    p = spark.createDataFrame([("x", {"S": 0.4, "M": 0.4}), ("y", {"V": 1.0})], "id string, probs map<string,double>")
    assert [r[0] for r in p.select(S.argmax_label(F.col("probs"))).collect()] == ["M", "V"]
    assert [(r.label, r.p) for r in S.ranked_probabilities(p, ["S", "M", "V"]).where("id = 'y'").orderBy("rank").collect()] == [("V", 1.0), ("M", 0.0), ("S", 0.0)]
    t = spark.createDataFrame([("I say SD.",), ("kristdemokraterna",), ("??",), (None,)], "t string")
    assert [r[0] for r in t.select(S.parse_party(F.col("t"), ["SD", "KD"], {"Kristdemokraterna": "KD"})).collect()] == ["SD", "KD", None, None]


def test_calibration_and_json(spark):
    p = spark.createDataFrame([({"S": 0.4, "M": 0.6}, "M"), ({"V": 1.0}, "S")], "probs map<string,double>, label string")
    assert S.argmax_accuracy(p).first()[:] == (2, 0.5)
    r = spark.createDataFrame([("S", 2020, 0.123456), ("S", 2021, None)], "party string, year int, rate double")
    assert [x.json for x in series.json_rows(r, {"rate": 3}).collect()] == ['{"party":"S","year":2020,"rate":0.123}', '{"party":"S","year":2021,"rate":null}']
    assert series.nested(r, "party", "year").first()["values"] == {"2020": 0.123456, "2021": None}
    v = spark.createDataFrame([(-0.001,), (1.005,), (-2.5,)], "x double")
    assert [x[0] for x in v.select(series.two_decimals(F.col("x"))).collect()][::2] == ["0", "-2.50"]
    checks = spark.createDataFrame([("a", 0, True), ("b", 3, False)], "check string, failures int, ok boolean")
    with pytest.raises(ValueError, match=r"b \(3\)"):
        Q.require(checks)
    Q.require(checks.where("ok"))


def test_plan_of_generations(spark):
    d = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} {'int' if c == 'sample' else 'string'}")
    done = spark.createDataFrame([("m", "t", "k", 1)], "model string, topic string, kind string, sample int")
    assert S.open_plan(d("model", "m"), d("topic", "t", "u"), d("kind", "k"), d("sample", 1, 2), done).count() == 3


def test_plan_of_generations_has_no_task_for_each_combination(spark, capsys):
    d = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} {'int' if c == 'sample' else 'string'}")
    done = spark.createDataFrame([("m", "t", "k", 1)] * 50 + [("m", None, "k", 1), ("m", "u", "k", 2)], "model string, topic string, kind string, sample int")
    got = S.open_plan(d("model", "m", "n"), d("topic", "t", "u", None), d("kind", "k"), d("sample", 1, 2), done)
    got.explain()
    assert "CartesianProduct" not in capsys.readouterr().out
    every = {(m, t, "k", x) for m in "mn" for t in ("t", "u", None) for x in (1, 2)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == every - {("m", "t", "k", 1), ("m", "u", "k", 2)}


def test_quality(spark):
    df = spark.createDataFrame([("H1_a_s", "S", "text", 2020), ("H1_a_s", "SD", " ", 2005), ("bad", "FP", None, None)], "id string, party string, text string, year int")
    got = {r.check: r.failures for r in Q.internal_checks(df, since={"SD": 2010}, least_per_year=0).collect()}
    assert got == {"text is present": 2, "party is present": 0, "id has its shape": 1, "party is known": 1, "no retired party": 1, "no unreadable date": 1, "no SD before 2010": 1, "id is unique": 1, "years have over 0 rows": 0}
    assert Q.differences(df, df.limit(0)).count() == 3 and Q.differences(df, df).count() == 0
    assert Q.lost_protocols(spark.createDataFrame([("a",), ("b",)], "protocol_id string"), spark.createDataFrame([("a",)], "protocol_id string")).count() == 1


def test_series(spark):
    r = spark.createDataFrame([(2001, "a", 1.0), (2003, "a", 1.0), (2002, "b", 5.0)], "year int, term string, rate double")
    assert {(x.term, x.year) for x in series.peaks(r).collect()} == {("a", 2001), ("b", 2002)}
    assert series.spine(r, r).count() == 6 and series.shared_domain(r).first()[0] == 5.0 and series.shared_domain(r.limit(0)).first()[0] == 0.1
