"""Jobs: the incremental run, the back-fill, and the reports of a static site, each made of the library's operators."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquill import schema
from loomquill.operators import ingest, lexical, series
from loomquill.sources import corpus

log = logging.getLogger(__name__)


def run_etl(spark: SparkSession, protocols: Callable[[], DataFrame | None], load_speeches: Callable[[DataFrame], None], tweets: Callable[[], DataFrame | None], load_tweets: Callable[[DataFrame], None]) -> dict[str, int]:
    """New protocols, then new posts; each half is loaded only if it has rows.  Returns the numbers of rows and of protocols set aside."""
    out = {"speeches": 0, "set_aside": 0, "tweets": 0}
    docs = protocols()
    if docs is not None:
        records = ingest.parse_records(docs)
        out["speeches"] = records.count()
        for r in ingest.unparsed(docs, records).limit(100).collect():  # a log of a hundred lines at most
            log.warning("no speech in %s: %s", r.protocol_id, r.reason)
        out["set_aside"] = docs.select("protocol_id").distinct().count() - records.select("protocol_id").distinct().count()
        if out["speeches"]:
            load_speeches(records)
    posts = tweets()
    if posts is not None:
        out["tweets"] = posts.count()
        if out["tweets"]:
            load_tweets(posts)
    return out


def backfill(years: Iterable[int], fetch: Callable[[int], DataFrame], load: Callable[[DataFrame], None]) -> dict[int, int | None]:
    """Year by year; a year that fails is logged and skipped.  Returns the number of speeches of each year, None for one that failed."""
    out: dict[int, int | None] = {}
    for year in years:
        try:
            records = ingest.parse_records(fetch(year))
            out[year] = records.count()
            if out[year]:
                load(records)
        except Exception:
            log.exception("year %s is skipped", year)
            out[year] = None
    return out


def notable_terms(risers: DataFrame, fallers: DataFrame, curated: Sequence[str], each: int = 15) -> DataFrame:
    """(word, place): top risers, top fallers, then a list of words, each once."""
    spark = risers.sparkSession
    listed = spark.createDataFrame([(w, i) for i, w in enumerate(curated)], "word string, rank int")
    return lexical.ordered_union([risers.where(F.col("rank") <= each), fallers.where(F.col("rank") <= each), listed])


def site_reports(speeches: DataFrame, split_year: int, frames: Mapping[str, Sequence[str]], curated: Sequence[str] = (), stopwords: Iterable[str] = (), top_n: int = 60, parties: Sequence[str] = schema.PARTIES) -> dict[str, DataFrame]:
    """The seven reports by name, over (protocol_date, year, party, speaker, text).

    Names of speakers are stop words.  One token table by year and party serves the rankings; it is rolled up for each.
    """
    names = lexical.name_stopwords(speeches)
    tokens = lexical.without_words(lexical.token_table(speeches, ["year", "party"], stopwords=stopwords), names)
    rank = lambda keys, least, n, group: lexical.top_words(lexical.log_odds(lexical.regroup(tokens, keys), group, 0.01, least), group, n)
    eras = tokens.withColumn("era", F.when(F.col("year") >= split_year, "late").otherwise("early"))
    movers = lexical.top_words(lexical.log_odds(lexical.regroup(eras, ["era"]), "era", 0.01, 30), "era", 40)
    notable = [r.word for r in notable_terms(movers.where("era = 'late'"), movers.where("era = 'early'"), curated).orderBy("place").collect()]  # at most 30 and the curated
    z = lambda df, digits=2: df.withColumn("z", F.round("z", digits))
    return {
        "meta": lexical.per_year(speeches),
        "distinctive": z(rank(["party"], 10, top_n, "party")).where(F.col("party").isin(list(parties))),
        "movers": z(movers),
        "trajectories": lexical.term_trajectories(speeches, notable).withColumn("rate", F.round("rate", 2)),
        "divergence": lexical.divergence_by_year(speeches, 10).withColumn("divergence", F.round("divergence", 4)),
        "year_signatures": z(rank(["year"], 15, 14, "year"), 1),
        "party_frames": lexical.frame_trajectories(speeches, frames),
    }


def build_site(speeches: DataFrame, folders: Sequence[str], **options) -> list[str]:
    """Write every report as JSON to each folder."""
    reports = site_reports(speeches, **options)
    for name, df in reports.items():
        corpus.write_json(df, *[f"{f}/{name}.json" for f in folders])
    corpus.write_json(series.shared_domain(reports["trajectories"]), *[f"{f}/domain.json" for f in folders])
    return list(reports)
