"""Registered word statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquill.functions import text
from loomquill.operators import lexical as L
from loomquill.operators import series
from loomquill.schema import PARTIES

from . import views as V

Z_SQL = """
  ln((n + 0.01 * bg) / (ng + 0.01 * total - n - 0.01 * bg)) - ln(((bg - n) + 0.01 * bg) / ((total - ng) + 0.01 * total - (bg - n) - 0.01 * bg))
"""


def _ranked(group: str, least: int, top: int, stop: tuple[str, ...], source: str = "t", key: str | None = None) -> str:
    key = key or group
    return f"""
c as (select {key} as {group}, word, count(*)::double as n from {source} where {key} is not null group by all),
b as (select word, sum(n) as bg from c group by word having sum(n) >= {least}),
k as (select c.*, bg from c join b using (word)),
m as (select *, sum(n) over (partition by {group}) as ng, (select sum(bg) from b) as total from k),
z as (select {group}, word, ({Z_SQL}) / sqrt(1 / (n + 0.01 * bg) + 1 / ((bg - n) + 0.01 * bg)) as z from m),
r as (select *, row_number() over (partition by {group} order by z desc, word) as rank from z where z > 0)
select {group}, word, round(z, 6) as z, cast(rank as int) as rank from r where rank <= {top}"""


def _round_z(df):
    return df.withColumn("z", F.round("z", 6))


def meta_per_year(spark, sf):
    return L.per_year(V.speeches(spark, sf))


def token_counts_party(spark, sf):
    return L.token_table(V.speeches(spark, sf), ["party"], stopwords=V.STOP)


def distinctive_words(spark, sf):
    return _round_z(L.distinctive_words(V.speeches(spark, sf), "party", min_count=10, top_n=20, stopwords=V.STOP))


def distinctive_by_language(spark, sf):
    return _round_z(L.distinctive_words(V.speeches(spark, sf), "lang", min_count=5, top_n=50))


def full_scores(spark, sf):
    """The dense score table: every language and every background word."""
    counts = L.token_table(V.speeches(spark, sf), ["lang"])
    return _round_z(L.dense_log_odds(counts, "lang", min_count=5)).select("lang", "word", "n", "z")


def fingerprint_cards(spark, sf):
    ranked = L.distinctive_words(V.speeches(spark, sf), "party", min_count=10, top_n=60, stopwords=V.STOP)
    return series.card(ranked).select("party", "word", F.round("z", 6).alias("z"), F.round("bar", 6).alias("bar"))


def word_cloud(spark, sf):
    ranked = L.distinctive_words(V.speeches(spark, sf), "party", min_count=10, top_n=100, stopwords=V.STOP)
    cloud = L.cloud(_round_z(ranked))
    return cloud.select("party", F.size("words").alias("n"), F.array_join(F.array_sort(F.map_keys("words")), " ").alias("words"))


def top_movers(spark, sf):
    return _round_z(L.top_movers(V.speeches(spark, sf), None, 40, 10, stopwords=V.STOP))


def yearly_signatures(spark, sf):
    return _round_z(L.yearly_signatures(V.speeches(spark, sf), 14, 15, stopwords=V.STOP))


def _terms(spark, sf):
    return L.term_trajectories(V.speeches(spark, sf), V.TERMS)


def term_trajectories(spark, sf):
    return _terms(spark, sf).withColumn("rate", F.round("rate", 6))


def term_peaks(spark, sf):
    return series.peaks(_terms(spark, sf).withColumn("rate", F.round("rate", 6)))


def term_domain(spark, sf):
    return series.shared_domain(_terms(spark, sf)).select(F.round("top", 6).alias("top"))


def _frames(spark, sf):
    return L.frame_trajectories(V.speeches(spark, sf), V.FRAMES)


def frame_trajectories(spark, sf):
    return _frames(spark, sf)


def frame_pivot(spark, sf):
    return series.wide(_frames(spark, sf).where("frame = 'motion'"), PARTIES)


def year_captions(spark, sf):
    years = L.per_year(V.speeches(spark, sf))
    captions = spark.createDataFrame([(2001, "first"), (2008, "second"), (2019, "third")], "from_year int, caption string")
    return series.as_of(years, captions).select("year", "speeches", "caption")


def party_divergence(spark, sf):
    return L.divergence_by_year(V.speeches(spark, sf), 10, stopwords=V.STOP).withColumn("divergence", F.round("divergence", 6))


def stopwords_antijoin(spark, sf):
    """Counts without the words that at least half of all speeches of a language have."""
    s = V.speeches(spark, sf)
    have = s.select("lang", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("d"))
    size = s.groupBy("lang").agg(F.count("*").alias("docs"))
    common = have.join(F.broadcast(size), "lang").where("d * 2 >= docs")
    return L.without_words(L.token_table(s, ["lang"]), common)


def name_stopwords(spark, sf):
    return L.name_stopwords(V.speeches(spark, sf).withColumn("speaker", F.concat_ws(" ", "speaker", F.upper("lang"), F.upper(F.replace(F.substring("text", 1, 12), F.lit("ß"), F.lit("s"))))), exclude=V.STOP)


QUERIES = {f.__name__: f for f in (distinctive_words, meta_per_year, token_counts_party, distinctive_by_language, full_scores, fingerprint_cards, word_cloud, top_movers, yearly_signatures, term_trajectories, term_peaks, term_domain, frame_trajectories, frame_pivot, year_captions, party_divergence, stopwords_antijoin, name_stopwords)}

_TERM_ROWS = f"""{V.tokens_sql(1)}, y as (select year, count(*) as total from t group by year), w as (select unnest({[t.lower() for t in V.TERMS]}) as term),
h as (select year, word, count(*) as n from t group by all),
r as (select yy.year, w.term, round(coalesce(n, 0) / greatest(coalesce(total, 0), 1) * 10000.0, 6) as rate
  from (select distinct year from speeches) yy cross join w left join y on y.year = yy.year left join h on h.year = yy.year and h.word = w.term)"""
_STEMS = {f: "|".join(s) for f, s in V.FRAMES.items()}
_FRAME_ROWS = f"""{V.tokens_sql(1)}, c as (select year, party, {', '.join(f"count(*) filter (where regexp_matches(word, '{rx}')) as h{i}" for i, rx in enumerate(_STEMS.values()))}, count(*) as total from t group by all),
cells as (select distinct year, party from speeches where party is not null),
f as ({' union all '.join(f"select '{f}' as frame, cells.party, cells.year, round(coalesce(h{i}, 0) / greatest(coalesce(total, 0), 1) * 10000.0, 2) as rate from cells left join c on c.year = cells.year and c.party = cells.party" for i, f in enumerate(_STEMS))})"""
_PARTY = f"with {V.SPEECHES}, {V.tokens_sql(3, V.STOP)},"
ORACLE = {
    "meta_per_year": f"with {V.SPEECHES} select year, count(*) as speeches from speeches group by year",
    "token_counts_party": f"with {V.SPEECHES}, {V.tokens_sql(3, V.STOP)} select party, word, count(*) as n from t where party is not null group by all",
    "distinctive_words": _PARTY + _ranked("party", 10, 20, V.STOP),
    "distinctive_by_language": f"with {V.SPEECHES}, {V.tokens_sql(3)}," + _ranked("lang", 5, 50, ()),
    "full_scores": f"""with {V.SPEECHES}, {V.tokens_sql(3)}, c0 as (select lang, word, count(*)::double as n from t group by all),
b as (select word, sum(n) as bg from c0 group by word having sum(n) >= 5), g as (select distinct lang from c0),
k as (select g.lang, b.word, coalesce(n, 0) as n, bg from b cross join g left join c0 on c0.word = b.word and c0.lang = g.lang),
m as (select *, sum(n) over (partition by lang) as ng, (select sum(bg) from b) as total from k)
select lang, word, cast(n as bigint) as n, round(({Z_SQL}) / sqrt(1 / (n + 0.01 * bg) + 1 / ((bg - n) + 0.01 * bg)), 6) as z from m""",
    "fingerprint_cards": f"with q as ({_PARTY + _ranked('party', 10, 60, V.STOP).replace('round(z, 6) as z', 'z')}) select party, word, round(z, 6) as z, round(z / max(z) over (partition by party), 6) as bar from q where rank <= 12",
    "word_cloud": f"with q as ({_PARTY + _ranked('party', 10, 100, V.STOP)}) select party, cast(count(*) as int) as n, string_agg(word, ' ' order by word) as words from q group by party",
    "top_movers": f"with {V.SPEECHES}, {V.tokens_sql(3, V.STOP)}, p as (select floor(median(year)) as y from speeches), e as (select word, case when year >= (select y from p) then 'late' else 'early' end as era from t)," + _ranked("era", 10, 40, V.STOP, "e"),
    "yearly_signatures": _PARTY + _ranked("year", 15, 14, V.STOP),
    "term_trajectories": f"with {V.SPEECHES}, {_TERM_ROWS} select year, term, rate from r",
    "term_peaks": f"with {V.SPEECHES}, {_TERM_ROWS}, q as (select *, row_number() over (partition by term order by rate desc, year) as k from r) select term, year, rate from q where k = 1",
    "term_domain": f"with {V.SPEECHES}, {_TERM_ROWS} select greatest(max(rate), 0.1) as top from r",
    "frame_trajectories": f"with {V.SPEECHES}, {_FRAME_ROWS} select frame, party, year, rate from f",
    "frame_pivot": f"with {V.SPEECHES}, {_FRAME_ROWS} select year, " + ", ".join(f"coalesce(max(rate) filter (where party = '{p}'), 0.0) as \"{p}\"" for p in PARTIES) + " from f where frame = 'motion' group by year",
    "year_captions": f"with {V.SPEECHES}, c(from_year, caption) as (values (2001, 'first'), (2008, 'second'), (2019, 'third')) select year, count(*) as speeches, (select max_by(caption, from_year) from c where from_year <= year) as caption from speeches group by year",
    "party_divergence": f"""with {V.SPEECHES}, {V.tokens_sql(3, V.STOP)}, c as (select year, party, word, count(*)::double as n from t where party is not null group by all),
v as (select year, word from c group by all having sum(n) >= 10), k as (select c.* from c join v using (year, word)),
d as (select *, n / sum(n) over (partition by year, party) as p from k), g as (select distinct year, party from d),
pr as (select a.year, a.party as pa, b.party as pb from g a join g b on a.year = b.year and a.party < b.party),
x as (select pr.*, v.word, coalesce(da.p, 0) as p, coalesce(db.p, 0) as q from pr join v on v.year = pr.year
  left join d da on da.year = pr.year and da.party = pa and da.word = v.word left join d db on db.year = pr.year and db.party = pb and db.word = v.word),
j as (select year, pa, pb, 0.5 * sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end) + 0.5 * sum(case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as js from x group by all)
select year, round(avg(js), 6) as divergence from j group by year""",
    "stopwords_antijoin": f"""with {V.SPEECHES}, {V.tokens_sql(3)}, h as (select lang, word, count(distinct id) as d from t group by all), z as (select lang, count(*) as docs from speeches group by lang),
w as (select distinct word from h join z using (lang) where d * 2 >= docs) select lang, word, count(*) as n from t where word not in (select word from w) and lang is not null group by all""",
    "name_stopwords": f"""with {V.SPEECHES}, n as (select distinct speaker || ' ' || upper(lang) || ' ' || upper(replace(substring(text, 1, 12), 'ß', 's')) as s from speeches),
r as (select unnest(regexp_extract_all(s, '[A-ZÅÄÖ]{{2,}}')) as run from n), w as (select unnest(regexp_extract_all(lower(run), '[a-zA-ZÀ-ÖØ-öø-ÿ]+')) as word from r)
select distinct word from w where length(word) >= 3 and word not in {V.STOP}""",
}
