"""Further registered queries: filters, reports, samples, measures and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquill import schema
from loomquill.operators import dimensions, ingest, lexical, quality, sampling, series, tone
from loomquill.sources import corpus

from . import etl
from . import lexical as lex
from . import tone as tone_plans
from . import views as V

CURATED = ("que", "the", "absent")


def corpus_counts(spark, sf):
    s = V.speeches(spark, sf)
    return s.agg(F.count("*").alias("speeches"), F.max("protocol_date").alias("last"))


def random_speeches(spark, sf):
    return corpus.random_speeches(V.speeches(spark, sf), 25).select("id")


def training_rows(spark, sf):
    return corpus.training_rows(V.speeches(spark, sf), None, 2008, 2019, ("S", "M", "V"))


def valid_parties(spark, sf):
    return ingest.valid_parties(V.speeches(spark, sf), ("S", "M", "V")).select("id", "party")


def year_of_text_dates(spark, sf):
    s = V.speeches(spark, sf).select("id", F.when(F.col("doc_id") % 7 == 0, "not-a-date").otherwise(F.col("protocol_date").cast("string")).alias("d"))
    return lexical.add_year(s, "d").select("id", "year")


def group_totals(spark, sf):
    s = V.speeches(spark, sf).withColumn("party", F.when(F.col("doc_id") % 50 == 3, "none").otherwise(F.col("party")))
    return lexical.group_totals(s.withColumn("text", F.when(F.col("party") != "none", F.col("text"))))


def chamber_cells(spark, sf):
    """The constant group of the pronoun's dimension, with words that these texts have."""
    m = dimensions.measure_hen(V.speeches(spark, sf), patterns=V.PATTERNS)
    c = tone.aggregate_cells(m, group_col=dimensions.CHAMBER, per=dimensions.HEN_PER)
    return c.select("chamber", "year", "hits", "n", "speeches", F.round("rate", 6).alias("rate"))


def hen_cells(spark, sf):
    return dimensions.HEN_DIMENSION.cells(V.speeches(spark, sf)).select("chamber", "year", "hits", "n", "speeches", "rate")


def lix_dimension(spark, sf):
    return dimensions.LIX_DIMENSION.cells(V.speeches(spark, sf)).select("party", "year", "hits", "n", "speeches", F.round("rate", 6).alias("rate"))


def folk_hits(spark, sf):
    return dimensions.measure_folk(V.speeches(spark, sf), V.SIDES).select("id", "n", "hits")


def antielit_hits(spark, sf):
    return dimensions.measure_antielit(V.speeches(spark, sf), V.SIDES, subtype="link").select("id", "n", "hits")


def klasskonflikt_cells(spark, sf):
    c = dimensions.klasskonflikt(V.SIDES, "article").cells(V.speeches(spark, sf))
    return c.select("party", "year", "hits", "n", "speeches", F.round("rate", 6).alias("rate"))


def series_spine(spark, sf):
    rates = lex.term_trajectories(spark, sf).where("year % 3 = 0")
    return series.spine(rates, lexical.per_year(V.speeches(spark, sf)))


def rates_as_text(spark, sf):
    return lex.term_trajectories(spark, sf).select("year", "term", series.two_decimals(F.col("rate")).alias("rate"))


def notable_terms(spark, sf):
    from loomquill.jobs import notable_terms

    m = lexical.top_movers(V.speeches(spark, sf), None, 40, 10, stopwords=V.STOP)
    return notable_terms(m.where("era = 'late'"), m.where("era = 'early'"), CURATED, 5)


def protocol_limit(spark, sf):
    return ingest.first_protocols(V.speeches(spark, sf).select("protocol_id").distinct(), 12)


def rebuild_report(spark, sf):
    return ingest.rebuild_report(V.speeches(spark, sf))


def dry_run(spark, sf):
    """What replacing some protocols by shortened ones would change."""
    s = V.speeches(spark, sf)
    return ingest.changed_ids(s, s.where("doc_id % 10 < 4 and doc_id % 3 <> 0").unionByName(s.where("doc_id % 20 = 0").withColumn("id", F.concat("id", F.lit("x")))), 15)


def unparsed_protocols(spark, sf):
    p = etl._protocols(spark, sf).withColumn("n", F.substring("protocol_id", 2, 20).cast("long"))
    text = F.when(F.col("n") % 5 == 0, None).when(F.col("n") % 5 == 1, "  ").when(F.col("n") % 5 == 2, "nothing said").otherwise(F.col("text"))
    p = p.withColumn("text", text).drop("n")
    return ingest.unparsed(p, ingest.parse_records(p))


def lost_protocols(spark, sf):
    s = V.speeches(spark, sf)
    return quality.lost_protocols(s, s.where("doc_id % 40 >= 10"))


def stop_union(spark, sf):
    """The union of two stop lists as a table."""
    s = V.speeches(spark, sf)
    return lexical.name_stopwords(s).unionByName(s.select(F.col("lang").alias("word"))).distinct()


def precision_sample(spark, sf):
    return sampling.precision_sample(V.speeches(spark, sf), 50).select("id", "party")


def frozen_test_rows(spark, sf):
    s = V.speeches(spark, sf)
    return sampling.test_rows(s, s.where("doc_id % 3 = 1").select("id"), sampling.held_out_speakers(s), 4).select("id", "party")


def _probs(spark, sf):
    """A map of pseudo-probabilities by label, from the first components of the vectors."""
    e = V.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.create_map(*[x for k in range(4) for x in (F.lit(f"c{k}"), F.round(F.abs(F.col("embedding")[k].cast("double")), 2))]).alias("probs"))


def argmax_label(spark, sf):
    return _probs(spark, sf).select("id", sampling.argmax_label(F.col("probs")).alias("label"))


def ranked_probabilities(spark, sf):
    return sampling.ranked_probabilities(_probs(spark, sf), ("c3", "c2", "c1", "c0", "c9"))


def probability_vector(spark, sf):
    return _probs(spark, sf).select("id", F.posexplode(sampling.as_vector(F.col("probs"), ("c9", "c1", "c3"))).alias("k", "p"))


def reference_mean(spark, sf):
    e = V.table(spark, sf, "embeddings").withColumn("id", F.col("vec_id").cast("string"))
    r = sampling.reference_distribution(e, 20, id_col="id", dims=4)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def parsed_answers(spark, sf):
    s = V.speeches(spark, sf).select("id", sampling.parse_party(F.concat(F.lit("answer: "), F.col("party"), F.lit("?")), schema.PARTIES, {}).alias("party"))
    return s


def tweets_since(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("created_at"))
    return corpus.tweets_since(e, "2024-01-15")


def distinct_counts(spark, sf):
    return V.speeches(spark, sf).agg(*[F.count_distinct(c).alias(c) for c in ("party", "speaker", "year", "lang")])


def open_generations(spark, sf):
    """What of a plan of generations isn't in the cache."""
    kind = lambda n, rows: spark.createDataFrame([(r,) for r in rows], n)
    done = V.table(spark, sf, "conversations").select(F.col("role").alias("model"), F.concat(F.lit("t"), F.col("turn") % 3).alias("topic"), F.lit("speech").alias("kind"), (F.col("conv_id") % 4).cast("int").alias("sample"))
    return sampling.open_plan(kind("model string", ["user", "assistant", "other"]), kind("topic string", ["t0", "t1", "t2", "t3"]), kind("kind string", ["speech", "neutral"]), kind("sample int", [0, 1, 2, 3]), done)


QUERIES = {f.__name__: f for f in (corpus_counts, random_speeches, training_rows, valid_parties, year_of_text_dates, group_totals, chamber_cells, hen_cells, lix_dimension, folk_hits, antielit_hits, klasskonflikt_cells, series_spine, rates_as_text, notable_terms, protocol_limit, rebuild_report, dry_run, unparsed_protocols, lost_protocols, stop_union, precision_sample, frozen_test_rows, argmax_label, ranked_probabilities, probability_vector, reference_mean, parsed_answers, tweets_since, distinct_counts, open_generations)}

_S = f"with {V.SPEECHES}"
_P = "p as (select vec_id as id, unnest([0, 1, 2, 3]) as k, embedding from embeddings), q as (select id, 'c' || k as label, round(abs(embedding[k + 1]::double), 2) as p from p)"
_TERMS = lex._TERM_ROWS
_FOLK, _LINK, _ARTICLE = (V.SIDES.subset(*x).words for x in (("ingroup",), ("outgroup", "link"), ("outgroup", "article")))
_TOP = f"""{V.tokens_sql(3, V.STOP)}, p as (select floor(median(year)) as y from speeches), e as (select word, case when year >= (select y from p) then 'late' else 'early' end as era from t)"""
_RANKS = lex._ranked("era", 10, 40, V.STOP, "e").rsplit("\nselect", 1)[0]
ORACLE = {
    "corpus_counts": f"{_S} select count(*) as speeches, max(protocol_date) as last from speeches",
    "random_speeches": f"{_S} select id from speeches order by md5('42:' || id), id limit 25",
    "training_rows": f"{_S} select trim(replace(text, chr(10), ' '), ' ') as text, party as label, coalesce(speaker, '{schema.UNKNOWN_SPEAKER}') as speaker from speeches where party in ('S', 'M', 'V') and year between 2008 and 2019",
    "valid_parties": f"{_S} select id, party from speeches where party in ('S', 'M', 'V')",
    "year_of_text_dates": f"{_S} select id, year from speeches where doc_id % 7 <> 0",
    "group_totals": f"{_S}, g as (select id, case when doc_id % 50 = 3 then 'none' else party end as party from speeches), {V.tokens_sql(3)}, k as (select id, count(*) as c from t group by id) select g.party, count(*) as texts, cast(sum(case when g.party = 'none' then 0 else coalesce(c, 0) end) as bigint) as tokens from g left join k using (id) where g.party is not null group by g.party",
    "chamber_cells": f"{tone_plans._M}, c as (select year, sum(hits)::bigint as hits, sum(n)::bigint as n, count(*) as speeches from m group by year) select 'chamber' as chamber, year, hits, n, speeches, case when n > 0 then round(hits / n * 100000.0, 6) else 0.0 end as rate from c",
    "hen_cells": f"{tone_plans._m(dimensions.HEN.words)}, c as (select year, sum(hits)::bigint as hits, sum(n)::bigint as n, count(*) as speeches from m group by year) select 'chamber' as chamber, year, hits, n, speeches, case when n > 0 then hits / n * 100000.0 else 0.0 end as rate from c",
    "lix_dimension": f"{tone_plans._LIX}, c as (select party, year, sum(words)::bigint as n, sum(sentences)::bigint as se, sum(long_words)::bigint as hits, count(*) as speeches from l where included and party is not null group by all) select party, year, hits, n, speeches, round(n / se + hits * 100.0 / n, 6) as rate from c where se >= 50",
    "folk_hits": f"{tone_plans._m(_FOLK)} select id, cast(n as int) as n, cast(hits as int) as hits from m",
    "antielit_hits": f"{tone_plans._m(_LINK)} select id, cast(n as int) as n, cast(hits as int) as hits from m",
    "klasskonflikt_cells": f"{tone_plans._m(_ARTICLE)}{tone_plans._CELLS} select party, year, hits, n, speeches, case when n > 0 then round(hits / n * 1000.0, 6) else 0.0 end as rate from c where speeches >= 8",
    "series_spine": f"{_S}, {_TERMS}, z as (select * from r where year % 3 = 0) select yy.year, w.term, coalesce(z.rate, 0.0) as rate from (select distinct year from speeches) yy cross join (select distinct term from z) w left join z on z.year = yy.year and z.term = w.term",
    "rates_as_text": f"{_S}, {_TERMS} select year, term, case when round(rate, 2) = 0 then '0' else printf('%.2f', rate) end as rate from r",
    "notable_terms": f"""{_S}, {_TOP}, {_RANKS}, u as (select word, 0 as l, rank from r where era = 'late' and rank <= 5 union all select word, 1, rank from r where era = 'early' and rank <= 5 union all select * from (values {", ".join(f"('{w}', 2, {i})" for i, w in enumerate(CURATED))})),
f as (select word, min(l * 1000 + rank) as nth from u group by word) select word, cast(row_number() over (order by nth, word) as int) as place from f""",
    "protocol_limit": f"{_S} select distinct protocol_id from speeches order by protocol_id limit 12",
    "rebuild_report": f"{_S} select count(*) as speeches, count(distinct protocol_id) as protocols, count(distinct speaker) as speakers, count(distinct party) as parties, min(protocol_date) as first_date, max(protocol_date) as last_date from speeches",
    "dry_run": f"{_S}, n as (select protocol_id, id from speeches where doc_id % 10 < 4 and doc_id % 3 <> 0 union all select protocol_id, id || 'x' from speeches where doc_id % 20 = 0), p as (select distinct protocol_id from n order by protocol_id limit 15) select protocol_id, (select count(*) from speeches s where s.protocol_id = p.protocol_id and s.id not in (select id from n)) as removed, (select count(*) from n where n.protocol_id = p.protocol_id and n.id not in (select id from speeches)) as added from p",
    "lost_protocols": f"{_S} select distinct protocol_id from speeches where protocol_id not in (select protocol_id from speeches where doc_id % 40 >= 10)",
    "stop_union": f"{_S}, r as (select unnest(regexp_extract_all(speaker, '[A-ZÅÄÖ]{{2,}}')) as run from speeches), w as (select unnest(regexp_extract_all(lower(run), '[a-zA-ZÀ-ÖØ-öø-ÿ]+')) as word from r) select word from w where length(word) >= 3 union select lang from speeches",
    "precision_sample": f"{_S} select id, party from (select id, party, row_number() over (partition by party order by md5('13:' || id), id) as k from speeches where party is not null) where k <= greatest(1, 50 // (select count(distinct party) from speeches))",
    "frozen_test_rows": f"{_S} select id, party from (select id, party, row_number() over (partition by party order by md5('42:' || id), id) as k from speeches where party is not null and doc_id % 3 = 1) where k <= 4",
    "argmax_label": f"with {_P} select id, min(label) as label from q where p = (select max(p) from q x where x.id = q.id) group by id",
    "ranked_probabilities": f"with {_P}, a as (select id, label, p from q union all select vec_id, 'c9', 0.0 from embeddings) select id, label, p, cast(row_number() over (partition by id order by p desc, label) as int) as rank from a",
    "probability_vector": f"with {_P} select id, 0 as k, 0.0::double as p from q group by id union all select id, case label when 'c1' then 1 else 2 end, p from q where label in ('c1', 'c3')",
    "reference_mean": "with k as (select *, row_number() over (partition by label order by md5('42:' || vec_id::varchar), vec_id::varchar) as k from embeddings where label is not null) select " + ", ".join(f"round(avg(embedding[{i + 1}]::double), 6) as ref_{i}" for i in range(4)) + " from k where k <= 20",
    "parsed_answers": f"{_S} select id, case when party = 'V' then 'S' else party end as party from speeches",
    "tweets_since": "select count(*) as n from events where ts >= timestamp '2024-01-15'",
    "distinct_counts": f"{_S} select count(distinct party) as party, count(distinct speaker) as speaker, count(distinct year) as year, count(distinct lang) as lang from speeches",
    "open_generations": "with a as (select * from (values ('user'), ('assistant'), ('other')) m(model), (values ('t0'), ('t1'), ('t2'), ('t3')) t(topic), (values ('speech'), ('neutral')) k(kind), (values (0), (1), (2), (3)) s(sample)) select model, topic, kind, cast(sample as int) as sample from a where not (kind = 'speech' and exists (select 1 from conversations c where c.role = model and 't' || (c.turn % 3) = topic and c.conv_id % 4 = sample))",
}
