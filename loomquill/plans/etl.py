"""Registered ingest, sampling, evaluation, quality and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquill.functions import text
from loomquill.operators import ingest, model, quality, sampling
from loomquill.schema import PARTIES
from loomquill.sources import corpus
from loomquill.streaming import incremental

from . import views as V

ROLE_PARTY = {"user": "S", "assistant": "M", "system": "FP"}


def _doubled(spark, sf):
    """Every speech twice: as archived, and a day later in a live table with another text."""
    s = V.speeches(spark, sf).select("id", "protocol_date", "party", F.lit("archive").alias("origin"), F.length("text").alias("n"))
    live = s.select("id", F.date_add("protocol_date", 1).alias("protocol_date"), "party", F.lit("live").alias("origin"), (F.col("n") + 1).alias("n"))
    return s, live


def dedup_first(spark, sf):
    a, b = _doubled(spark, sf)
    return ingest.first_of_each(b.unionByName(a), "id", ["protocol_date", "origin"])


def dedup_report(spark, sf):
    a, b = _doubled(spark, sf)
    return ingest.dropped_by_year(a.unionByName(b).withColumn("year", F.year("protocol_date")))


def upsert_merge(spark, sf):
    a, b = _doubled(spark, sf)
    return ingest.upsert(a.where("party <> 'S'"), b.where("party in ('S', 'M')"))


def insert_if_absent(spark, sf):
    a, b = _doubled(spark, sf)
    return ingest.insert_if_absent(a.where("party <> 'S'"), b.where("party in ('S', 'M')"))


def union_dedup_sources(spark, sf):
    a, b = _doubled(spark, sf)
    return ingest.union_sources(a.where("protocol_date < '2015-01-01'"), b)


def replace_protocols(spark, sf):
    s = V.speeches(spark, sf).select("id", "protocol_id", "party")
    fresh = s.where("party = 'V'").withColumn("id", F.concat("id", F.lit("-new")))
    return ingest.replace_protocols(s, fresh)


def trim_archived(spark, sf):
    s = V.speeches(spark, sf).select("id", "protocol_date", "party")
    return ingest.trim(s, s.where("party <> 'MP'"), "2020-01-01")


def metadata_fallback(spark, sf):
    s = V.speeches(spark, sf)
    protocols = s.groupBy("protocol_id").agg(F.min("protocol_date").alias("protocol_date"), F.min("doc_id").alias("k"))
    listing = protocols.where("k % 30 < 20").select(F.lower("protocol_id").alias("protocol_id"), "protocol_date", F.concat(F.lit("u/"), "k").alias("file_url"), F.lit("a.xml").alias("listed_in"))
    later = protocols.where("k % 50 = 0").select(F.lower("protocol_id").alias("protocol_id"), "protocol_date", F.concat(F.lit("w/"), "k").alias("file_url"), F.lit("b.xml").alias("listed_in"))
    archive = protocols.where("k % 20 = 0").select("protocol_id", "protocol_date", F.concat(F.lit("v/"), "k").alias("file_url"))
    return ingest.with_metadata(protocols.select("protocol_id"), listing.unionByName(later), archive)


def furniture_lines(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("column_no"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return ingest.furniture_lines(d, share=0.05)


def _protocols(spark, sf):
    c = V.table(spark, sf, "conversations")
    party = F.create_map(*[F.lit(x) for p in ROLE_PARTY.items() for x in p])
    turn = F.concat(F.lit("Anf. "), F.col("turn") + 1, F.lit(" "), F.upper("role"), F.lit(" ("), F.coalesce(F.try_element_at(party, F.col("role")), F.lit("X")), F.lit("): "), F.coalesce("text", F.lit("")))
    t = c.select("conv_id", F.struct("turn", turn.alias("x")).alias("t")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["x"]), " ").alias("text"))
    return t.select(F.concat(F.lit("H"), "conv_id").alias("protocol_id"), F.lit("2020-01-01").alias("protocol_date"), "text", F.lit(None).cast("string").alias("file_url"))


def parse_records(spark, sf):
    return ingest.parse_records(_protocols(spark, sf)).select("id", "protocol_id", "speaker", "party", "text")


def speaker_slug(spark, sf):
    s = V.speeches(spark, sf).select("speaker").distinct()
    return s.select("speaker", text.slug(F.concat(F.lit(" Åsa Öberg-"), "speaker", F.lit(" é! "))).alias("slug"))


def date_range(spark, sf):
    return corpus.date_range(V.speeches(spark, sf), "2010-01-01", "2014-12-31").select("id", "protocol_date")


def balanced_sample(spark, sf):
    return sampling.balanced_sample(V.speeches(spark, sf), 20).select("id", "party")


def speaker_split(spark, sf):
    s = V.speeches(spark, sf)
    train, test = sampling.speaker_split(s, sampling.held_out_speakers(s))
    return train.select("id", F.lit("train").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))


def benchmark_sample(spark, sf):
    s = V.speeches(spark, sf)
    return sampling.benchmark_sample(s, sampling.held_out_speakers(s, 0.5), 5).select("id", "party")


def class_weights(spark, sf):
    return sampling.class_weights(V.speeches(spark, sf), "party").withColumn("weight", F.round("weight", 9))


def _judged(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    return V.table(spark, sf, "labels").join(d, "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") % 3 == 0).cast("int").alias("pred"))


def confusion_matrix(spark, sf):
    return sampling.confusion(_judged(spark, sf))


def confusion_macro_f1(spark, sf):
    m = sampling.metrics(_judged(spark, sf), [0, 1])
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "macro_f1")])


def profile_deviation(spark, sf):
    p = sampling.profiles(V.table(spark, sf, "embeddings"), [0.1 * i for i in range(8)])
    return p.select("label", "n", *[F.round(c, 5).alias(c) for c in p.columns[2:]])


def profile_reference(spark, sf):
    p = sampling.reference_of(sampling.profiles(V.table(spark, sf, "embeddings"), [0.1 * i for i in range(8)]))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


def mix_delta(spark, sf):
    s = V.speeches(spark, sf)
    m = quality.mix_delta(s.where("year < 2015"), s.where("year >= 2015"))
    return m.select("party", *[F.round(c, 6).alias(c) for c in ("old_pct", "new_pct", "delta")])


def quality_checks(spark, sf):
    return quality.internal_checks(V.speeches(spark, sf), id_shape=r"^\d+$", least_per_year=30, since={"SD": 2010})


def lost_probes(spark, sf):
    s = V.speeches(spark, sf).where("text is not null")
    changed = s.withColumn("text", F.when(F.col("party") == "V", F.reverse("text")).otherwise(F.col("text")))
    return quality.lost_probes(s, changed).select("id", "protocol_id")


def cost_per_1000(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.col("role").alias("model"), F.length("text").alias("prompt_tokens"), (F.col("turn") + 1).alias("completion_tokens"))
    prices = spark.createDataFrame([("user", 2e-6, 8e-6), ("assistant", 1e-6, 4e-6)], "model string, prompt_price double, completion_price double")
    return sampling.cost_per_1000(c, prices).withColumn("cost_per_1000", F.round("cost_per_1000", 6))


def speaker_normalise(spark, sf):
    s = V.speeches(spark, sf).select("speaker").distinct()
    return s.select("speaker", ingest.normalise_speaker(F.concat(F.lit("Statsrådet "), "speaker", F.lit(" Öberg"))).alias("name"))


def weekly_counts(spark, sf):
    return incremental.windowed_counts(V.table(spark, sf, "events"))


def user_sessions(spark, sf):
    return incremental.sessions(V.table(spark, sf, "events"))


def capped_feed(spark, sf):
    e = V.table(spark, sf, "events")
    return sampling.newest_of_each(e, 100, "event_type", "ts", "event_id").select("event_id", "event_type")


def classifier(spark, sf):
    """Held-out metrics of the linear classifier: which language a speech has, on speakers that it hasn't seen."""
    s = V.speeches(spark, sf).withColumnRenamed("lang", "label")
    train, test = sampling.speaker_split(s, sampling.held_out_speakers(s, 0.3))
    scored = model.predict(test.select("id", "text", "label"), model.train(train, features=1 << 12, rounds=10))
    return sampling.metrics(scored, ["de", "en", "es", "fr"])


QUERIES = {f.__name__: f for f in (dedup_first, dedup_report, upsert_merge, insert_if_absent, union_dedup_sources, replace_protocols, trim_archived, metadata_fallback, furniture_lines, parse_records, speaker_slug, date_range, balanced_sample, speaker_split, benchmark_sample, class_weights, confusion_matrix, confusion_macro_f1, profile_deviation, profile_reference, mix_delta, quality_checks, lost_probes, cost_per_1000, speaker_normalise, weekly_counts, user_sessions, capped_feed, classifier)}

_TWO = f"with {V.SPEECHES}, a as (select id, protocol_date, party, 'archive' as origin, cast(length(text) as int) as n from speeches), b as (select id, cast(protocol_date + 1 as date) as protocol_date, party, 'live' as origin, n + 1 as n from a)"
_JUDGED = "with j as (select quality as label, cast(n_chars % 3 = 0 as int) as pred from labels join documents using (doc_id))"
_F1 = "({a} + {b}) / 2"


def _part(x: str, y: str) -> str:
    return f"coalesce(({x})::double / nullif({y}, 0), 0.0)"


_K = [(f"count(*) filter (where label = {k} and pred = {k})", f"count(*) filter (where pred = {k})", f"count(*) filter (where label = {k})") for k in (0, 1)]
ORACLE = {
    "dedup_first": f"{_TWO} select * from a",
    "dedup_report": f"{_TWO}, u as (select year(protocol_date) as year, row_number() over (partition by id order by year(protocol_date)) as k from (select * from a union all select * from b)) select cast(year as int) as year, count(*) as dropped from u where k > 1 group by year",
    "upsert_merge": f"{_TWO} select * from a where party not in ('S', 'M') union all select * from b where party in ('S', 'M')",
    "insert_if_absent": f"{_TWO} select * from a where party <> 'S' union all select * from b where party = 'S'",
    "union_dedup_sources": f"{_TWO}, o as (select * from a where protocol_date < date '2015-01-01') select * from o union all select * from b where protocol_date > (select max(protocol_date) from o) and id not in (select id from o)",
    "replace_protocols": f"with {V.SPEECHES} select id || '-new' as id, protocol_id, party from speeches where party = 'V' union all select id, protocol_id, party from speeches where protocol_id not in (select protocol_id from speeches where party = 'V')",
    "trim_archived": f"with {V.SPEECHES} select id, protocol_date, party from speeches where not (protocol_date < date '2020-01-01' and party <> 'MP')",
    "metadata_fallback": f"""with {V.SPEECHES}, p as (select lower(protocol_id) as protocol_id, min(protocol_date) as protocol_date, min(doc_id) as k from speeches group by 1)
select protocol_id, protocol_date, case when k % 50 = 0 then 'w/' when k % 30 < 20 then 'u/' else 'v/' end || k as file_url from p where k % 50 = 0 or k % 30 < 20 or k % 20 = 0""",
    "furniture_lines": """with l as (select source as doc, doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as line from documents),
c as (select doc, greatest(3, cast(floor(count(distinct doc_id) * 0.05) as bigint)) as need from l group by doc),
n as (select doc, line, count(*) as n from l where line <> '' and len(string_split_regex(line, '\\s+')) <= 10 group by all)
select doc, line, n from n join c using (doc) where n >= need""",
    "parse_records": rf"""with t as (select conv_id, turn, upper(role) as speaker, case role when 'user' then 'S' when 'assistant' then 'M' when 'system' then 'L' end as party, regexp_replace(text, '^{V.WS}+|{V.WS}+$', '', 'g') as body from conversations)
select 'H' || conv_id || '_' || lower(speaker) || '_' || lower(party) as id, 'H' || conv_id as protocol_id, speaker, party, string_agg(body, chr(10) || chr(10) order by turn) as text from t where party is not null and body <> '' group by conv_id, speaker, party""",
    "speaker_slug": f"with {V.SPEECHES} select distinct speaker, 'asa-oberg-' || replace(lower(speaker), '_', '-') || '-e' as slug from speeches",
    "date_range": f"with {V.SPEECHES} select id, protocol_date from speeches where protocol_date between date '2010-01-01' and date '2014-12-31'",
    "balanced_sample": f"with {V.SPEECHES} select id, party from (select id, party, row_number() over (partition by party order by md5('42:' || id), id) as k from speeches where party is not null) where k <= 20",
    "speaker_split": f"with {V.SPEECHES} select id, case when ('0x' || substring(md5('42:' || coalesce(speaker, 'Okänd')), 1, 8))::bigint / 4294967296.0 < 0.15 then 'test' else 'train' end as part from speeches",
    "benchmark_sample": f"with {V.SPEECHES}, h as (select * from speeches where ('0x' || substring(md5('42:' || coalesce(speaker, 'Okänd')), 1, 8))::bigint / 4294967296.0 < 0.5 and year >= 2015 and length(text) > 200) select id, party from (select id, party, row_number() over (partition by party order by md5('42:' || id), id) as k from h where party is not null) where k <= 5",
    "class_weights": f"with {V.SPEECHES} select party, count(*) as n, round(1.0 / count(*)::double, 9) as weight from speeches group by party",
    "confusion_matrix": f"{_JUDGED} select label, pred, count(*) as n from j group by all",
    "confusion_macro_f1": f"""{_JUDGED} select count(*) as n, round(count(*) filter (where label = pred) / count(*), 6) as accuracy,
round(({_part(_K[0][0], _K[0][1])} + {_part(_K[1][0], _K[1][1])}) / 2, 6) as precision, round(({_part(_K[0][0], _K[0][2])} + {_part(_K[1][0], _K[1][2])}) / 2, 6) as recall,
round(({_part('2 * ' + _K[0][0], _K[0][1] + ' + ' + _K[0][2])} + {_part('2 * ' + _K[1][0], _K[1][1] + ' + ' + _K[1][2])}) / 2, 6) as macro_f1 from j""",
    "profile_deviation": "select label, count(*) as n, " + ", ".join(f"round(avg(embedding[{i + 1}]::double), 5) as raw_{i}" for i in range(8)) + ", " + ", ".join(f"round(avg(embedding[{i + 1}]::double) - {0.1 * i!r}, 5) as dev_{i}" for i in range(8)) + " from embeddings group by label",
    "profile_reference": "select " + ", ".join(f"round({0.1 * i!r}::double, 6) as ref_{i}" for i in range(8)),
    "mix_delta": f"""with {V.SPEECHES}, m as (select party, coalesce(count(*) filter (where year < 2015) * 100.0::double / nullif((select count(*) from speeches where year < 2015), 0), 0.0) as o, coalesce(count(*) filter (where year >= 2015) * 100.0::double / nullif((select count(*) from speeches where year >= 2015), 0), 0.0) as n from speeches where party is not null group by party)
select party, round(o, 6) as old_pct, round(n, 6) as new_pct, round(n - o, 6) as delta from m""",
    "quality_checks": f"""with {V.SPEECHES}, c as (
select 'text is present' as check_, count(*) filter (where text is null or trim(text) = '') as f from speeches
union all select 'party is present', count(*) filter (where party is null) from speeches
union all select 'id has its shape', count(*) filter (where not regexp_full_match(id, '\\d+')) from speeches
union all select 'party is known', count(*) filter (where party is not null and party not in {PARTIES}) from speeches
union all select 'no retired party', count(*) filter (where party = 'FP') from speeches
union all select 'no unreadable date', count(*) filter (where year is null) from speeches
union all select 'no SD before 2010', count(*) filter (where party = 'SD' and year < 2010) from speeches
union all select 'id is unique', count(*) from (select id from speeches group by id having count(*) > 1)
union all select 'years have over 30 rows', count(*) from (select year from speeches group by year having count(*) <= 30))
select check_ as "check", f as failures, f = 0 as ok from c""",
    "lost_probes": f"""with {V.SPEECHES}, q as (select id, protocol_id, party, trim(regexp_replace(text, '{V.WS}+', ' ', 'g')) as t, trim(regexp_replace(case when party = 'V' then reverse(text) else text end, '{V.WS}+', ' ', 'g')) as u from speeches where text is not null)
select id, protocol_id from q where length(substring(t, 1, 80)) >= 40 and not exists (select 1 from q r where r.protocol_id = q.protocol_id and contains(r.u, substring(q.t, 1, 80)))""",
    "cost_per_1000": "with p(model, pp, cp) as (values ('user', 2e-6, 8e-6), ('assistant', 1e-6, 4e-6)) select role as model, count(*) as n, round((sum(length(text)) * any_value(pp) + sum(turn + 1) * any_value(cp)) / count(*) * 1000, 6) as cost_per_1000 from conversations left join p on p.model = role group by role",
    "speaker_normalise": f"with {V.SPEECHES} select distinct speaker, upper(speaker || ' Öberg') as name from speeches",
    "weekly_counts": "select time_bucket(interval '7 days', ts, timestamp '1970-01-01') as start, event_type, count(*) as n from events group by all",
    "user_sessions": """with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end as b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from e) select min(ts) as start, max(ts) + interval '30 minutes' as "end", user_id, count(*) as n from s group by user_id, k""",
    "capped_feed": "select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by ts desc, event_id) as k from events) where k <= 100",
}
