"""Registered sentence, pattern, readability and lexicon queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquill.functions import text
from loomquill.operators import tone as T

from . import views as V


def clean_text(spark, sf):
    return V.speeches(spark, sf).select("id", text.clean_text(F.col("text")).alias("text"))


def sentence_count(spark, sf):
    return V.speeches(spark, sf).select("id", F.size(text.sentences(F.col("text"))).alias("n"))


def sentence_offsets(spark, sf):
    s = V.speeches(spark, sf).select("id", T.sentence_spans(F.col("text")).alias("spans"))
    return s.select("id", F.posexplode("spans").alias("k", "s")).select("id", "k", "s.start", "s.end")


def _measured(spark, sf):
    return T.measure(V.speeches(spark, sf), V.PATTERNS)


def pattern_hits(spark, sf):
    return _measured(spark, sf).select("id", "n", "hits")


def pattern_spans(spark, sf):
    s = V.speeches(spark, sf).select("id", F.explode(T.find_spans(F.col("text"), V.PATTERNS)).alias("s"))
    return s.select("id", "s.start", "s.end", "s.pattern")


def _cells(spark, sf):
    return T.aggregate_cells(_measured(spark, sf))


def cells_rate(spark, sf):
    return _cells(spark, sf).select("party", "year", "hits", "n", "speeches", F.round("rate", 6).alias("rate"))


def cells_smoothed(spark, sf):
    return _cells(spark, sf).select("party", "year", F.round("smoothed", 6).alias("smoothed"))


def cells_z(spark, sf):
    return _cells(spark, sf).select("party", "year", F.round("z", 6).alias("z"))


def suppress_cells(spark, sf):
    return T.suppress_thin_cells(_cells(spark, sf), 5, 100).select("party", "year", "hits", "n", "speeches")


def hit_density(spark, sf):
    return T.hit_density(_cells(spark, sf))


def dimension_gate(spark, sf):
    """A registered dimension from measure to verdict."""
    d = T.Dimension("joined", "lexical", lambda df: T.measure(df, V.PATTERNS.subset(subtype="joined")), min_cell_speeches=2, patterns=V.PATTERNS)
    return T.density_verdict(d.cells(V.speeches(spark, sf)))


def pooled_rate(spark, sf):
    return T.pooled_by_group(_measured(spark, sf))


def lix_doc(spark, sf):
    d = T.measure_lix(V.speeches(spark, sf))
    from loomquill.functions import stats

    return d.select("id", "words", "long_words", "sentences", "included", F.round(stats.lix(F.col("words"), F.col("sentences"), F.col("long_words")), 6).alias("lix"))


def lix_cells(spark, sf):
    c = T.aggregate_lix(T.measure_lix(V.speeches(spark, sf)))
    return c.select("party", "year", "hits", "n", "speeches", F.round("rate", 6).alias("rate"), F.round("smoothed", 6).alias("smoothed"), "avg_sentence_length", "long_word_pct")


def lix_excluded_share(spark, sf):
    return T.excluded_share(T.measure_lix(V.speeches(spark, sf))).select(F.round("excluded_share", 6).alias("excluded_share"))


def lexicon_score(spark, sf):
    return V.speeches(spark, sf).select("id", F.round(text.lexicon_score(F.col("text"), V.SINGLES, V.PHRASES), 6).alias("score"))


def pair_ratio_grouping_sets(spark, sf):
    return T.pair_report(V.speeches(spark, sf), V.PAIRS)


def _census(spark, sf):
    return T.census(V.speeches(spark, sf), V.SIDES)


def census(spark, sf):
    c = _census(spark, sf)
    return c.select("party", "year", "protocol_id", "speaker", "sentence", *[F.array_join(x, ",").alias(x) for x in ("ingroup", "outgroup", "subtypes")])


def symmetry_pivot(spark, sf):
    return T.symmetry(_census(spark, sf), ["link", "article"])


def receipts(spark, sf):
    return T.sample_receipts(V.speeches(spark, sf), V.PATTERNS, "joined", per_cell=3)


QUERIES = {f.__name__: f for f in (clean_text, sentence_count, sentence_offsets, pattern_hits, pattern_spans, cells_rate, cells_smoothed, cells_z, suppress_cells, hit_density, dimension_gate, pooled_rate, lix_doc, lix_cells, lix_excluded_share, lexicon_score, pair_ratio_grouping_sets, census, symmetry_pivot, receipts)}

_S = f"with {V.SPEECHES}, {V.sentences_sql()}"


def _m(words) -> str:
    return f"{_S}, m as (select *, len(sents) as n, len(list_filter(sents, lambda x: {V.hit_sql('x', words)})) as hits from s)"


_CELLS = """, c0 as (select party, year, sum(hits)::bigint as hits, sum(n)::bigint as n, count(*) as speeches from m where party is not null group by all),
c as (select *, sum(hits) over (partition by year)::double as h, sum(n) over (partition by year)::double as nn from c0)"""
_DENSITY = """, f as (select *, min(case when hits > 0 then year end) over (partition by party) as y0 from {c}),
q as (select list_sort(list(hits) filter (where hits > 0)) as v, count(*) filter (where year >= y0) as live, count(*) filter (where year >= y0 and hits = 0) as dead, count(*) filter (where y0 is null or year < y0) as lead, sum(hits) as total from f),
dd as (select coalesce(v[len(v) // 2 + 1]::double, 0.0) as median_hits, case when live > 0 then round(dead / live, 3) else 1.0 end as empty_share, lead::double as leading_empty, coalesce(total, 0)::double as total_hits from q)"""
_M = _m(V.PATTERNS.words)
_WORDS = "[0-9]+|\\p{L}+"
_LIX = f"{_S}, l0 as (select *, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from s), l as (select *, cast(len(w) as int) as words, cast(len(list_filter(w, lambda x: length(x) >= 7)) as int) as long_words, cast(len(sents) as int) as sentences, len(sents) >= 3 and len(w) >= 20 as included from l0)"
_LOW = "lower(coalesce(text, ''))"
_SCORE = " + ".join([f"len(list_filter(toks, lambda x: x = '{w}')) * {v}" for w, v in V.SINGLES.items()] + [f"(length(low) - length(replace(low, '{p}', ''))) / {len(p)} * {v}" for p, v in V.PHRASES.items()])
_PAIR_WORDS = sorted({w for g, n, _ in V.PAIRS for w in (g, n) if w})
_PAIR_ROWS = " union all ".join(f"select {k} as pair, '{g}' as gendered, {repr(n) if n else 'cast(null as varchar)'} as neutral, '{m}' as measure, year as y, party as p, c_{g} as g, {f'c_{n}' if n else '0'} as n from cnt" for k, (g, n, m) in enumerate(V.PAIRS))
_IN, _OUT = V.SIDES.subset("ingroup").words, V.SIDES.subset("outgroup").words
_SUB = "case x " + " ".join(f"when '{w}' then '{s}'" for w, s in V.SIDES.subtypes.items()) + " end"
_PICK = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w in ({}))))"
_CENSUS = f"{_S}, e as (select party, year, protocol_id, speaker, unnest(sents) as x from s), k as (select *, {_PICK.format(', '.join(map(repr, _IN)))} as i, {_PICK.format(', '.join(map(repr, _OUT)))} as o from e), cc as (select *, list_sort(list_distinct(list_transform(o, lambda x: {_SUB}))) as st from k where len(i) > 0 and len(o) > 0)"
ORACLE = {
    "clean_text": f"with {V.SPEECHES} select id, trim(regexp_replace(replace(coalesce(text, ''), '-' || chr(10), ''), '{V.WS}+', ' ', 'g')) as text from speeches",
    "sentence_count": f"{_S} select id, cast(len(sents) as int) as n from s",
    "pattern_hits": f"{_M} select id, cast(n as int) as n, cast(hits as int) as hits from m",
    "cells_rate": f"{_M}{_CELLS} select party, year, hits, n, speeches, case when n > 0 then round(hits / n * 1000.0, 6) else 0.0 end as rate from c",
    "cells_smoothed": f"{_M}{_CELLS} select party, year, case when nn <= 0 then 0.0 else round((hits + 0.01 * h) / (n + 0.01 * nn) * 1000.0, 6) end as smoothed from c",
    "cells_z": f"""{_M}{_CELLS} select party, year, case when n > 0 and nn - n > 0 and h > 0 and h < nn then round(
(ln((hits + 0.01 * h) / (n + 0.01 * nn - hits - 0.01 * h)) - ln((h - hits + 0.01 * h) / (nn - n + 0.01 * nn - (h - hits) - 0.01 * h))) / sqrt(1 / (hits + 0.01 * h) + 1 / (h - hits + 0.01 * h)), 6) end as z from c""",
    "suppress_cells": f"{_M}{_CELLS} select party, year, hits, n, speeches from c where speeches >= 5 and n >= 100",
    "hit_density": f"{_M}{_CELLS}{_DENSITY.format(c='c')} select * from dd",
    "dimension_gate": f"{_m(V.PATTERNS.subset(subtype='joined').words)}{_CELLS}, cs as (select * from c where speeches >= 2){_DENSITY.format(c='cs')} select *, median_hits < 5 or empty_share > 0.35 as sparse from dd",
    "pooled_rate": f"{_M} select party, sum(hits)::bigint as hits, sum(n)::bigint as sentences, case when sum(hits) >= 20 then round(sum(hits) / sum(n) * 100000.0, 2) end as rate from m where party is not null group by party",
    "lix_doc": f"{_LIX} select id, words, long_words, sentences, included, case when words > 0 and sentences > 0 then round(words / sentences + long_words * 100.0 / words, 6) else 0.0 end as lix from l",
    "lix_cells": f"""{_LIX}, c0 as (select party, year, sum(words)::bigint as w, sum(sentences)::bigint as se, sum(long_words)::bigint as lo, count(*) as speeches from l where included and party is not null group by all),
c as (select *, 0.01 * sum(w) over (partition by year) as bw, 0.01 * sum(se) over (partition by year) as bs, 0.01 * sum(lo) over (partition by year) as bl from c0)
select party, year, lo as hits, w as n, speeches, round(w / se + lo * 100.0 / w, 6) as rate, round((w + bw)::double / (se + bs)::double + (lo + bl)::double / (w + bw)::double * 100.0, 6) as smoothed, round(w / se, 2) as avg_sentence_length, round(lo * 100.0 / w, 2) as long_word_pct from c where se >= 50""",
    "lix_excluded_share": f"{_LIX} select round(avg(case when included then 0.0 else 1.0 end), 6) as excluded_share from l",
    "lexicon_score": f"with {V.SPEECHES}, q as (select id, {_LOW} as low, list_filter(string_split_regex({_LOW}, '{V.WS}+'), lambda x: x <> '') as toks from speeches) select id, round(({_SCORE}) / greatest(len(toks), 1) * 100.0, 6) as score from q",
    "pair_ratio_grouping_sets": f"""with {V.SPEECHES}, tk as (select party, year, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') as w from speeches),
cnt as (select party, year, {', '.join(f"sum(len(list_filter(w, lambda x: x = '{w}'))) as c_{w}" for w in _PAIR_WORDS)} from tk group by all), e as ({_PAIR_ROWS}),
gs as (select pair, gendered, neutral, measure, y, p, sum(g)::bigint as gendered_hits, sum(n)::bigint as neutral_hits, grouping(y) as gy, grouping(p) as gp from e group by grouping sets ((pair, gendered, neutral, measure), (pair, gendered, neutral, measure, y), (pair, gendered, neutral, measure, p))),
lv as (select *, case when gy = 1 and gp = 1 then 'all' when gy = 0 then 'year' else 'group' end as level from gs)
select pair, gendered, neutral, level, y as year, p as party, gendered_hits, neutral_hits, case when (level <> 'all' or measure = 'ratio') and gendered_hits + neutral_hits > 0 then round(neutral_hits / (neutral_hits + gendered_hits), 4) end as ratio
from lv where level = 'all' or (gendered_hits + neutral_hits >= 5 and (y is not null or p is not null))""",
    "census": f"{_CENSUS} select party, year, protocol_id, speaker, trim(regexp_replace(x, '{V.WS}+', ' ', 'g')) as sentence, array_to_string(i, ',') as ingroup, array_to_string(o, ',') as outgroup, array_to_string(st, ',') as subtypes from cc",
    "symmetry_pivot": f"{_CENSUS}, u as (select party, unnest(st) as t from cc) select party, count(*) filter (where t = 'link') as link, count(*) filter (where t = 'article') as article from u where party is not null group by party",
}
