"""Tone measures: sentences that match a pattern table, readability, pooled cells, suppression, density, receipts, census."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquill.functions import stats, text
from loomquill.functions.text import Patterns

SENTENCES = "sentences_text"
SPAN = "array<struct<start:int,end:int,pattern:string>>"
PLACED = "array<struct<start:int,end:int,begin:int,stop:int,pattern:string>>"
#: Texts that are Python strings at a time.
TEXTS = 64


def with_sentences(df: DataFrame, text_col: str = "text", col: str = SENTENCES) -> DataFrame:
    """Adds the sentences once; a frame that has the column stays as it is."""
    return df if col in df.columns else df.withColumn(col, text.sentences(F.col(text_col)))


def _texts(col: pa.Array) -> Iterator[str | None]:
    for k in range(0, len(col), TEXTS):
        yield from col.slice(k, TEXTS).to_pylist()


class _Lists:
    """A list of structs for each row, kept as flat numbers: an object for each span takes many times its room."""

    def __init__(self, *names: str, pattern: bool = False):
        self.names, self.ends, self.cols = names, array("i", [0]), [array("i") for _ in names]
        self.known: dict[str, int] | None = {} if pattern else None
        self.which = array("i")

    def add(self, *values: int, pattern: str | None = None) -> None:
        for col, v in zip(self.cols, values):
            col.append(v)
        if self.known is not None:
            self.which.append(self.known.setdefault(pattern, len(self.known)))

    def end(self) -> None:
        self.ends.append(len(self.cols[0]))

    def arrow(self) -> pa.Array:
        flat = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
        cols, names = [flat(c) for c in self.cols], list(self.names)
        if self.known is not None:
            cols.append(pa.array(list(self.known), pa.string()).take(flat(self.which)))
            names.append("pattern")
        return pa.ListArray.from_arrays(flat(self.ends), pa.StructArray.from_arrays(cols, names))


def _offsets(t: str, splitter, guard) -> list[tuple[int, int]]:
    at, raw = 0, []
    for m in splitter.finditer(t):
        if not guard.search(t, max(0, m.start() - 16), m.start()):
            raw.append((at, m.start()))
            at = m.end()
    raw.append((at, len(t)))
    out = []
    for a, b in raw:
        part = t[a:b]
        if s := part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + lead + len(s)))
    return out


def _sentence_tools(abbreviations: Sequence[str]):
    import re

    listed = "|".join(re.escape(a) for a in sorted(abbreviations, key=lambda a: (-len(a), a)))
    guard = re.compile(rf"\b(?:{listed})\.\Z" if listed else r"(?!)", re.IGNORECASE)

    class Guard:
        """Whether an abbreviation ends right before `end`; the text before it is looked at with its own word border."""

        @staticmethod
        def search(t: str, begin: int, end: int):
            return guard.search(t[begin:end])

    return re.compile(r"(?<=[.!?])[\"'’»)\]]*\s+"), Guard


def sentence_spans(column: Column, abbreviations: Sequence[str] = text.ABBREVIATIONS) -> Column:
    """Half-open character offsets of the sentences.  Offsets need Python; `text.sentences` gives the texts without."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(col: pa.Array) -> pa.Array:
        tools, out = _sentence_tools(abbreviations), _Lists("start", "end")
        for t in _texts(col):
            for a, b in _offsets(t, *tools) if t else ():
                out.add(a, b)
            out.end()
        return out.arrow()

    return run(column)


def _found(t: str, rx, excludes) -> list[tuple[int, int, str]]:
    out = []
    for m in rx.finditer(t):
        low = m.group(0).lower()
        after = excludes.get(low)
        if not (after and after.match(t, m.end())):
            out.append((m.start(), m.end(), low))
    return out


def find_spans(column: Column, patterns: Patterns) -> Column:
    """SPAN: offsets of all matches, leftmost and longest first, without those that an excluded word follows."""

    @F.arrow_udf(SPAN)
    def run(col: pa.Array) -> pa.Array:
        rx, ex, out = patterns.python_regex(), patterns.python_excludes(), _Lists("start", "end", pattern=True)
        for t in _texts(col):
            for a, b, p in _found(t, rx, ex) if t else ():
                out.add(a, b, pattern=p)
            out.end()
        return out.arrow()

    return run(column)


def receipts_of(column: Column, patterns: Patterns, window: int = 1, abbreviations: Sequence[str] = text.ABBREVIATIONS) -> Column:
    """Every match with the sentences around it, and the match's offsets within them.  Python gives offsets alone; the JVM cuts the context out row by row."""

    @F.arrow_udf(PLACED)
    def run(col: pa.Array) -> pa.Array:
        rx, ex, tools = patterns.python_regex(), patterns.python_excludes(), _sentence_tools(abbreviations)
        out = _Lists("start", "end", "begin", "stop", pattern=True)
        for t in _texts(col):
            spans = _found(t, rx, ex) if t else []
            sents = _offsets(t, *tools) if spans else []
            starts = [s for s, _ in sents]
            for a, b, p in spans:
                i = max(0, bisect_right(starts, a) - 1)  # sentences don't overlap
                begin = sents[max(0, i - window)][0] if sents else a
                stop = sents[min(len(sents) - 1, i + window)][1] if sents else b
                out.add(a, b, begin, stop, pattern=p)
            out.end()
        return out.arrow()

    def shown(r: Column) -> Column:
        begin = r["begin"]
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["pattern"].alias("pattern"), column.substr(begin + 1, F.greatest(r["stop"] - begin, F.lit(0))).alias("context"), (r["start"] - begin).alias("hl_start"), (r["end"] - begin).alias("hl_end"))

    return F.transform(run(column), shown)


def _sentences_with_span(column: Column, patterns: Patterns) -> Column:
    """The exact count for tables whose exclusions may hide other patterns."""

    @F.arrow_udf("int")
    def run(col: pa.Array) -> pa.Array:
        rx, ex, tools = patterns.python_regex(), patterns.python_excludes(), _sentence_tools(text.ABBREVIATIONS)
        out = []
        for t in _texts(col):
            spans = _found(t, rx, ex) if t else []
            sents = _offsets(t, *tools) if spans else []
            out.append(len({i for a, _, _ in spans for i, (s, e) in enumerate(sents) if s <= a < e}))
        return pa.array(out, pa.int32())

    return run(column)


def measure(df: DataFrame, patterns: Patterns, text_col: str = "text") -> DataFrame:
    """Adds n (sentences) and hits (sentences with a match); a null text has neither."""
    out = with_sentences(df, text_col)
    hits = _sentences_with_span(F.col(text_col), patterns) if patterns.overlapping else text.sentences_hit(F.col(SENTENCES), patterns)
    return out.withColumn("n", F.size(SENTENCES)).withColumn("hits", hits)


def measure_constant_group(df: DataFrame, patterns: Patterns, group: str, text_col: str = "text") -> DataFrame:
    """The same, with one group for the whole corpus."""
    return measure(df, patterns, text_col).withColumn(group, F.lit(group))


def measure_lix(df: DataFrame, text_col: str = "text", long_from: int = 7, min_sentences: int = 3, min_words: int = 20) -> DataFrame:
    """Adds words, long_words, sentences, included (long enough to count), hits and n."""
    count = lambda least: F.coalesce(F.regexp_count(F.col(text_col), F.lit(text.reading_word_regex(least))), F.lit(0))
    out = with_sentences(df, text_col).withColumn("words", count(1)).withColumn("long_words", count(long_from)).withColumn("sentences", F.size(SENTENCES))
    return out.withColumn("included", (F.col("sentences") >= min_sentences) & (F.col("words") >= min_words)).withColumn("hits", F.col("long_words")).withColumn("n", F.col("words"))


def _pooled(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return known.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(a) for a, c in sums.items()], F.count("*").alias("speeches"))


def aggregate_cells(df: DataFrame, hit_col: str = "hits", n_col: str = "n", group_col: str = "party", year_col: str = "year", per: float = 1000.0, alpha: float = 0.01) -> DataFrame:
    """(group, year, hits, n, speeches, rate, smoothed, z): sums first, then ratios; the background is the same year over all groups."""
    cells = _pooled(df, [group_col, year_col], {"hits": hit_col, "n": n_col})
    w = Window.partitionBy(year_col)
    cells = cells.withColumn("_h", F.sum("hits").over(w)).withColumn("_n", F.sum("n").over(w))
    c = [F.col(x) for x in ("hits", "n", "_h", "_n")]
    smoothed = stats.checked_counts(stats.smoothed_rate(*c, alpha, per), *c)
    return cells.select(group_col, year_col, "hits", "n", "speeches", stats.raw_rate(c[0], c[1], per).alias("rate"), smoothed.alias("smoothed"), stats.cell_z(*c, alpha).alias("z"))


def aggregate_lix(df: DataFrame, group_col: str = "party", year_col: str = "year", alpha: float = 0.01, min_sentences: int = 50) -> DataFrame:
    """Pooled readability of the included rows, with both parts shrunk towards the year; cells with few sentences go; z is null."""
    pool = df.where("included") if "included" in df.columns else df
    cells = _pooled(pool, [group_col, year_col], {"words": "words", "sentences": "sentences", "long_words": "long_words"})
    w = Window.partitionBy(year_col)
    bg = {x: F.sum(x).over(w) * alpha for x in ("words", "sentences", "long_words")}
    cells = cells.select("*", *[v.alias(f"_{k}") for k, v in bg.items()]).where(F.col("sentences") >= min_sentences)
    words, sents, long_ = (F.col(x) for x in ("words", "sentences", "long_words"))
    smoothed = (words + F.col("_words")) / (sents + F.col("_sentences")) + (long_ + F.col("_long_words")) / (words + F.col("_words")) * 100.0
    return cells.select(
        group_col, year_col, long_.alias("hits"), words.alias("n"), "speeches", stats.lix(words, sents, long_).alias("rate"), smoothed.alias("smoothed"), F.lit(None).cast("double").alias("z"),
        words.alias("words"), sents.alias("sentences"), long_.alias("long_words"), F.round(words / sents, 2).alias("avg_sentence_length"), F.round(long_ * 100.0 / words, 2).alias("long_word_pct"),
    )


def excluded_share(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg((~F.col("included")).cast("double")), F.lit(0.0)).alias("excluded_share"))


def suppress_thin_cells(cells: DataFrame, min_speeches: int = 0, min_n: int = 0) -> DataFrame:
    return cells.where((F.col("speeches") >= min_speeches) & (F.col("n") >= min_n))


def hit_density(cells: DataFrame, group_col: str = "party", year_col: str = "year") -> DataFrame:
    """One row: upper median of the non-empty cells, share of empty cells once a group has had a hit, cells before that, all hits."""
    w = Window.partitionBy(group_col)
    first = F.min(F.when(F.col("hits") > 0, F.col(year_col))).over(w)
    c = cells.withColumn("_live", F.coalesce(F.col(year_col) >= first, F.lit(False)))
    got = c.withColumn("_full", F.when(F.col("hits") > 0, F.col("hits"))).agg(F.expr("percentile_disc(0.5) within group (order by _full desc)").alias("f"), F.sum(F.col("_live").cast("int")).alias("live"), F.count_if(F.col("_live") & (F.col("hits") == 0)).alias("empty"), F.count_if(~F.col("_live")).alias("lead"), F.sum("hits").alias("total"))
    return got.select(
        F.coalesce(F.col("f").cast("double"), F.lit(0.0)).alias("median_hits"),
        F.when(F.col("live") > 0, F.round(F.col("empty") / F.col("live"), 3)).otherwise(1.0).alias("empty_share"),
        F.col("lead").cast("double").alias("leading_empty"),
        F.coalesce(F.col("total"), F.lit(0)).cast("double").alias("total_hits"),
    )


def pooled_by_group(df: DataFrame, group_col: str = "party", per: float = 100_000.0, min_hits: int = 20) -> DataFrame:
    """(group, hits, sentences, rate) over all years; the rate is null under `min_hits`."""
    pooled = df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.sum("hits").alias("hits"), F.sum("n").alias("sentences"))
    return pooled.withColumn("rate", F.when(F.col("hits") >= min_hits, F.round(F.try_divide("hits", "sentences") * per, 2)))


def pair_report(df: DataFrame, pairs: Sequence[tuple[str, str | None, str]], text_col: str = "text", group_col: str = "party", year_col: str = "year", min_mentions: int = 5) -> DataFrame:
    """(pair, gendered, neutral, level, year, group, gendered_hits, neutral_hits, ratio) for pairs (gendered, neutral, measure).

    Levels are all, year and group.  Years and groups need `min_mentions`; a pair's overall ratio is given only where
    its measure is 'ratio'.  One alternation finds all words; only one that stands within another of the table takes a scan of its own.  One
    aggregate with grouping sets gives all levels.
    """
    words = sorted({w.strip().lower() for g, n, _ in pairs for w in (g, n) if w and w.strip()})
    apart = text.within_others(words)
    joint = [w for w in words if w not in apart]
    found = df.select(group_col, year_col, text_col, text.matches(F.col(text_col), Patterns(tuple(joint))).alias("_found")) if joint else df.select(group_col, year_col, text_col)
    own = lambda w: F.regexp_count(F.col(text_col), F.lit(Patterns((w,)).regex()))
    size = lambda w: F.when(F.col("_found").isNotNull(), F.size(F.filter("_found", lambda x: x == w)))
    counted = found.select(group_col, year_col, *[F.coalesce(own(w) if w in apart else size(w), F.lit(0)).alias(f"_{i}") for i, w in enumerate(words)])
    cells = counted.groupBy(group_col, year_col).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(words))])
    at = {w: F.col(f"_{i}") for i, w in enumerate(words)}
    rows = [F.struct(F.lit(k).alias("pair"), F.lit(g.strip().lower()).alias("gendered"), F.lit(n.strip().lower() if n and n.strip() else None).cast("string").alias("neutral"), F.lit(m).alias("measure"), at[g.strip().lower()].alias("g"), (at[n.strip().lower()] if n and n.strip() else F.lit(0)).alias("n")) for k, (g, n, m) in enumerate(pairs)]
    each = cells.select(F.col(group_col).alias("_group"), F.col(year_col).alias("_year"), F.explode(F.array(*rows)).alias("x")).select("_group", "_year", "x.*")
    key = [F.col(c) for c in ("pair", "gendered", "neutral", "measure")]
    sets = each.groupingSets([key, [*key, F.col("_year")], [*key, F.col("_group")]], *key, F.col("_year"), F.col("_group")).agg(F.sum("g").alias("gendered_hits"), F.sum("n").alias("neutral_hits"), F.grouping("_year").alias("gy"), F.grouping("_group").alias("gg"))
    level = F.when((F.col("gy") == 1) & (F.col("gg") == 1), "all").when(F.col("gy") == 0, "year").otherwise("group")
    out = sets.withColumn("level", level).where((F.col("level") == "all") | ((F.col("gendered_hits") + F.col("neutral_hits") >= min_mentions) & F.coalesce(F.col("_year").cast("string"), F.col("_group").cast("string")).isNotNull()))
    ratio = F.when((F.col("level") != "all") | (F.col("measure") == "ratio"), stats.ratio(F.col("neutral_hits"), F.col("gendered_hits")))
    return out.select("pair", "gendered", "neutral", "level", F.col("_year").alias("year"), F.col("_group").alias("party"), "gendered_hits", "neutral_hits", ratio.alias("ratio"))


def census(df: DataFrame, patterns: Patterns, text_col: str = "text", keep: Sequence[str] = ("party", "year", "protocol_id", "speaker", "file_url")) -> DataFrame:
    """A row for every sentence with an in-group and an out-group pattern: sorted patterns, subtypes, and the sentence.

    Exclusions don't apply here.  The first filter drops most sentences before the second pattern is looked for.
    """
    inner, outer = patterns.subset("ingroup").without_excludes(), patterns.subset("outgroup").without_excludes()
    cols = [c for c in keep if c in df.columns]
    s = with_sentences(df, text_col).select(*cols, F.posexplode(SENTENCES).alias("sentence_no", "_s")).where(F.col("_s").rlike(inner.regex())).where(F.col("_s").rlike(outer.regex()))
    listed = lambda p: F.array_sort(F.array_distinct(text.matches(F.col("_s"), p)))
    subtype = F.create_map(*[F.lit(x) for pair in patterns.subtypes.items() for x in pair])
    s = s.withColumn("ingroup", listed(inner)).withColumn("outgroup", listed(outer))
    sentence = F.trim(F.regexp_replace("_s", f"(?U){text.SPACE}+", " "))
    return s.select(*cols, "sentence_no", sentence.alias("sentence"), "ingroup", "outgroup", F.array_sort(F.array_distinct(F.transform("outgroup", lambda x: F.element_at(subtype, x)))).alias("subtypes"))


def symmetry(rows: DataFrame, subtypes: Sequence[str], group_col: str = "party", subtypes_col: str = "subtypes") -> DataFrame:
    """Counts of subtypes by group, a column for each."""
    return rows.where(F.col(group_col).isNotNull()).select(group_col, F.explode(subtypes_col).alias("_s")).groupBy(group_col).pivot("_s", list(subtypes)).count().na.fill(0)


def sample_receipts(df: DataFrame, patterns: Patterns, dimension: str, evidentiary: bool = True, per_cell: int = 3, seed: int = 13, id_col: str = "id", group_col: str = "party", year_col: str = "year", text_col: str = "text", keep: Sequence[str] = ("protocol_id", "speaker", "protocol_date", "file_url")) -> DataFrame:
    """`per_cell` matches of each (group, year), drawn by a digest of seed, dimension, cell, speech and offset.

    Cells are drawn apart, so a new speech in one moves nothing in others.  Highlights are null for illustrative receipts.
    """
    cols = [c for c in keep if c in df.columns]
    known = df.where(f"`{group_col}` is not null and `{year_col}` is not null")
    rows = known.where(F.col(text_col).rlike(patterns.without_excludes().regex())).select(id_col, group_col, year_col, *cols, F.explode(receipts_of(F.col(text_col), patterns)).alias("r"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit(dimension), F.col(group_col), F.col(year_col), F.col(id_col), F.col("r.start")).cast("binary"))
    w = Window.partitionBy(group_col, year_col).orderBy(key, id_col, "r.start")
    drawn = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_cell)
    subtype = F.element_at(F.create_map(*[F.lit(x) for pair in patterns.subtypes.items() for x in pair]), F.col("r.pattern")) if patterns.subtypes else F.lit(None).cast("string")
    shown = lambda c: F.when(F.lit(evidentiary), F.col(c))
    return drawn.select(F.lit(dimension).alias("dimension"), F.lit("evidentiary" if evidentiary else "illustrative").alias("kind"), F.col(id_col).alias("speech_id"), group_col, year_col, *cols, F.col("r.context").alias("context"), shown("r.hl_start").alias("hl_start"), shown("r.hl_end").alias("hl_end"), F.col("r.pattern").alias("pattern"), subtype.alias("subtype"), "rank")


@dataclass(frozen=True)
class Dimension:
    """A registered measure: DataFrame -> DataFrame with hits and n, and how to pool it."""

    id: str
    technique: str  # lexical, stylometric or structural
    measure: Callable[[DataFrame], DataFrame]
    aggregate: Callable[[DataFrame], DataFrame] | None = None
    evidentiary: bool = True
    launched: bool = False
    group_col: str = "party"
    min_cell_speeches: int = 8
    min_cell_n: int = 0
    per: float = 1000.0
    alpha: float = 0.01
    patterns: Patterns | None = None

    def __post_init__(self) -> None:
        if self.technique not in ("lexical", "stylometric", "structural"):
            raise ValueError(f"unknown technique {self.technique!r}")
        if self.technique == "lexical" and self.patterns is None:
            raise ValueError(f"lexical dimension {self.id!r} has no patterns")
        if self.technique == "stylometric" and self.evidentiary:
            raise ValueError(f"stylometric dimension {self.id!r} has no discrete hits, so its receipts can't be evidence")

    def cells(self, df: DataFrame) -> DataFrame:
        measured = self.measure(df)
        pooled = self.aggregate(measured) if self.aggregate else aggregate_cells(measured, group_col=self.group_col, per=self.per, alpha=self.alpha)
        return suppress_thin_cells(pooled, self.min_cell_speeches, self.min_cell_n)


REGISTRY: dict[str, Dimension] = {}


def register(dimension: Dimension) -> Dimension:
    if dimension.id in REGISTRY:
        raise ValueError(f"dimension {dimension.id!r} is registered already")
    REGISTRY[dimension.id] = dimension
    return dimension


def density_verdict(cells: DataFrame, group_col: str = "party", least_median: float = 5.0, most_empty: float = 0.35) -> DataFrame:
    """`hit_density` with a verdict: too sparse to show by cell, or not."""
    return hit_density(cells, group_col).withColumn("sparse", (F.col("median_hits") < least_median) | (F.col("empty_share") > most_empty))
