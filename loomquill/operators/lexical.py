"""Word statistics over groups: counts, distinctive words, movers, signatures, trajectories, frames, divergence.

All of them start from one table (group..., word, n).  Its only shuffle carries partial counts, never texts or single
tokens.  Where several reports are wanted, build `token_table` once with all keys, and roll it up with `regroup`.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquill.functions import stats, text


def add_year(df: DataFrame, date_col: str = "protocol_date", year_col: str = "year") -> DataFrame:
    """The year of a date or ISO text; rows without a readable date go."""
    return df.withColumn(year_col, F.year(F.to_date(F.try_to_timestamp(F.col(date_col).cast("string"))))).where(F.col(year_col).isNotNull())


def token_table(df: DataFrame, keys: Sequence[str], text_col: str = "text", min_length: int = 3, stopwords: Iterable[str] = ()) -> DataFrame:
    """(keys..., word, n).  Rows with a null key or text bring nothing."""
    known = df.where(" and ".join(f"`{k}` is not null" for k in [*keys, text_col]))
    words = known.select(*keys, F.explode(text.tokens(F.col(text_col), min_length, stopwords)).alias("word"))
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def regroup(tokens: DataFrame, keys: Sequence[str], min_length: int = 1, stopwords: Iterable[str] = ()) -> DataFrame:
    """A token table with fewer keys, longer words or more stop words."""
    stop = sorted({s.lower() for s in stopwords})
    kept = tokens.where(F.length("word") >= min_length) if min_length > 1 else tokens
    kept = kept.where(~F.col("word").isin(stop)) if stop else kept
    return kept.groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def without_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """A token table without the words of a table (word): for stop lists that are too long for a literal."""
    return tokens.join(words.select("word").distinct(), "word", "left_anti")


def log_odds(counts: DataFrame, group_col: str = "party", alpha: float = 0.01, min_count: int = 5) -> DataFrame:
    """(group, word, n, z) for observed pairs of words that occur `min_count` times over all groups.

    A word that a group lacks has z <= 0 there, so rankings of z > 0 lose nothing; see `dense_log_odds` for all pairs.
    """
    bg = counts.groupBy("word").agg(F.sum("n").alias("bg")).where(F.col("bg") >= min_count)
    kept = counts.join(bg, "word")
    sizes = kept.groupBy(group_col).agg(F.sum("n").alias("n_group"))
    total = bg.agg(F.sum("bg").alias("total"))
    z = stats.log_odds_z(*[F.col(c).cast("double") for c in ("n", "n_group", "bg", "total")], alpha)
    return kept.join(F.broadcast(sizes), group_col).crossJoin(F.broadcast(total)).select(group_col, "word", "n", z.alias("z"))


def dense_log_odds(counts: DataFrame, group_col: str = "party", alpha: float = 0.01, min_count: int = 5) -> DataFrame:
    """(group, word, n, z) for every group and every word of the background vocabulary."""
    bg = counts.groupBy("word").agg(F.sum("n").alias("bg")).where(F.col("bg") >= min_count)
    groups = counts.select(group_col).distinct()
    every = bg.select("word").crossJoin(F.broadcast(groups)).join(counts, [group_col, "word"], "left").na.fill(0, ["n"])
    kept = every.join(bg, "word")
    sizes = kept.groupBy(group_col).agg(F.sum("n").alias("n_group"))
    total = bg.agg(F.sum("bg").alias("total"))
    z = stats.log_odds_z(*[F.col(c).cast("double") for c in ("n", "n_group", "bg", "total")], alpha)
    return kept.join(F.broadcast(sizes), group_col).crossJoin(F.broadcast(total)).select(group_col, "word", "n", z.alias("z"))


def top_words(scores: DataFrame, group_col: str = "party", top_n: int = 100) -> DataFrame:
    """(group, word, z, rank) of the `top_n` words with the largest z > 0 of each group; ties go by word."""
    w = Window.partitionBy(group_col).orderBy(F.desc("z"), "word")
    ranked = scores.where("z > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return ranked.select(group_col, "word", "z", "rank")


def cloud(ranked: DataFrame, group_col: str = "party") -> DataFrame:
    """(group, map of word to z)."""
    return ranked.groupBy(group_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "z"))).alias("words"))


def distinctive_words(df: DataFrame, group_col: str = "party", text_col: str = "text", alpha: float = 0.01, min_count: int = 10, top_n: int = 20, stopwords: Iterable[str] = ()) -> DataFrame:
    """Which words set each group apart."""
    return top_words(log_odds(token_table(df, [group_col], text_col, 3, stopwords), group_col, alpha, min_count), group_col, top_n)


def top_movers(df: DataFrame, split_year: int | None = None, top_n: int = 40, min_count: int = 10, text_col: str = "text", year_col: str = "year", stopwords: Iterable[str] = ()) -> DataFrame:
    """(era, word, z, rank): words of the late years (risers) and the early ones (fallers).  The split defaults to the median year."""
    tokens = token_table(df, [year_col], text_col, 3, stopwords)
    if split_year is None:
        years = df.where(F.col(year_col).isNotNull())
        split = F.broadcast(years.agg(F.floor(F.median(year_col)).alias("_split")))
        tokens = tokens.crossJoin(split)
    else:
        tokens = tokens.withColumn("_split", F.lit(split_year))
    eras = tokens.withColumn("era", F.when(F.col(year_col) >= F.col("_split"), "late").otherwise("early"))
    return top_words(log_odds(regroup(eras, ["era"]), "era", 0.01, min_count), "era", top_n)


def yearly_signatures(df: DataFrame, top_n: int = 15, min_count: int = 15, text_col: str = "text", year_col: str = "year", stopwords: Iterable[str] = ()) -> DataFrame:
    """The same ranking with every year as a group of its own."""
    return distinctive_words(df, year_col, text_col, 0.01, min_count, top_n, stopwords)


def term_trajectories(df: DataFrame, terms: Sequence[str], per: float = 10_000.0, text_col: str = "text", year_col: str = "year") -> DataFrame:
    """(year, term, rate): occurrences for each `per` tokens of the year; a term that is absent has rate 0."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    words = df.where(F.col(year_col).isNotNull()).select(year_col, F.coalesce(text.tokens(F.col(text_col), 1), F.array().cast("array<string>")).alias("_w"))
    count = lambda t: F.sum(F.size(F.filter("_w", lambda x: x == t)))
    # counted within each text, so a year takes one row of sums a task and not one a word
    rows = words.groupBy(year_col).agg(F.sum(F.size("_w")).alias("total"), *[count(t).alias(f"_{i}") for i, t in enumerate(wanted)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_{i}").alias("n")) for i, t in enumerate(wanted)]))
    return rows.select(year_col, F.greatest("total", F.lit(1)).alias("total"), each.alias("x")).select(year_col, "x.term", (F.col("x.n") / F.col("total") * per).alias("rate"))


def frame_trajectories(df: DataFrame, frames: Mapping[str, Sequence[str]], per: float = 10_000.0, text_col: str = "text", year_col: str = "year", group_col: str = "party") -> DataFrame:
    """(frame, group, year, rate): tokens that contain any stem of the frame for each `per` tokens of the cell.

    Words are counted first, so stems are matched against a cell's vocabulary and not against its tokens.
    """
    for frame, stems in frames.items():
        if bad := [s for s in stems if any(c.isspace() for c in s)]:
            raise ValueError(f"frame {frame!r} has stems with white space that no token can contain: {bad}")
    keys = [year_col, group_col]
    tokens = token_table(df, keys, text_col, 1)
    has = [F.lit(False) if not stems else F.col("word").rlike("|".join(text.quoted(s) for s in stems)) for stems in frames.values()]
    sums = tokens.groupBy(*keys).agg(F.sum("n").alias("total"), *[F.sum(F.when(h, F.col("n")).otherwise(0)).alias(f"_{i}") for i, h in enumerate(has)])
    cells = df.where(f"`{year_col}` is not null and `{group_col}` is not null").select(*keys).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("frame"), F.col(f"_{i}").alias("n")) for i, f in enumerate(frames)]))
    rows = cells.join(sums, keys, "left").na.fill(0).select(*keys, F.greatest("total", F.lit(1)).alias("total"), each.alias("x"))
    return rows.select("x.frame", group_col, year_col, F.round(F.col("x.n") / F.col("total") * per, 2).alias("rate"))


def divergence_by_year(df: DataFrame, min_count: int = 5, text_col: str = "text", year_col: str = "year", group_col: str = "party", stopwords: Iterable[str] = ()) -> DataFrame:
    """(year, divergence): mean base-2 Jensen-Shannon divergence over all pairs of groups; years with fewer than two groups go.

    With entropies, JS(P, Q) = H((P+Q)/2) - (H(P) + H(Q))/2, and a pair's mixture differs from its halves only where both
    have the word.  So the groups that have a word are gathered in its row (no more than there are groups), and pairs are summed there.
    """
    tokens = token_table(df, [year_col, group_col], text_col, 3, stopwords)
    words = tokens.groupBy(year_col, "word").agg(F.sum("n").alias("bg"), F.collect_list(F.struct(F.col(group_col).alias("g"), "n")).alias("of")).where(F.col("bg") >= min_count)
    sizes = words.select(year_col, F.explode("of").alias("x")).groupBy(year_col, "x.g").agg(F.sum("x.n").alias("size"))
    sizes = sizes.groupBy(year_col).agg(F.map_from_entries(F.collect_list(F.struct("g", "size"))).alias("sizes"))
    shares = F.transform("of", lambda x: F.struct(x["g"].alias("g"), (x["n"] / F.element_at("sizes", x["g"])).alias("p")))
    rows = words.where(F.size("of") > 1).join(sizes, year_col).select(year_col, shares.alias("of"))

    def gain(a: Column, b: Column) -> Column:
        """What a shared word takes from the divergence of one, which two groups without common words have."""
        m = (a["p"] + b["p"]) / 2
        return F.when(a["g"] < b["g"], 0.5 * (a["p"] * (F.log2(a["p"] / m) - 1) + b["p"] * (F.log2(b["p"] / m) - 1))).otherwise(0.0)

    within = F.aggregate(F.flatten(F.transform("of", lambda a: F.transform("of", lambda b: gain(a, b)))), F.lit(0.0), lambda acc, x: acc + x)
    shared = rows.groupBy(year_col).agg(F.sum(within).alias("gain"))
    k = F.size("sizes")
    pairs = sizes.select(year_col, (k * (k - 1) / 2).alias("pairs")).where("pairs > 0")
    return pairs.join(shared, year_col, "left").select(year_col, (1 + F.coalesce("gain", F.lit(0.0)) / F.col("pairs")).alias("divergence"))


def name_stopwords(df: DataFrame, speaker_col: str = "speaker", min_length: int = 3, exclude: Iterable[str] = ()) -> DataFrame:
    """(word): lower-case words of runs of two or more capitals in the names."""
    names = df.where(F.col(speaker_col).isNotNull()).select(speaker_col).distinct()
    runs = names.select(F.explode(F.regexp_extract_all(F.col(speaker_col), F.lit("([A-ZÅÄÖ]{2,})"), F.lit(1))).alias("run"))
    return runs.select(F.explode(text.tokens(F.col("run"), min_length, exclude)).alias("word")).distinct()


def per_year(df: DataFrame, year_col: str = "year") -> DataFrame:
    return df.where(F.col(year_col).isNotNull()).groupBy(year_col).agg(F.count("*").alias("speeches"))


def group_totals(df: DataFrame, group_col: str = "party", text_col: str = "text", min_length: int = 3, stopwords: Iterable[str] = ()) -> DataFrame:
    """(group, texts, tokens) of every group, also of those whose texts have no token."""
    words = F.coalesce(F.size(text.tokens(F.coalesce(F.col(text_col), F.lit("")), min_length, stopwords)), F.lit(0))
    return df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count("*").alias("texts"), F.sum(words).alias("tokens"))


def ordered_union(lists: Sequence[DataFrame], value_col: str = "word") -> DataFrame:
    """(value, place): the distinct values of frames (value, rank) in the order of the frames and their ranks; each stays where it comes first.

    The lists are short reports (top words, curated terms), so one task numbers them.
    """
    rows = [df.select(F.col(value_col), F.lit(i).alias("_list"), F.col("rank").cast("int").alias("_rank")) for i, df in enumerate(lists)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    first = both.groupBy(value_col).agg(F.min(F.struct("_list", "_rank")).alias("_at"))
    return first.select(value_col, F.row_number().over(Window.orderBy("_at", value_col)).alias("place"))
