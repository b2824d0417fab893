"""Transcripts to keyed speeches: furniture lines, page columns, parsing, natural keys, de-duplication, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquill import schema
from loomquill.functions import text

MARK = r"Anf\.\s+\d"
#: name, party, body of one segment that begins at its marker
HEADER = r"(?s)^Anf\.\s+\d+\s+(.*?)\s+\(([A-Za-zÅÄÖåäö]{1,2})\)(?:\s+replik)?:(.*)$"
MONTHS = "januari februari mars april maj juni juli augusti september oktober november december".split()


def parse_records(protocols: DataFrame, parties: Sequence[str] = schema.PARTIES, renames: Mapping[str, str] = schema.PARTY_RENAMES) -> DataFrame:
    """(id, protocol_id, protocol_date, speaker, party, text, file_url) from (protocol_id, protocol_date, text, file_url).

    A text is cut before each marker, and each segment is read on its own, so a name never reaches over the next marker.
    Unknown parties and empty bodies go.  Segments of one speaker and party are joined in document order; the
    spelling that sorts first is the speaker's name.  The id depends on protocol, name and party and not on positions.
    """
    cut = protocols.select("protocol_id", "protocol_date", "file_url", F.posexplode(F.split("text", f"(?={MARK})", -1)).alias("pos", "part"))
    part = lambda k: F.regexp_extract("part", HEADER, k)
    rows = cut.where(F.col("part").rlike(HEADER)).select("protocol_id", "protocol_date", "file_url", "pos", text.strip(part(1)).alias("speaker"), text.canonical_party(part(2), parties, renames).alias("party"), text.strip(part(3)).alias("body"))
    rows = rows.where("party is not null and body <> ''").withColumn("slug", text.slug(F.col("speaker")))
    grouped = rows.groupBy("protocol_id", "protocol_date", "file_url", "slug", "party").agg(F.min("speaker").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
    return grouped.select(F.concat_ws("_", "protocol_id", "slug", F.lower("party")).alias("id"), "protocol_id", "protocol_date", "speaker", "party", "text", "file_url")


def furniture_lines(lines: DataFrame, doc_col: str = "doc", column_col: str = "column_no", line_col: str = "line", most_words: int = 10, share: float = 0.2, least: int = 3) -> DataFrame:
    """(doc, line, n): short lines that occur at least max(least, share of the columns) times in a document."""
    clean = lines.withColumn("_l", text.strip(F.col(line_col)))
    counts = clean.where((F.col("_l") != "") & (F.size(F.split("_l", f"(?U){text.SPACE}+")) <= most_words)).groupBy(doc_col, F.col("_l").alias("line")).agg(F.count("*").alias("n"))
    columns = lines.groupBy(doc_col).agg(F.greatest(F.lit(least), F.floor(F.count_distinct(column_col) * share)).alias("_need"))
    return counts.join(columns, doc_col).where("n >= _need").select(doc_col, "line", "n")


def is_fixed_furniture(line: Column) -> Column:
    """Empty lines, running heads, date lines, rules and page numbers."""
    s = text.strip(line)
    return (s == "") | s.rlike(r"^Prot\.\s") | s.rlike(rf"(?i)^\d{{1,2}}\s+(?:{'|'.join(MONTHS)})$") | s.rlike("^[\\s¯‾–, _-]+$") | s.rlike(r"^\d{1,4}$")


def protocol_text(lines: DataFrame, doc_col: str = "doc", column_col: str = "column_no", line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """(doc, text): the lines in order without furniture, cut words healed, white space and inline heads collapsed."""
    repeated = furniture_lines(lines, doc_col, column_col, line_col).select(doc_col, F.col("line").alias("_l"))
    kept = lines.where(~is_fixed_furniture(F.col(line_col))).withColumn("_l", text.strip(F.col(line_col))).join(repeated, [doc_col, "_l"], "left_anti")
    whole = kept.groupBy(doc_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column_col, order_col, line_col))), lambda x: x[line_col]), "\n").alias("t"))
    t = F.regexp_replace(F.regexp_replace("t", "-\n", ""), f"(?U){text.SPACE}+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"Prot\.\s*\d{4}/\d{2}:\d+", " "), "[¯‾]+", " ")
    return whole.select(doc_col, F.trim(F.regexp_replace(t, f"(?U){text.SPACE}+", " ")).alias("text"))


def page_columns(words: DataFrame, page_cols: Sequence[str] = ("doc", "page")) -> DataFrame:
    """(page..., gutter, straddle, two_columns) from word boxes (page..., width, x0, x1).

    The gutter is the first of the positions between 40 and 60 % of the width, 2 apart, that the fewest words straddle.
    """
    keys = list(page_cols)
    packed = words.groupBy(*keys, "width").agg(F.collect_list(F.struct("x0", "x1")).alias("w"))
    steps = F.sequence(F.lit(0), F.floor(F.col("width") * 0.2 / 2.0).cast("int"))
    at = F.transform(steps, lambda k: F.col("width") * 0.4 + k * 2.0)
    counted = F.transform(at, lambda x: F.struct(F.size(F.filter("w", lambda b: (b["x0"] < x) & (x < b["x1"]))).alias("n"), x.alias("x")))
    best = packed.select(*keys, "w", F.array_min(counted).alias("b"))
    left, right = F.size(F.filter("w", lambda b: b["x1"] <= F.col("b.x"))), F.size(F.filter("w", lambda b: b["x0"] >= F.col("b.x")))
    two = (left > 5) & (right > 5) & (F.col("b.n") <= F.greatest(F.lit(2), F.floor(F.size("w") * 0.01)))
    return best.select(*keys, F.col("b.x").alias("gutter"), F.col("b.n").alias("straddle"), two.alias("two_columns"))


def first_of_each(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in that order: which row stays is certain, unlike with dropDuplicates."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dropped_by_year(df: DataFrame, key: str = "id", year_col: str = "year") -> DataFrame:
    """(year, dropped): how many rows `first_of_each` leaves out, by year."""
    w = Window.partitionBy(key).orderBy(year_col)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank > 1").groupBy(year_col).agg(F.count("*").alias("dropped"))


def union_sources(archive: DataFrame, live: DataFrame, key: str = "id", date_col: str = "protocol_date") -> DataFrame:
    """The archive, and rows of the live table that are newer than its last date; the archive wins."""
    last = archive.agg(F.max(date_col).alias("_last"))
    fresh = live.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(date_col) > F.col("_last"))).drop("_last")
    both = archive.withColumn("_src", F.lit(0)).unionByName(fresh.withColumn("_src", F.lit(1)))
    return first_of_each(both, key, ["_src", F.desc(date_col)]).drop("_src")


def _by_content(df: DataFrame) -> list[Column]:
    return [F.desc(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))]


def upsert(target: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[Column | str] = ()) -> DataFrame:
    """`target` with rows of `changes` put in place of those with the same key, and added where there is none.

    Of rows of `changes` with one key the first in `order` counts; without an order the one whose JSON form sorts last.
    """
    latest = first_of_each(changes, key, order or _by_content(changes))
    return target.join(latest.select(key), key, "left_anti").unionByName(latest)


def insert_if_absent(target: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[Column | str] = ()) -> DataFrame:
    """`target` and the rows of `changes` whose key it lacks; see upsert for repeated keys."""
    latest = first_of_each(changes, key, order or _by_content(changes))
    return target.unionByName(latest.join(target.select(key), key, "left_anti"))


def delete_protocols(df: DataFrame, protocol_ids: Sequence[str]) -> DataFrame:
    return df.where(~F.col("protocol_id").isin(list(protocol_ids)))


def replace_protocols(df: DataFrame, fresh: DataFrame) -> DataFrame:
    """All rows of the protocols in `fresh` give way to its rows."""
    return df.join(fresh.select("protocol_id").distinct(), "protocol_id", "left_anti").unionByName(fresh)


def valid_parties(df: DataFrame, parties: Sequence[str] = schema.PARTIES, party_col: str = "party") -> DataFrame:
    return df.where(F.col(party_col).isin(list(parties)))


def trim(live: DataFrame, archive: DataFrame, cutoff: str, key: str = "id", date_col: str = "protocol_date") -> DataFrame:
    """`live` without rows older than `cutoff` that the archive holds; an empty archive is refused."""
    if archive.isEmpty():
        raise ValueError("without an archive nothing may be trimmed")
    held = archive.select(F.col(key).alias("_held"))
    return live.join(held, (F.col(key) == F.col("_held")) & (F.col(date_col) < F.to_date(F.lit(cutoff))), "left_anti")


def with_metadata(files: DataFrame, listing: DataFrame, archive: DataFrame) -> DataFrame:
    """(protocol_id, protocol_date, file_url, ...) of files whose protocol is listed; the archive only fills gaps.

    `listing` has (protocol_id, protocol_date, file_url, listed_in); of several entries the one of the last listing counts.
    """
    low = lambda d: d.withColumn("protocol_id", F.lower("protocol_id"))
    listed = first_of_each(low(listing), "protocol_id", [F.desc("listed_in")]).select("protocol_id", "protocol_date", "file_url")
    old = first_of_each(low(archive), "protocol_id", ["protocol_date"]).select("protocol_id", "protocol_date", "file_url")
    known = listed.unionByName(old.join(listed.select("protocol_id"), "protocol_id", "left_anti"))
    return low(files).join(known, "protocol_id")


def normalise_speaker(name: Column) -> Column:
    """The name from its first all-capital word on, in capitals."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), f"(?U){text.SPACE}+"), lambda x: x != "")
    upper = F.transform(words, lambda x: (x == F.upper(x)) & (x != F.lower(x)))
    at = F.array_position(upper, True).cast("int")
    return F.upper(F.array_join(F.when(at > 0, F.slice(words, at, F.size(words))).otherwise(words), " "))


def unparsed(protocols: DataFrame, records: DataFrame) -> DataFrame:
    """(protocol_id, reason): protocols without any record, to be set aside and reported; the others aren't held up by them."""
    why = F.when(F.col("text").isNull(), "no text").when(F.trim("text") == "", "empty text").when(~F.col("text").rlike(MARK), "no speech marker").otherwise("no speech of a known party")
    return protocols.join(records.select("protocol_id").distinct(), "protocol_id", "left_anti").select("protocol_id", why.alias("reason"))


def first_protocols(protocols: DataFrame, limit: int | None = None) -> DataFrame:
    """The first `limit` protocols by id, for a trial run; all without a limit."""
    return protocols if limit is None else protocols.orderBy("protocol_id").limit(limit)


def rebuild_report(records: DataFrame) -> DataFrame:
    """One row: speeches, protocols, speakers, parties, and the first and last date."""
    return records.agg(F.count("*").alias("speeches"), *[F.count_distinct(c).alias(n) for c, n in (("protocol_id", "protocols"), ("speaker", "speakers"), ("party", "parties"))], F.min("protocol_date").alias("first_date"), F.max("protocol_date").alias("last_date"))


def changed_ids(old: DataFrame, new: DataFrame, limit: int | None = None) -> DataFrame:
    """(protocol_id, removed, added): what replacing protocols would change, for a dry run; the first `limit` protocols where one is given."""
    ids = lambda df: first_protocols(df.select("protocol_id").distinct(), limit)
    picked = ids(new)
    a, b = (df.join(picked, "protocol_id", "left_semi").select("protocol_id", "id") for df in (old, new))
    count = lambda x, y, n: x.join(y, ["protocol_id", "id"], "left_anti").groupBy("protocol_id").agg(F.count("*").alias(n))
    return picked.join(count(a, b, "removed"), "protocol_id", "left").join(count(b, a, "added"), "protocol_id", "left").na.fill(0)
