"""The speeches view over the documents table, in Spark and in SQL, and other inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquill import schema
from loomquill.functions.text import Patterns

STOP = ("the", "and", "les", "des", "und", "der", "que", "con", "for", "that")
FRAMES = {"motion": ["ing", "tion"], "order": ["able", "ment", "heit"], "people": ["eau", "ich", "ado"]}
TERMS = ["the", "les", "und", "Que", "absent"]
PATTERNS = Patterns(("the", "of the", "le", "and the", "und"), subtypes={"the": "plain", "of the": "joined", "and the": "joined", "le": "plain", "und": "plain"})
SIDES = Patterns(("the", "la", "der", "and", "et", "a"), subtypes={"and": "link", "et": "link", "a": "article"}, slots={"the": "ingroup", "la": "ingroup", "der": "ingroup", "and": "outgroup", "et": "outgroup", "a": "outgroup"})
PAIRS = [("the", "a", "ratio"), ("le", "la", "ratio"), ("der", "und", "decline"), ("el", None, "decline")]
SINGLES, PHRASES = {"the": 1.0, "la": 0.5, "und": 2.0}, {"of the": 1.5, "de la": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as speeches of 25 years and eight parties."""
    d = table(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / 20)
    year = (2002 + block % 25).cast("int")
    k = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    day = F.make_date(year, (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("P"), F.floor(F.col("doc_id") / 10).cast("string")).alias("protocol_id"),
        day.alias("protocol_date"),
        year.alias("year"),
        F.element_at(F.array(*[F.lit(p) for p in schema.PARTIES]), k % 8 + 1).alias("party"),
        F.upper(F.concat_ws("_", "source", (block % 7).cast("string"))).alias("speaker"),
        "text",
        F.lit(None).cast("string").alias("file_url"),
        "doc_id",
        "lang",
    )


SPEECHES = """speeches as (
  select cast(doc_id as varchar) as id, 'P' || cast(doc_id // 10 as varchar) as protocol_id,
    make_date(cast(2002 + (doc_id // 20) % 25 as int), cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int)) as protocol_date,
    cast(2002 + (doc_id // 20) % 25 as int) as year,
    list_extract(['C','KD','L','M','MP','S','SD','V'], cast(regexp_extract(source, '(\\d+)', 1) as int) % 8 + 1) as party,
    upper(source || '_' || cast((doc_id // 20) % 7 as varchar)) as speaker, text, doc_id, lang
  from documents
)"""
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGE = r"[^\p{L}\p{N}\p{M}_]"


def tokens_sql(least: int = 3, stop: tuple[str, ...] = ()) -> str:
    """CTE t(id, party, year, word) over speeches."""
    keep = f"length(word) >= {least}" + (f" and word not in ({', '.join(repr(s) for s in stop)})" if stop else "")
    return f"t as (select * from (select id, party, year, lang, unnest(regexp_extract_all(lower(text), '[a-zA-ZÀ-ÖØ-öø-ÿ]+')) as word from speeches) where {keep})"


def sentences_sql() -> str:
    """CTE s(all of speeches, sents) with the sentences as a list."""
    from loomquill.functions.text import ABBREVIATIONS

    dots = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
    masked = rf"regexp_replace(coalesce(text, ''), '(^|{EDGE})({dots})\.', '\1\2' || chr(2), 'gi')"
    cut = rf"regexp_replace({masked}, '([.!?])[\"''’»)\]]*{WS}+', '\1' || chr(1), 'g')"
    strip = f"regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')"
    return f"s as (select *, list_filter(list_transform(string_split({cut}, chr(1)), lambda x: replace({strip}, chr(2), '.')), lambda x: x <> '') as sents from speeches)"


def hit_sql(x: str, words: tuple[str, ...]) -> str:
    """Whether a text has one of the words as a whole word."""
    return f"regexp_matches({x}, '(?i)(^|{EDGE})({'|'.join(sorted(words, key=len, reverse=True))})({EDGE}|$)')"
