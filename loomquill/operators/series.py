"""Read-side reports over (year, ...) series: spines, peaks, pivots, as-of captions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(rates: DataFrame, years: DataFrame, term_col: str = "term", value_col: str = "rate", year_col: str = "year") -> DataFrame:
    """Every year for every term; 0 where there is no value."""
    every = years.select(year_col).distinct().crossJoin(rates.select(term_col).distinct())
    return every.join(rates, [year_col, term_col], "left").select(year_col, term_col, F.coalesce(value_col, F.lit(0.0)).alias(value_col))


def peaks(rates: DataFrame, term_col: str = "term", value_col: str = "rate", year_col: str = "year") -> DataFrame:
    """(term, year, value) of the first maximum of each series."""
    best = F.max_by(F.struct(year_col, value_col), F.struct(F.col(value_col), -F.col(year_col)))
    return rates.groupBy(term_col).agg(best.alias("b")).select(term_col, F.col(f"b.{year_col}").alias(year_col), F.col(f"b.{value_col}").alias(value_col))


def shared_domain(rates: DataFrame, value_col: str = "rate", floor: float = 0.1) -> DataFrame:
    return rates.agg(F.greatest(F.coalesce(F.max(value_col), F.lit(floor)), F.lit(floor)).alias("top"))


def wide(rates: DataFrame, groups: Sequence[str], group_col: str = "party", value_col: str = "rate", year_col: str = "year") -> DataFrame:
    """A row for each year, a column for each group, 0 where there is no value."""
    return rates.groupBy(year_col).pivot(group_col, list(groups)).agg(F.first(value_col)).na.fill(0.0)


def card(ranked: DataFrame, group_col: str = "party", top_n: int = 12) -> DataFrame:
    """The first words of each group with bars scaled by the largest z."""
    w = Window.partitionBy(group_col)
    return ranked.where(F.col("rank") <= top_n).withColumn("bar", F.col("z") / F.max("z").over(w))


def as_of(rows: DataFrame, captions: DataFrame, time_col: str = "year", caption_time: str = "from_year", value_col: str = "caption") -> DataFrame:
    """Adds the caption with the latest time up to the row's: rows and captions are merged by time and the last one carried on."""
    marked = captions.select(F.col(caption_time).alias(time_col), F.col(value_col), F.lit(0).alias("_kind"))
    times = rows.select(time_col).distinct().select(time_col, F.lit(None).cast(captions.schema[value_col].dataType).alias(value_col), F.lit(1).alias("_kind"))
    w = Window.orderBy(time_col, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.unionByName(times).withColumn(value_col, F.last(value_col, ignorenulls=True).over(w)).where("_kind = 1").drop("_kind")
    return rows.join(found, time_col, "left")


def nested(rates: DataFrame, outer: str, inner: str, value_col: str = "rate") -> DataFrame:
    """(outer, values): the inner series of each outer key as a map, for JSON sinks."""
    return rates.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string"), value_col)))).alias("values"))


def json_rows(df: DataFrame, digits: Mapping[str, int] | None = None) -> DataFrame:
    """(json): each row as an object, numbers rounded as told, nulls kept."""
    cols = [F.round(c, digits[c]).alias(c) if digits and c in digits else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def two_decimals(c: Column) -> Column:
    """Two decimals as text; what rounds to zero is 0 without a sign."""
    return F.when(F.round(c, 2) == 0, "0").otherwise(F.format_string("%.2f", c))
