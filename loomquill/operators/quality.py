"""Data-quality checks: one row for each check, so a failed one doesn't hide the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquill import schema

ID_SHAPE = r"^[^_]+_[a-z0-9-]+_[a-z]{1,2}$"


def internal_checks(df: DataFrame, parties: Sequence[str] = schema.PARTIES, id_shape: str = ID_SHAPE, least_per_year: int = 300, since: dict[str, int] | None = None, retired: Sequence[str] = tuple(schema.PARTY_RENAMES)) -> DataFrame:
    """(check, failures, ok).  `since` maps a party to the first year in which it may speak."""
    bad = {
        "text is present": F.col("text").isNull() | (F.trim("text") == ""),
        "party is present": F.col("party").isNull(),
        "id has its shape": ~F.coalesce(F.col("id").rlike(id_shape), F.lit(False)),
        "party is known": F.col("party").isNotNull() & ~F.col("party").isin(list(parties)),
        "no retired party": F.coalesce(F.col("party").isin(list(retired)), F.lit(False)),
        "no unreadable date": F.col("year").isNull(),
    }
    for party, year in (since or {}).items():
        bad[f"no {party} before {year}"] = (F.col("party") == party) & (F.col("year") < year)
    names = list(bad)
    one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(bad.values())])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("failures")) for i, n in enumerate(names)])).alias("x")).select("x.*")
    twice = df.groupBy("id").count().where("count > 1").agg(F.count("*").alias("failures")).select(F.lit("id is unique").alias("check"), "failures")
    thin = df.where("year is not null").groupBy("year").count().agg(F.count_if(F.col("count") <= least_per_year).alias("failures")).select(F.lit(f"years have over {least_per_year} rows").alias("check"), "failures")
    return rows.unionByName(twice).unionByName(thin).withColumn("ok", F.col("failures") == 0)


def mix_delta(old: DataFrame, new: DataFrame, col: str = "party") -> DataFrame:
    """(value, old_pct, new_pct, delta) in percentage points."""

    def mix(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(col, (F.col("n") * 100.0 / F.col("_t")).alias(name))

    both = mix(old, "old_pct").join(mix(new, "new_pct"), col, "full").na.fill(0.0)
    return both.withColumn("delta", F.col("new_pct") - F.col("old_pct"))


def lost_protocols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Protocols of `old` that `new` lacks."""
    return old.select("protocol_id").distinct().join(new.select("protocol_id"), "protocol_id", "left_anti")


def lost_probes(old: DataFrame, new: DataFrame, length: int = 80, least: int = 40) -> DataFrame:
    """(id, protocol_id, probe): the first `length` characters of old texts (of at least `least`) that their protocol no longer has."""
    squeezed = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    probes = old.select("id", "protocol_id", F.substring(squeezed, 1, length).alias("probe")).where(F.length("probe") >= least)
    texts = new.select(F.col("protocol_id"), squeezed.alias("_t"))
    found = probes.join(texts, "protocol_id").where(F.contains("_t", "probe")).select("id")
    return probes.join(found, "id", "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two parses has, with `side`; none if parsing is deterministic."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def assert_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """`df`, or an error that names some of the keys that occur twice."""
    if twice := [r[0] for r in df.groupBy(key).count().where("count > 1").select(key).limit(5).collect()]:
        raise ValueError(f"{key} occurs more than once, such as {twice}")
    return df


def require(checks: DataFrame) -> None:
    """An error that names every failed check, so that a job ends only after all were made."""
    if failed := [f"{r['check']} ({r['failures']})" for r in checks.where("not ok").collect()]:
        raise ValueError(f"failed checks: {', '.join(failed)}")
