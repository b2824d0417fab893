"""Statistical column arithmetic: log-odds with an informative prior, rates, shrinkage, z, readability, divergence terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_odds_z(y: Column, n: Column, bg: Column, total: Column, alpha: float) -> Column:
    """z of the weighted log-odds ratio of a word: y of n in the group, bg of total over all groups (the group included).

    The prior of a word is alpha times its background count.  Null where an odds ratio isn't defined.
    """
    p, a0 = bg * alpha, total * alpha
    rest, rest_n = bg - y, total - n
    up = F.ln((y + p) / F.nullif(n + a0 - y - p, F.lit(0.0)))
    down = F.ln((rest + p) / F.nullif(rest_n + a0 - rest - p, F.lit(0.0)))
    return (up - down) / F.sqrt(1.0 / (y + p) + 1.0 / (rest + p))


def raw_rate(hits: Column, n: Column, per: float) -> Column:
    return F.when(n > 0, hits / n * per).otherwise(0.0)


def smoothed_rate(hits: Column, n: Column, bg_hits: Column, bg_n: Column, alpha: float, per: float) -> Column:
    """The rate shrunk towards the background by alpha times its counts; raw where there is no background."""
    below = n + bg_n * alpha
    return F.when(bg_n <= 0, raw_rate(hits, n, per)).when(below <= 0, 0.0).otherwise((hits + bg_hits * alpha) / below * per)


def cell_z(hits: Column, n: Column, bg_hits: Column, bg_n: Column, alpha: float) -> Column:
    """z of a cell against the rest of its background.  Null for an empty cell, no rest, or a marker that is nowhere or everywhere."""
    z = log_odds_z(hits.cast("double"), n.cast("double"), bg_hits.cast("double"), bg_n.cast("double"), alpha)
    return F.when((n > 0) & (bg_n - n > 0) & (bg_hits > 0) & (bg_hits < bg_n), z)


def checked_counts(value: Column, hits: Column, n: Column, bg_hits: Column, bg_n: Column) -> Column:
    """`value`, or an error where the counts can't be: negative, hits over n, or a cell larger than its background."""
    bad = (hits < 0) | (n < 0) | (bg_hits < 0) | (bg_n < 0) | (hits > n) | (bg_hits > bg_n) | (hits > bg_hits) | (n > bg_n)
    told = F.concat_ws(" ", F.lit("impossible counts:"), *[c.cast("string") for c in (hits, n, bg_hits, bg_n)])
    return F.when(bad, F.raise_error(told).cast("double")).otherwise(value)


def lix(words: Column, sentences: Column, long_words: Column) -> Column:
    """Mean sentence length plus the percentage of long words; 0 for nothing."""
    return F.when((words > 0) & (sentences > 0), words / sentences + long_words * 100.0 / words).otherwise(0.0)


def ratio(part: Column, rest: Column, digits: int = 4) -> Column:
    """part / (part + rest), null if both are 0."""
    return F.round(F.try_divide(part, part + rest), digits)


def entropy_term(p: Column) -> Column:
    """-p log2 p, 0 for 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
