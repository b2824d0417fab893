"""Operator 3: URL lists, by a blocked Bloom filter before an exact hash join.

URLs are compared in canonical form: lower-case host (a name or a bracketed address) without ``www.`` and user, with a port other than 80 and 443;
path without closing slashes; query without tracking parameters, sorted; neither scheme nor fragment.  Percent signs and dot segments
stay as they are.  The list's hashes go into a split-block Bloom filter
(one 256-bit block a key, a bit in each of eight words), built with ``bit_or`` aggregates.  A page looks up the one block of
its hash, in a broadcast join as long as the filter has at most `max_filter_bytes`, beyond that in a shuffled join with the table of blocks.
Pages that pass are joined exactly with the list, which removes false positives; all others are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import block_of, bloom_blocks

TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)"
_HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?(\[[^\]/?#]*\]|[^/?#:@]+)"
_PORT = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:@]+):0*([0-9]*)"
_PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#\s]*)"
_QUERY = r"^[^?#]*\?([^#\s]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def canonical(url: Column) -> Column:
    """Canonical form; null for a null or for what has no scheme and host."""
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", "")
    parts = F.array_sort(F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    port = F.regexp_extract(url, _PORT, 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(host(url) != "", F.concat(host(url), port, path, query))


def url_filter(pages: DataFrame, listed: DataFrame, max_filter_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(page_id, url, canonical_url, listed) for every row of `pages`.

    `listed` holds URLs in any form; its nulls, malformed URLs and repeats don't matter.  A page with a null or
    malformed URL has a null canonical form and is not listed.  Repeated pages are judged each; an empty list lists nothing.
    """
    keys = listed.select(canonical(F.col(listed_col).cast("string")).alias("canonical_url")).where("canonical_url is not null").distinct()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("canonical_url", canonical(F.col("url")))
    hashed = keys.select(F.xxhash64("canonical_url").alias("h"))
    n = keys.count()
    blocks, n_blocks = bloom_blocks(hashed, "h", n)
    exact = keys.withColumn("listed", F.lit(True))
    done = lambda df: df.select("page_id", "url", "canonical_url", F.coalesce("listed", F.lit(False)).alias("listed"))
    h = F.xxhash64("canonical_url")
    seen = p.withColumn("_block", F.when(F.col("canonical_url").isNotNull(), block_of(h, n_blocks)))
    blocks = blocks.withColumnRenamed("block", "_block")
    seen = seen.join(F.broadcast(blocks) if n_blocks * 40 <= max_filter_bytes else blocks, "_block", "left")
    passes = F.lit(True)
    for i in range(8):
        bit = F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")
        passes = passes & (F.call_function("shiftrightunsigned", F.col(f"w{i}"), bit).bitwiseAND(F.lit(1)) == 1)
    passes = F.coalesce(passes, F.lit(False))
    hits = seen.where(passes).select("page_id", "url", "canonical_url").join(exact, "canonical_url", "left")
    return done(hits).unionByName(seen.where(~passes).select("page_id", "url", "canonical_url", F.lit(False).alias("listed")))


SPAM_HOST = r"(spam|casino|pills|bets|adult|ads)-[a-z]+\.|-(spam|casino|pills|bets|ads)\."
SQL = r"""
with c as (
  select page_id, url, lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)) as h,
    regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:@]+):0*([0-9]*)', 1) as o,
    regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#\s]*)', 1), '/+$', '') as p,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#\s]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)'))) as q
  from pages
), k as (
  select page_id, url, h, case when h <> '' then h || case when o in ('', '80', '443') then '' else ':' || o end || p || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as canonical_url from c
)
select page_id, url, canonical_url,
  coalesce(canonical_url in (select canonical_url from k where canonical_url is not null and regexp_matches(h, '(spam|casino|pills|bets|adult|ads)-[a-z]+\.|-(spam|casino|pills|bets|ads)\.')), false) as listed
from k
"""
