"""Operator 2: repeated lines, by a sharded minimal perfect hash over the hashes of all distinct lines.

A line is a maximal run without a line feed, compared by its 64-bit XXH64 (seed 42, what Spark's ``xxhash64`` gives).
The lines of at least `min_chars` characters that occur `min_count` times or more are indexed; of these only the first
occurrence in (document id, line number) order stays.  Shorter lines, such as empty ones, always stay.

Build: one aggregate over compact rows (hash, count, first document), then every shard of distinct hashes gets a minimal
perfect hash: hashes fall into buckets of about three, buckets are placed from large to small with the first pilot
that sends all their members to free slots (at load 1, so slots are exactly as many as keys; a bucket of one names its slot).
A shard is flat arrays: pilots, 32-bit fingerprints, counts of a byte (larger ones apart), and the first document of each line that is
repeated, in the order of slots: some 6.3 bytes a line and 8 more for a repeated one.  They are written as a table in the shared folder, so a lost executor costs nothing.

Probe: documents never move.  A task turns its lines into hashes, and looks every hash up in its shard's arrays.  As all lines are
indexed, each has its own slot and its own count: a line that occurs once can't be taken for another one.  Lines are gathered up to
`PROBE_LINES` and looked up together, shard by shard, so a task of fewer lines reads each shard once, whatever the size of the index;
shards are held within `CACHE_BYTES` a worker.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .support import fresh, written

SHARD_KEYS = 1 << 18
DIRECT = 1 << 31
CACHE_BYTES = 256 << 20
PROBE_LINES = 1 << 20
MANY = 255
_U = np.uint64
INDEX_SCHEMA = "shard int, n int, pilots binary, fingerprints binary, counts binary, many binary, docs binary"
_KINDS = (("pilots", np.uint32), ("fingerprints", np.uint32), ("counts", np.uint8), ("many", np.int64), ("docs", np.int64))


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))


def _slots(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    p = pilot.astype(_U)
    at = (tk.mix(h ^ tk.mix(p + _U(0x5851F42D4C957F2D))) % _U(n)).astype(np.int64)
    return np.where(p >= _U(DIRECT), (p & _U(DIRECT - 1)).astype(np.int64), at)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(h + _U(0xD1B54A32D192ED03)) % _U(max(1, n // 3 + 1))).astype(np.int64)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Pilots (uint32, one a bucket) of a minimal perfect hash of the distinct 64-bit values `h`.

    Pilots are tried for all unplaced buckets of one size together, so numpy does the work.
    """
    n = len(h)
    b = _bucket(h, n)
    m = max(1, n // 3 + 1)
    pilots = np.zeros(m, dtype=np.uint32)
    taken = np.zeros(n, dtype=bool)
    size = np.bincount(b, minlength=m)
    order = np.argsort(b, kind="stable")
    begin = np.concatenate(([0], np.cumsum(size)))
    for k in range(int(size.max(initial=0)), 0, -1):
        todo = np.flatnonzero(size == k)
        members = h[order[begin[todo][:, None] + np.arange(k)]] if len(todo) else np.zeros((0, k), dtype=_U)
        pilot = np.zeros(len(todo), dtype=np.int64)
        live = np.arange(len(todo))
        if k == 1:  # a bucket of one names its slot outright
            free = np.flatnonzero(~taken)[: len(todo)]
            taken[free] = True
            pilots[todo] = np.uint32(DIRECT) | free.astype(np.uint32)
            continue
        while len(live):
            if len(live) <= 128:  # few are left: try a run of pilots for each one on its own
                for i in live:
                    step = int(pilot[i])
                    while True:
                        tries = np.arange(step, step + 1024)
                        at = np.sort(_slots(np.tile(members[i], 1024), np.repeat(tries, k), n).reshape(-1, k), axis=1)
                        fits = np.flatnonzero(~taken[at].any(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1))
                        if len(fits):
                            pilot[i] = tries[fits[0]]
                            taken[at[fits[0]]] = True
                            break
                        step += 1024
                break
            at = _slots(members[live].ravel(), np.repeat(pilot[live], k), n).reshape(-1, k)
            ok = ~taken[at].any(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            # of buckets that want the same slot the first one gets it
            cand = np.flatnonzero(ok)
            flat, owner = at[cand].ravel(), np.repeat(cand, k)
            winner = np.full(n, len(live), dtype=np.int64)
            np.minimum.at(winner, flat, owner)
            good = cand[(winner[at[cand]] == cand[:, None]).all(axis=1)]
            taken[at[good].ravel()] = True
            done = np.zeros(len(live), dtype=bool)
            done[good] = True
            pilot[live[~done]] += 1
            live = live[~done]
        pilots[todo] = pilot
    return pilots


def _print(h: np.ndarray) -> np.ndarray:
    return (tk.mix(h) >> _U(32)).astype(np.uint32)


def _index_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h = table["h"].to_numpy().view(_U)
    pilots = build_mph(h)
    order = np.argsort(_slots(h, pilots[_bucket(h, len(h))], len(h)))
    count = table["n"].to_numpy()[order]
    arrays = (pilots, _print(h[order]), np.minimum(count, MANY).astype(np.uint8), count[count >= MANY], table["doc"].to_numpy()[order][count > 1])
    cols = [pa.array([key[0].as_py()], pa.int32()), pa.array([len(h)], pa.int32()), *[pa.array([x.astype(t).tobytes()], pa.binary()) for x, (_, t) in zip(arrays, _KINDS)]]
    return pa.table(dict(zip(("shard", "n", *(n for n, _ in _KINDS)), cols)))


class Shard:
    """The arrays of one shard, ready for probes."""

    def __init__(self, pilots: np.ndarray, prints: np.ndarray, counts: np.ndarray, many: np.ndarray, docs: np.ndarray):
        self.pilots, self.prints, self.counts, self.many, self.docs = pilots, prints, counts, many, docs
        self.repeated, self.most = np.flatnonzero(counts > 1).astype(np.uint32), np.flatnonzero(counts == MANY).astype(np.uint32)
        self.nbytes = sum(x.nbytes for x in (pilots, prints, counts, many, docs, self.repeated, self.most))

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each hash (0 for one that isn't indexed) and, where it is over 1, the first document."""
        slot = _slots(h, self.pilots[_bucket(h, len(self.prints))], len(self.prints))
        count = np.where(self.prints[slot] == _print(h), self.counts[slot], 0).astype(np.int64)
        big = np.flatnonzero(count == MANY)
        count[big] = self.many[np.searchsorted(self.most, slot[big])]
        doc = np.zeros(len(h), dtype=np.int64)
        again = np.flatnonzero(count > 1)
        doc[again] = self.docs[np.searchsorted(self.repeated, slot[again])]
        return count, doc


def build_index(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, int]:
    """(path of the written index, number of shards).  Rows with a null id or text bring no lines."""
    t = docs.select(F.col(id_col).cast("long").alias("doc"), F.split(F.col(text_col).cast("string"), "\n", -1).alias("_l")).where("doc is not null and _l is not null")
    lines = t.select("doc", F.explode("_l").alias("_x")).where(F.length("_x") >= min_chars).select(F.xxhash64("_x").alias("h"), "doc")
    seen = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    keys = written(seen, "lines")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    built = keys.groupBy(F.pmod(F.shiftright("h", 32), F.lit(shards)).cast("int").alias("shard")).applyInArrow(_index_shard, INDEX_SCHEMA)
    index = written(built, "line-index")
    return index.inputFiles()[0].rsplit("/", 1)[0] if not index.isEmpty() else "", shards


class Index:
    """Lazy view of a written index from inside a task."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards, self.held, self.size = path, shards, OrderedDict(), 0

    def shard(self, k: int) -> Shard | None:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        fs, root = pafs.FileSystem.from_uri(self.path)
        got = ds.dataset(root, filesystem=fs, format="parquet").to_table(filter=ds.field("shard") == k)
        arrays = None
        if got.num_rows:
            arrays = Shard(*(np.frombuffer(got[c][0].as_py(), dtype=t) for c, t in _KINDS))
        self.held[k] = arrays
        self.size += arrays.nbytes if arrays else 0
        while self.size > CACHE_BYTES and len(self.held) > 1:
            _, old = self.held.popitem(last=False)
            self.size -= old.nbytes if old else 0
        return arrays

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not indexed) and, where it is over 1, the first document of each hash."""
        count, doc = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        if not self.path or not len(h):
            return count, doc
        which = ((h.view(np.int64) >> 32) % self.shards).astype(np.int64)
        u = h.view(_U)
        for k in np.unique(which):
            shard = self.shard(int(k))
            if shard is not None:
                at = np.flatnonzero(which == k)
                count[at], doc[at] = shard.probe(u[at])
        return count, doc


_OPEN: dict[tuple[str, int, int], Index] = {}


def _open(path: str, shards: int) -> Index:
    key = (path, shards, os.getpid())
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Index(path, shards)
    return _OPEN[key]


def keeper(path: str, shards: int, min_count: int):
    """Column function (id, line hashes, line lengths as 'long enough' flags) -> flags of the lines that stay."""

    def lines(doc: pa.Array, hashes: pa.Array, eligible: pa.Array) -> tuple:
        n = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        h = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ok = eligible.flatten().to_numpy(zero_copy_only=False).astype(bool)
        ids = np.repeat(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), n)
        return n, h, ids, np.flatnonzero(ok & np.repeat(~np.asarray(doc.is_null()), n))

    def flags(n: np.ndarray, h: np.ndarray, ids: np.ndarray, look: np.ndarray, count: np.ndarray, first: np.ndarray) -> pa.ListArray:
        row = np.repeat(np.arange(len(n)), n)
        stay = np.ones(len(h), dtype=bool)
        often = count >= min_count
        again = look[often]
        home = first[often] == ids[again]
        stay[again[~home]] = False
        again = again[home]  # in the line's first document: its first place there stays
        if len(again):
            order = np.lexsort((again, h[again], row[again]))
            x = again[order]
            stay[x[1:][(h[x[1:]] == h[x[:-1]]) & (row[x[1:]] == row[x[:-1]])]] = False
        return tk.list_array(pa.array(stay), n)

    @F.arrow_udf("array<boolean>")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held, size = [], 0

        def done():
            h = np.concatenate([b[1][b[3]] for b in held])
            count, first = _open(path, shards).probe(h)
            at = 0
            for n, h, ids, look in held:
                part = slice(at, at + len(look))
                yield flags(n, h, ids, look, count[part], first[part])
                at += len(look)

        for b in batches:
            held.append(lines(*b))
            size += len(held[-1][1]) + len(held[-1][0])
            if size >= PROBE_LINES:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    return keep


def dedup_text(docs: DataFrame, min_chars: int = 20, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with three more columns at the end: _clean (the text without repeated lines), _lines and _dropped (numbers of lines).

    A name that `docs` has already gets more underscores.  A null text stays null with 0 lines; an empty text is one
    empty line and stays; a row with a null id keeps all its lines.  Of rows that repeat an id each keeps what is first
    under that id, so equal rows stay equal.
    """
    path, shards = build_index(docs, min_chars, id_col, text_col)
    text = F.col(text_col).cast("string")
    parts = F.split(text, "\n", -1)
    kept = fresh(docs, "_keep")
    out = docs.withColumn(kept, keeper(path, shards, max(2, min_count))(F.col(id_col).cast("long"), line_hashes(text), F.transform(parts, lambda x: F.length(x) >= min_chars)))
    clean = F.array_join(F.filter(parts, lambda x, i: F.element_at(F.col(kept), i + 1)), "\n")
    dropped = F.size(F.filter(kept, lambda x: ~x))
    none = text.isNull()
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(none, F.lit(None).cast("string")).when(dropped == 0, text).otherwise(clean).alias(fresh(docs, "_clean")),
        F.when(none, 0).otherwise(F.size(kept)).alias(fresh(docs, "_lines")),
        F.when(none, 0).otherwise(dropped).alias(fresh(docs, "_dropped")),
    )


def line_dedup(docs: DataFrame, min_chars: int = 20, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row; see dedup_text for nulls, empties and repeats."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    got = dedup_text(base, min_chars, min_count, "doc_id", "_text")
    return got.select("doc_id", F.col("_clean").alias("text"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


SQL = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as k from documents
), r as (
  select *, case when length(x) >= 20 then row_number() over (partition by x order by doc_id, k) else 1 end as nth from l
)
select doc_id, coalesce(string_agg(x, chr(10) order by k) filter (where nth = 1), '') as text,
       cast(count(*) as int) as n_lines, cast(count(*) filter (where nth > 1) as int) as n_dropped
from r group by doc_id
"""
