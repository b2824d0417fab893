"""Operator 10: document fingerprints by content-defined chunking, and containment between documents.

A text's bytes are cut by a gear hash with normalised boundaries, so an edit or a shift changes only the chunks it
touches.  A fingerprint is the set of distinct chunk digests, each weighted by its chunk's length in bytes.  The
containment of a in b is the weight of the chunks of a that b has too over the weight of all chunks of a.  All ordered pairs with
at least `threshold` are found:

1. Documents with equal fingerprints collapse into one class, which its smallest id stands for.
2. Digests of the representatives meet in buckets by their high bits, as packed blocks (sorted, delta-coded, with the place of the
   document in the block).  Only digests of at least two representatives can link anything, and only they leave the buckets.
3. A representative orders its shared digests by frequency, rare ones first.  Its prefix holds them up to the point
   where what is left weighs less than the threshold: whatever contains it has a digest of the prefix.  A document
   whose unshared chunks alone weigh too much has no prefix and costs nothing further.
4. Prefix postings meet the postings of documents that are large enough.  Each candidate pair is verified on the whole
   sets of shared digests, in blocks of pairs that share a digest, so the sets of a cluster are fetched once for many pairs.

5. Where pairs aren't asked for, representatives with the same shared digests are one set: many short texts consist of a common line and a line of
   their own, and would make as many pairs as they have containers each.  What two sets share is found once; whom it links depends on the totals
   alone, so a set has a kind for each total among its documents, with their number and the smallest id.

6. Clusters of near copies would make pairs with the square of their size.  They are stars as in operator 5: what two sets of a star share is
   found for whole parts of it as a product of matrices, and candidates leave these pairs out.  Parts are bounded in digests and in sets, and the
   pairs of a digest that many have go to blocks by both sides, so no task holds more than its part or block, whatever the size of a cluster.

No posting, candidate or partner is capped.  Only digests and lengths are shuffled, never texts.  Links are counted between
representatives and weighted by the sizes of their classes, so copies are never expanded into pairs; where pairs aren't asked for,
each block sends a row for each of its documents and none for its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .jaccard import _small, components, core_of, in_common, in_company, linked, min_pairs, near_core
from .support import give_back, swept, written

#: Least, normal and largest bytes of a chunk, and the bytes that decide on a cut: short, as an edited word spoils its chunk and the window after it.
SIZES = (16, 16, 64, 8)
THRESHOLD = 0.5
WEIGHT_BITS = 11
_MASK = (1 << WEIGHT_BITS) - 1
PAIRS_BLOCK = 400_000
BUCKET_TOKENS, PART_TOKENS = 2_000_000, 500_000
#: Digests and sets in a part of a star: each of its sets is held against all of another part at once.
STAR_TOKENS, STAR_SETS = 150_000, 8192
#: Digests of partners that are looked up at a time; links that wait to be joined.
SLICE_TOKENS, EDGES = 1_000_000, 500_000
_U = np.uint64


def chunk_tokens(raw: bytes, begin: int, cuts: np.ndarray) -> np.ndarray:
    """Sorted distinct tokens of the chunks that end at `cuts`: the digest's high bits before the chunk's length."""
    ends = cuts.tolist()
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    h = np.fromiter((digest(view[a:b]) for a, b in zip([begin, *ends], ends)), dtype=np.uint64, count=len(ends))
    size = np.diff(np.concatenate(([begin], cuts))).astype(np.uint64)
    return np.unique(((h >> np.uint64(WEIGHT_BITS)) << np.uint64(WEIGHT_BITS)) | size)


def fingerprints(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(doc_id, sig, total, tokens) of every (doc_id, text) with at least one byte; tokens are packed unsigned longs."""
    if sizes[2] + 4 > _MASK:
        raise ValueError(f"chunks of up to {sizes[2]} bytes don't fit a token")

    def run(batches):
        for b in batches:
            for lo, hi, data, off in tk.slices(b.column(1)):
                raw = data.tobytes()
                sets = [chunk_tokens(raw, int(off[k]), cuts) for k, cuts in enumerate(tk.cdc_cuts(data, off, *sizes))]
                at = [k for k, x in enumerate(sets) if len(x)]
                if not at:
                    continue
                sets = [sets[k] for k in at]
                sig = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64)
                total = np.array([int((x & _U(_MASK)).sum()) for x in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(at) + lo)), pa.array(sig.view(np.int64)), pa.array(total), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "sig", "total", "tokens"])
            give_back()

    return docs.mapInArrow(run, "doc_id long, sig long, total long, tokens binary")


def _planes(x: np.ndarray) -> bytes:
    """Compressed bytes of equal weight side by side: the high ones of small numbers cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(n_buckets: int):
    """Rows (doc, total, tokens) -> a packed block for each bucket of tokens: documents by id, tokens in order, and for each token its document's place."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b.column(0)))
            doc, total = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, off = tk.string_buffers(b.column(2))
            tok = np.frombuffer(data[off[0] : off[-1]].tobytes(), dtype=_U)
            row = np.repeat(np.arange(len(doc), dtype=np.int32), np.diff(off) // 8)
            order = np.argsort(tok, kind="stable")
            tok, row = tok[order], row[order]
            bucket = ((tok >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)  # ranges of the digest
            used, head = np.unique(bucket, return_index=True)
            for k, a, z in zip(used.tolist(), head.tolist(), [*head[1:].tolist(), len(tok)]):
                mine, place = np.unique(row[a:z], return_inverse=True)
                high, weight = (tok[a:z] >> _U(WEIGHT_BITS)).view(np.int64), (tok[a:z] & _U(_MASK)).astype(np.uint16)
                cols = [np.diff(high, prepend=0), weight, place.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32), np.diff(doc[mine], prepend=0), total[mine]]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cols[2].itemsize], pa.int32()), *[pa.array([_planes(c)], pa.binary()) for c in cols]], names=["bucket", "wide", "digest", "weight", "place", "doc", "total"])

    return run


PACKED = "bucket int, wide int, digest binary, weight binary, place binary, doc binary, total binary"


def _shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, total, df, token) of the tokens of a bucket that two documents or more have."""
    toks, docs, totals = [], [], []
    for b in batches:
        for wide, digest, weight, place, doc, total in zip(*(b.column(c).to_pylist() for c in range(1, 7))):
            high = np.cumsum(_unplaned(digest, np.int64)).view(_U)
            toks.append((high << _U(WEIGHT_BITS)) | _unplaned(weight, np.uint16).astype(_U))
            at = _unplaned(place, np.uint16 if wide == 2 else np.uint32)
            docs.append(np.cumsum(_unplaned(doc, np.int64))[at])
            totals.append(_unplaned(total, np.int64)[at])
    tok, doc, total = map(np.concatenate, (toks, docs, totals))
    del toks, docs, totals
    order = np.argsort(tok, kind="stable")
    t = tok[order]
    same = t[1:] == t[:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    tok, doc, total = tok[order], doc[order], total[order]
    if len(tok):
        head = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        n = np.diff(np.concatenate((head, [len(tok)])))
        df = np.repeat(n, n)
        for a in range(0, len(tok), PART_TOKENS):
            part = slice(a, a + PART_TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(total[part]), pa.array(df[part].astype(np.int64)), pa.array(tok[part].view(np.int64))], names=["doc", "total", "df", "token"])
    give_back()


def _prefixes(threshold: float):
    """Rows (doc, total, tokens by frequency) -> (doc, total, least, token): least is the weight that a container needs."""

    def run(batches):
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, total, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = toks.values.to_numpy(zero_copy_only=False)
                w = t & _MASK
                before = total - int(w.sum()) + np.cumsum(w) - w  # unshared chunks come first
                keep = t[before <= (1 - threshold) * total + 1e-6]
                if len(keep):
                    out[0].append(np.full(len(keep), doc))
                    out[1].append(np.full(len(keep), total))
                    out[2].append(keep)
            if out[0]:
                doc, total, tok = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(total, pa.int64()), pa.array(tok, pa.int64())], names=["a", "total_a", "token"])

    return run


def _overlaps(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, w) for the pairs of `right`: a's row of `left`, those of some of its partners, and the weight that each of them shares with it."""
    tokens = left["tokens"].combine_chunks()
    ends, tok = tokens.offsets.to_numpy().astype(np.int64), tokens.values.to_numpy(zero_copy_only=False)
    docs = left["doc"].to_numpy()
    place = np.argsort(docs, kind="stable")
    a, b = (place[np.searchsorted(docs[place], right[c].to_numpy())] for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    edge = np.flatnonzero(np.diff(a[order])) + 1
    for part in np.split(order, edge) if len(order) else []:
        i, others = int(a[part[0]]), b[part]
        mine = np.sort(tok[ends[i] : ends[i + 1]])
        n = ends[others + 1] - ends[others]
        slices = np.flatnonzero(np.diff(np.cumsum(n) // SLICE_TOKENS)) + 1
        for k, n in zip(np.split(others, slices), np.split(n, slices)):
            flat = np.concatenate([tok[ends[y] : ends[y + 1]] for y in k.tolist()])
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            w = np.where(mine[at] == flat, flat & _MASK, 0)
            yield i, k, np.bincount(np.repeat(np.arange(len(n)), n), weights=w, minlength=len(n))


def _checked(threshold: float, left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and containment of the pairs that have it."""
    docs, total = left["doc"].to_numpy(), left["total"].to_numpy()
    out: tuple[list, list, list] = ([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)])
    for i, others, w in _overlaps(left, right):
        c = w / total[i]
        ok = c >= threshold - 1e-12
        for col, x in zip(out, (np.full(int(ok.sum()), docs[i]), docs[others[ok]], c[ok])):
            col.append(x)
    a, b, c = map(np.concatenate, out)
    return a, b, c


def _verify(threshold: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("a", "b", "containment"), map(pa.array, _checked(threshold, left, right)))))

    return run


TALLY = "doc long, root long, outer long, inner long, containment double, other long"


def _tally(threshold: float):
    """TALLY of the kinds of a block's sets with links (doc: a kind's smallest document): the smallest one reached within the block, how many
    documents contain those of the kind and are contained in them, the highest containment and the (smallest) container that has it.
    """

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        tally = _Tally(threshold, left)
        for found in _overlaps(left, right):
            tally.add(*found)
        out = tally.table()
        del tally
        give_back()
        return out

    return run


class _Tally:
    """TALLY for the sets of a table, given the weights that one of them shares with others at a time: neither pairs nor their kinds are kept.

    A set's kinds are ordered by total.  What links one of them links all with a smaller total, and all documents of a container are linked to
    what it contains, so components are those of sets, and the set that shares most is the best container of every kind that has one.
    """

    def __init__(self, threshold: float, left: pa.Table):
        kinds = left["kinds"].combine_chunks()
        self.sets, self.n = left["doc"].to_numpy(), np.diff(kinds.offsets.to_numpy())
        self.first = np.cumsum(self.n) - self.n
        flat = kinds.flatten()
        self.total, self.copies, self.doc = (flat.field(c).to_numpy() for c in ("total", "copies", "least"))
        self.need = self.total * (threshold - 1e-12)
        self.held = np.add.reduceat(self.copies, self.first) if len(self.n) else np.zeros(0, dtype=np.int64)
        self.outer, self.inner = np.zeros(len(self.doc), dtype=np.int64), np.zeros(len(self.n), dtype=np.int64)
        self.most, self.other = np.zeros(len(self.n)), np.zeros(len(self.n), dtype=np.int64)
        self.label, self.edges, self.waiting = np.arange(len(self.n)), [], 0

    def add(self, i: int, others: np.ndarray, w: np.ndarray) -> None:
        """Set i shares w with others, each of which comes once with it."""
        lo = int(self.first[i])
        kinds = slice(lo, lo + int(self.n[i]))
        ok = np.flatnonzero(w >= self.need[lo])
        if not len(ok):
            return
        to, w = others[ok], w[ok]
        if self.n[i] == 1:
            self.outer[lo] += self.held[to].sum()
            self.inner[to] += self.copies[lo]
        else:
            order = np.argsort(-w, kind="stable")
            within = np.concatenate(([0], np.cumsum(self.held[to[order]])))
            self.outer[kinds] += within[np.searchsorted(-w[order], -self.need[kinds], side="right")]
            self.inner[to] += np.cumsum(self.copies[kinds])[np.searchsorted(self.need[kinds], w, side="right") - 1]
        top = w.max()
        least = int(self.sets[to[w == top]].min())
        if top > self.most[i] or (top == self.most[i] and least < self.other[i]):
            self.most[i], self.other[i] = top, least
        new = to[self.label[to] != self.label[i]]
        if len(new):
            self.edges.append((np.full(len(new), i), new))
            self.waiting += len(new)
            if self.waiting > max(EDGES, len(self.n)):
                self.join()

    def join(self) -> None:
        """Labels of components with all edges so far."""
        if self.edges:
            a, b = (self.label[np.concatenate(x)] for x in zip(*self.edges))
            nodes, _, _, root = linked(a, b)
            to = np.arange(len(self.n))
            to[nodes] = root
            self.label, self.edges, self.waiting = to[self.label], [], 0

    def table(self) -> pa.Table:
        self.join()
        of = np.repeat(np.arange(len(self.n)), self.n)
        at = np.flatnonzero((self.outer > 0) | (self.inner[of] > 0))
        of = of[at]
        root = np.full(len(self.n), np.iinfo(np.int64).max)
        np.minimum.at(root, self.label[of], self.doc[at])
        none = self.outer[at] == 0
        cols = (self.doc[at], root[self.label[of]], self.outer[at], self.inner[of], pa.array(self.most[of] / self.total[at], mask=none), pa.array(self.other[of], mask=none))
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in zip(("doc", "root", "outer", "inner", "containment", "other"), cols)})


def _stars(sets: DataFrame) -> DataFrame:
    """(doc, star, parts) of the sets (doc, tokens) in a star, which goes by its smallest one."""

    def mins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).view(_U)
            if len(n):
                yield pa.RecordBatch.from_arrays([b.column(0), min_pairs(tk.mix(flat), np.cumsum(n) - n)], names=["rep", "mins"])

    def near(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = None
        for b in batches:
            n = np.diff(b["tokens"].offsets.to_numpy())
            flat = b["tokens"].flatten().to_numpy(zero_copy_only=False).view(_U)
            if core is None:
                core, name = core_of(flat, b.num_rows)
            ok = near_core(core, flat, n)
            yield pa.RecordBatch.from_arrays([b["doc"].filter(pa.array(ok)), pa.array(n[ok].astype(np.int64)), pa.array(np.full(int(ok.sum()), name))], names=["doc", "size", "core"])
        give_back()

    mine = written(in_company(sets.select("doc", "tokens").mapInArrow(mins, "rep long, mins array<long>")), "min-hashes")
    got = sets.select("doc", "tokens").join(_small(mine.withColumnRenamed("rep", "doc")), "doc").groupBy("nth", "h").applyInArrow(near, "doc long, size long, core long")
    core = Window.partitionBy("core")
    got = got.select("doc", F.min("doc").over(core).alias("star"), F.ceil(F.greatest(F.sum("size").over(core) / STAR_TOKENS, F.count("*").over(core) / STAR_SETS)).cast("int").alias("parts"), F.count("*").over(core).alias("n"))
    return swept(written(got.where("n > 1").drop("n"), "stars"))


def _star_tally(threshold: float):
    """As _tally, for all pairs of two parts of a star, or within one."""

    def run(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        part = got["part"].to_numpy()
        tokens = got["tokens"].chunk(0)
        n = np.diff(tokens.offsets.to_numpy())
        tok = tokens.flatten().to_numpy(zero_copy_only=False)
        row, weight = np.repeat(np.arange(len(n)), n), tok & _MASK
        a, b = (np.flatnonzero(part == k.as_py()) for k in key[1:])
        tally = _Tally(threshold, got)
        for x, y in [(a, b)] + [(b, a)] * (key[1] != key[2]):
            for lo, both in in_common(row, tok, len(n), x, y, weight):
                if key[1] == key[2]:
                    both[np.arange(len(both)), lo + np.arange(len(both))] = 0
                for i, shared in zip(x[lo : lo + len(both)].tolist(), both):
                    tally.add(i, y, shared)
        out = tally.table()
        del tally
        give_back()
        return out

    return run


def _within_stars(sets: DataFrame, stars: DataFrame, threshold: float) -> DataFrame:
    """TALLY over all pairs within a star."""
    part = sets.join(_small(stars), "doc").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cols = ["doc", "total", "tokens", "kinds", "part"]
    met = part.select("star", *cols, other).select("star", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), *cols)
    return met.groupBy("star", "p", "q").applyInArrow(_star_tally(threshold), TALLY)


def _shared_sets(docs: DataFrame, threshold: float, sizes: tuple[int, ...], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (doc_id, sig, total); representatives (rep, copies); their shared digests (doc, total, tokens by frequency, set, w), w their weight."""
    if not 0 < threshold <= 1:
        raise ValueError("need 0 < threshold <= 1")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    total = d.select(F.count("*"), F.count_distinct("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if total[0] != total[1]:
        d = d.groupBy("doc_id").agg(F.max("text").alias("text"))
    n_buckets = int(max(12, -(-total[2] // sizes[0] // BUCKET_TOKENS)))
    rows = fingerprints(d, sizes)
    firsts = rows.groupBy("sig", "total").agg(F.min("doc_id").alias("doc"), F.first("tokens").alias("tokens")).select("doc", "total", "tokens")
    shared = firsts.mapInArrow(_pack(n_buckets), PACKED).groupBy("bucket").applyInArrow(_shared, "doc long, total long, df long, token long")
    shared = shared.groupBy("doc", "total").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
    weight = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, x: n + x.bitwiseAND(F.lit(_MASK)))
    shared = swept(written(shared.select("doc", "total", "tokens", F.xxhash64("tokens").alias("set"), weight.alias("w")), "shared-chunks"))
    sigs = written(rows.select("doc_id", "sig", "total"), "fingerprints")
    reps = swept(written(sigs.groupBy("sig", "total").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "representatives"))
    return sigs, reps, shared


def _met(sets: DataFrame, threshold: float, *more: str, stars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets (block, doc, total, tokens, more) and pairs (pair_block, a, b) to verify, of sets (doc, total, tokens, w, more): total is a set's least, w the weight of its tokens.

    Pairs within one of `stars` are left out.
    """
    prefix = sets.select("doc", "total", "tokens").mapInArrow(_prefixes(threshold), "a long, total_a long, token long")
    postings = sets.select(F.col("doc").alias("b"), F.col("w").alias("w_b"), F.explode("tokens").alias("token"))
    apart = F.lit(True)
    if stars is not None:
        prefix = prefix.join(_small(stars.select(F.col("doc").alias("a"), F.col("star").alias("star_a"))), "a", "left")
        postings = postings.join(_small(stars.select(F.col("doc").alias("b"), F.col("star").alias("star_b"))), "b", "left")
        apart = F.coalesce(F.col("star_a") != F.col("star_b"), F.lit(True))
    met = prefix.join(postings, "token").where(apart & (F.col("a") != F.col("b")) & (F.col("w_b") >= threshold * F.col("total_a") - 1e-6))
    key = F.shiftrightunsigned("token", WEIGHT_BITS).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    pairs = swept(written(met.select("a", "b", key.alias("k")).groupBy("a", "b").agg(F.min("k").alias("k")), "containment-candidates"))
    blocks = int(max(12, -(-pairs.count() // PAIRS_BLOCK)))
    hot = pairs.groupBy("k").agg(F.ceil(F.sqrt(F.count("*") / PAIRS_BLOCK)).cast("int").alias("cells")).where("cells > 1")  # at most a row for each block
    pairs = pairs.join(F.broadcast(hot), "k", "left")
    cell = [F.pmod(F.xxhash64(c), F.coalesce("cells", F.lit(1))) for c in ("a", "b")]
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("k", *cell), F.lit(blocks)).cast("int")).drop("k", "cells")
    places = pairs.select("block", F.explode(F.array("a", "b")).alias("doc")).distinct()
    return places.join(sets, "doc").select("block", "doc", "total", "tokens", *more), pairs.select(F.col("block").alias("pair_block"), "a", "b")


def classes_and_pairs(docs: DataFrame, threshold: float = THRESHOLD, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, rep): documents with text and the smallest id with the same fingerprint.  Pairs (a, b, containment): representatives of
    different fingerprints, a contained in b to at least the threshold.

    Null ids, null and empty texts take no part; equal rows count once; of different texts under
    one id the text that sorts last counts; other columns are ignored.
    """
    sigs, reps, shared = _shared_sets(docs, threshold, sizes, id_col, text_col)
    left, right = _met(shared, threshold)
    found = left.groupBy("block").cogroup(right.groupBy("pair_block")).applyInArrow(_verify(threshold), "a long, b long, containment double")
    return sigs.join(reps, ["sig", "total"]).select("doc_id", "rep"), written(found, "containment-pairs")


def containment(docs: DataFrame, threshold: float = THRESHOLD, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_containers, n_contained, best, containment) for every non-null id of `docs`, once.

    n_containers is the number of other documents that contain this one to at least the threshold, n_contained the number of those that it
    contains, copies included; class_id is the smallest id that can be reached over such links in any direction.  best is the
    class (its smallest id) that contains most of it, of equals the first, and containment how much: a document with copies has its own class and 1.
    Both are null without any container.  A document without text is alone.  For the pairs themselves see classes_and_pairs, also for nulls and repeats.
    """
    sigs, reps, shared = _shared_sets(docs, threshold, sizes, id_col, text_col)
    whole, kind = Window.partitionBy("set", "w"), Window.partitionBy("set", "w", "total")
    enough = F.col("w") / F.col("total") >= threshold - 1e-12  # contained in all others of its set
    members = shared.select("doc", "total", "set", "w").join(reps.select(F.col("rep").alias("doc"), "copies"), "doc")
    members = members.withColumns({"least": F.min("doc").over(kind), "node": F.min("doc").over(whole), "next": F.lead("doc").over(whole.orderBy("doc")), "docs": F.count("*").over(whole)})
    members = members.withColumns({"all_copies": F.sum("copies").over(whole), "ready": F.sum(F.when(enough, F.col("copies")).otherwise(0)).over(whole)})
    members = swept(written(members, "members"))
    kinds = members.groupBy("node", "total", "least").agg(F.sum("copies").alias("copies"))
    nodes = kinds.groupBy("node").agg(F.min("total").alias("total"), F.array_sort(F.collect_list(F.struct("total", "copies", "least"))).alias("kinds"))
    sets = swept(written(shared.drop("total").join(nodes.withColumnRenamed("node", "doc"), "doc").select("doc", "total", "tokens", "w", "kinds"), "sets"))
    stars = _stars(sets)
    left, right = _met(sets, threshold, "kinds", stars=stars)
    between = left.groupBy("block").cogroup(right.groupBy("pair_block")).applyInArrow(_tally(threshold), TALLY)
    tally = swept(written(between.unionByName(_within_stars(sets, stars, threshold)), "containment-tally"))
    joined = members.where("docs > 1 and ready > 0").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(tally.select(F.col("doc").alias("a"), F.col("root").alias("b")).unionByName(joined)).withColumnRenamed("node", "least")
    top = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("containment")).alias("c"), "other"))).alias("found")
    links = tally.groupBy(F.col("doc").alias("least")).agg(F.sum("outer").alias("outer"), F.sum("inner").alias("inner"), top)
    own, zero = F.coalesce(F.col("copies") - 1, F.lit(0)), F.lit(0)
    out = members.join(links, "least", "left").join(roots, "least", "left")
    same = F.when(enough & (F.col("docs") > 1), F.struct((-(F.col("w") / F.col("total"))).alias("c"), F.when(F.col("doc") == F.col("node"), F.col("next")).otherwise(F.col("node")).alias("other")))
    linked_to = F.coalesce("root", F.when(F.col("outer").isNotNull() | ((F.col("docs") > 1) & (F.col("ready") > 0)), F.col("least")))
    out = out.select(
        F.col("doc").alias("rep"),
        linked_to.alias("root"),
        (F.coalesce("outer", zero) + F.when(enough, F.col("all_copies") - F.col("copies")).otherwise(0)).alias("outer"),
        (F.coalesce("inner", zero) + F.col("ready") - F.when(enough, F.col("copies")).otherwise(0)).alias("inner"),
        F.least("found", same).alias("top"),
    )
    classes = sigs.join(reps, ["sig", "total"]).select("doc_id", "rep", "copies")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(classes, "doc_id", "left").join(out, "rep", "left")
    return out.select(
        "doc_id",
        F.coalesce("root", "rep", "doc_id").alias("class_id"),
        (own + F.coalesce("outer", zero)).alias("n_containers"),
        (own + F.coalesce("inner", zero)).alias("n_contained"),
        F.when(own > 0, F.col("rep")).otherwise(F.col("top.other")).alias("best"),
        F.when(own > 0, 1.0).otherwise(F.round(-F.col("top.c"), 6)).alias("containment"),
    )
