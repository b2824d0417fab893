"""Operator 5: exact n-gram Jaccard self-join by a grouped prefix join.

A text is the set of its word n-grams (lower case; a text of fewer words is one gram of all of them; a text without words
has none and matches nothing).  All pairs of documents with a Jaccard similarity of at least `threshold` are found:

1. A count sketch over all grams of all documents gives every gram a frequency class.  It has about a slot for each gram,
   up to `SKETCH_MAX`: beyond that it tells grams whose share of all grams is large from the others.  (class, hash) is a
   total order with common grams last; the join is exact under any total order, the sketch only keeps common grams out
   of prefixes.
2. Each document keeps the first ``size - ceil(threshold * size) + SHARED`` grams in this order, its prefix: similar
   documents share at least `SHARED` grams of their prefixes (all that they share, if that is fewer).  Documents with
   equal prefix and size collapse into one group.
3. Postings of groups are sent to buckets of their grams as packed blocks.  Within a bucket, groups that share a gram
   meet if their sizes and the gram's positions still allow the threshold.  What two sets share beyond their prefixes is no
   more than what the larger one has beyond its own, so the prefixes must share the rest: pairs that do, over all buckets, are candidates.
   A gram of a hot frequency class is split: its groups fall into parts, and every two parts meet in a bucket of their own.
4. Candidate group pairs are expanded to the distinct gram sets of the members.  Parity bitmaps of about two bits a gram
   bound a pair's difference from below, so pairs that merely share a gram go before any set is fetched.
5. What is left is verified on whole sets in blocks: a pair belongs to a gram that both share, so the sets of a cluster are
   fetched once for many pairs.
6. Clusters of near copies would have a number of pairs that grows with the square of the input.  Sets that agree in min-hashes and
   come near what most of their company has form a star.  Within a star no pair is listed: shared grams are counted for all of them at
   once, as products of 0/1 matrices for what many have and posting by posting for the rest, and each document's links are summed up at once.
   Steps 3 to 5 leave out pairs within a star and no others, so the result doesn't depend on which stars there are.

No pair, posting or group is capped.  A gram shared by very many documents is split into blocks of `BLOCK_DOCS` a side for
verification.  Links are counted between representatives and weighted by the sizes of their classes, so copies are never
expanded into pairs; where pairs aren't asked for, each block sends a row for each of its documents and none for its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .support import collect_bloom, fresh, give_back, written

N, THRESHOLD = 3, 0.6
BUCKET_POSTINGS, PART_POSTINGS, BLOCK_DOCS, BLOCK_PAIRS = 2_000_000, 500_000, 256, 60_000
BROADCAST_ROWS, HELD_PAIRS, SENT_PAIRS = 2_000_000, 250_000, 1_000_000
HOT_CLASS = 15
LOWER_ROWS = 512
SKETCH_MAX = 1 << 24
SHARED = 3
#: Sets that agree in a pair of min-hashes before they may be a star, the least similarity to what most of them have, grams in a part of a star, rows counted at once.
STAR_DOCS, STAR_NEAR, STAR_GRAMS, STAR_ROWS = 12, 0.5, 2_000_000, 256
_U = np.uint64
_RAW = np.dtype([("lo", "<u4"), ("hi", "<u2")])
_FIVE = np.dtype([("lo", "<u4"), ("hi", "u1")])
_M34, _M43 = (1 << 34) - 1, (1 << 43) - 1


def grams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram of lower-case texts, repeats included."""
    s, e = tk.runs(tk.WORD[data], off)
    if not len(s):
        return s, np.zeros(0, dtype=_U)
    w, row = tk.range_hash(data, s, e), tk.rows_of(s, off)
    h = np.zeros(len(w), dtype=_U)
    for k in range(n):
        part = np.zeros(len(w), dtype=_U)
        part[: len(w) - k] = w[k:]
        part[: len(w) - k][row[k:] != row[: len(w) - k]] = 0
        h = tk.mix(h * _U(0x9FB21C651E98DF25) + part)
    ok = np.zeros(len(w), dtype=bool)
    ok[: max(0, len(w) - n + 1)] = row[n - 1 :] == row[: max(0, len(w) - n + 1)]
    first = np.concatenate(([True], row[1:] != row[:-1]))
    size = np.bincount(row, minlength=len(off) - 1)
    ok |= first & (size[row] < n)
    return row[ok], h[ok]


def ordered_sets(column: pa.Array, n: int, classes: np.ndarray | None):
    """For each slice: first row, end row, rows and tokens of the distinct grams, sorted by row and the global order.

    A token is the 5-bit frequency class before 59 bits of the gram's hash.
    """
    for lo, hi, data, off in lowered(column):
        row, g = grams(data, off, n)
        tok = g >> _U(5)
        if classes is not None and len(g):
            tok |= classes[slot(g, len(classes))].astype(_U) << _U(59)
        order = np.lexsort((tok, row))
        row, tok = row[order], tok[order]
        if len(tok):
            new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (row[1:] != row[:-1])))
            row, tok = row[new], tok[new]
        yield lo, hi, row, tok


def lowered(column: pa.Array):
    """Slices of the lower-case texts; few rows are lowered at once, so large batches need no second copy."""
    for at in range(0, len(column), LOWER_ROWS):
        for lo, hi, data, off in tk.slices(pc.utf8_lower(column.slice(at, LOWER_ROWS).cast(pa.large_string()))):
            yield at + lo, at + hi, data, off
    give_back()


def slot(g: np.ndarray, width: int) -> np.ndarray:
    return (g >> _U(64 - (width.bit_length() - 1))).astype(np.int64)


def sketch(docs: DataFrame, n: int, width: int, part: int = 1 << 15) -> np.ndarray:
    """Frequency class (log2 of the sketched count, at most 31) for each of `width` hash slots.

    A task sends its counts in compressed parts, which are added up by part.
    """

    def count(batches):
        acc = np.zeros(width, dtype=np.uint32)
        for b in batches:
            for _, _, data, off in lowered(b.column(0)):
                np.add.at(acc, slot(grams(data, off, n)[1], width), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(0, width, part):
            x = acc[i : i + part]
            if x.any():
                kind = np.uint8 if x.max() < 1 << 8 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([i // part], pa.int32()), pa.array([kind().itemsize], pa.int32()), pa.array([pack(x.astype(kind).tobytes())], pa.binary())], names=["part", "bytes", "counts"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        acc = np.zeros(min(part, width), dtype=np.uint64)
        unpack = zstandard.ZstdDecompressor().decompress
        for size, x in zip(table["bytes"].to_pylist(), table["counts"]):
            acc += np.frombuffer(unpack(x.as_py()), dtype=np.uint8 if size == 1 else np.uint32)
        cls = np.minimum(31, np.log2(np.maximum(acc, 1).astype(float)).astype(np.uint8))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([cls.astype(np.uint8).tobytes()], pa.binary())})

    got = docs.select("text").mapInArrow(count, "part int, bytes int, counts binary").groupBy("part").applyInArrow(add, "part int, classes binary").toArrow()
    out = np.zeros(width, dtype=np.uint8)
    for k, x in zip(got["part"].to_pylist(), got["classes"].to_pylist()):
        out[k * part : (k + 1) * part] = np.frombuffer(x, dtype=np.uint8)
    return out


def prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + SHARED)


def _packed(tok: np.ndarray) -> np.ndarray:
    """The class and 43 bits of the hash of each token as 6 bytes."""
    return _raw((tk.mix(tok) & _U(_M43)) | (tok >> _U(59) << _U(43)), _RAW)


def _raw(h: np.ndarray, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(h), dtype=kind)
    out["lo"], out["hi"] = (h & _U(0xFFFFFFFF)).astype(np.uint32), (h >> _U(32)).astype(kind["hi"])
    return out


def _wide(raw: np.ndarray) -> np.ndarray:
    return raw["lo"].astype(np.int64) | (raw["hi"].astype(np.int64) << 32)


def _parts(cls: np.ndarray, hot: int) -> np.ndarray:
    """Into how many parts the groups of a gram are split: twice as many for each class from `hot` on."""
    return np.left_shift(1, np.maximum(0, cls - hot + 1))


def _part(gid: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return tk.mix(gid.view(_U) ^ _U(0x94D049BB133111EB)).view(np.int64) & (parts - 1)


def _bitmaps(h: np.ndarray, size: np.ndarray) -> pa.Array:
    """A parity bit for each of 2 to 4 slots a gram: the XOR of two sets' bitmaps has at most a bit for each gram of one set alone."""
    bits = 1 << np.maximum(8, np.ceil(np.log2(2.0 * size)).astype(np.int64))
    base = np.cumsum(bits) - bits
    at = (h & np.repeat(bits - 1, size).astype(_U)).astype(np.int64) + np.repeat(base, size)
    raw = np.packbits(np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little")
    ends = (np.concatenate((base, [bits.sum()])) // 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the larger bitmap is folded to the smaller one."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), len(a) * 8
    while n > len(b) * 8:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def signatures(docs: DataFrame, n: int, threshold: float, classes) -> DataFrame:
    """(doc_id, size, psig, ssig, prefix, bits, mins) of documents with grams; mins are four pairs of min-hashes."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for lo, hi, row, tok in ordered_sets(b.column(1), n, classes.value):
                if not len(tok):
                    continue
                at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                size = np.diff(np.concatenate((at, [len(tok)])))
                keep = prefix_size(size, threshold)
                short = (np.arange(len(tok)) - np.repeat(at, size)) < np.repeat(keep, size)
                mixed = tk.mix(tok ^ _U(0x5555555555555555))
                ssig = np.add.reduceat(mixed, at)
                psig = np.add.reduceat(np.where(short, tk.mix(tok), _U(0)), at)
                raw = _packed(tok[short]).view(np.uint8).reshape(-1)
                ends = np.concatenate(([0], np.cumsum(keep))) * 6
                blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at] + lo)), pa.array(size.astype(np.int32)), pa.array(psig.view(np.int64)), pa.array(ssig.view(np.int64)), blob, _bitmaps(tk.mix(mixed), size), min_pairs(mixed, at)], names=["doc_id", "size", "psig", "ssig", "prefix", "bits", "mins"])

    return docs.mapInArrow(run, "doc_id long, size int, psig long, ssig long, prefix binary, bits binary, mins array<long>")


def min_pairs(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """Of each set, 32 bits of the least and 32 of the greatest value together, under four rotations of the hash."""
    out = np.empty((len(at), 4), dtype=np.int64)
    for k in range(4):
        x = ((h << _U(16 * k)) | (h >> _U(64 - 16 * k))) if k else h
        out[:, k] = ((np.minimum.reduceat(x, at) >> _U(32) << _U(32)) | (np.maximum.reduceat(x, at) >> _U(32))).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(at) + 1, 4, dtype=np.int32)), pa.array(out.ravel()))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: high ones are mostly equal, so shuffle compression takes them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _blocks(n_buckets: int, hot: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b.column(0)))
            gid, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, off = tk.string_buffers(b.column(2))
            star = b.column(3).to_numpy(zero_copy_only=False)
            count = np.diff(off) // 6
            tok = _wide(np.frombuffer(data[off[0] : off[-1]].tobytes(), dtype=_RAW))
            doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
            pos = np.minimum(np.arange(len(tok)) - np.repeat(np.cumsum(count) - count, count), 65535).astype(np.uint16)
            parts = _parts(tok >> 43, hot)
            crossed = np.zeros(len(tok), dtype=bool)
            if parts.max(initial=1) > 1:  # a posting of a split gram goes to the buckets of its part and every part
                at = np.repeat(np.arange(len(tok)), parts)
                other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                tok, doc, pos, n = tok[at], doc[at], pos[at], parts[at]
                mine = _part(gid[doc], n)
                pair = tk.mix((tok + np.minimum(mine, other) * 0x9E3779B97F4A7C1 + np.maximum(mine, other) * 0x2545F4914F6CDD1D).view(_U)).view(np.int64) & _M43
                crossed = (n > 1) & (mine != other)
                tok = np.where(n > 1, (tok & ~_M43) | pair, tok)
            bucket, rest = ((tok & _M43) % n_buckets).astype(np.int32), (tok & _M43) // n_buckets
            tok = (tok >> 43 << 35) | (crossed.astype(np.int64) << 34) | (rest & _M34)
            order = np.argsort(bucket, kind="stable")
            used, edge = np.unique(bucket[order], return_index=True)
            for k, at in zip(used.tolist(), np.split(order, edge[1:])):
                cols = [_raw(tok[at].view(_U), _FIVE).tobytes(), _planes(pos[at]), _planes(gid[doc[at]].astype(np.int64)), _planes(size[doc[at]].astype(np.int32)), _planes(star[doc[at]].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([c], pa.binary()) for c in cols]], names=["bucket", "tok", "pos", "gid", "size", "star"])

    return run


def _meeting(tok: np.ndarray, star: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Postings of one gram that aren't of one star, the smaller set first, where sizes allow the threshold; input by gram, star (0: none) and size."""
    alone = np.flatnonzero(star == 0)
    t, n = tok[alone], size[alone]
    i, d = np.arange(len(alone)), 1
    while True:
        i = i[i + d < len(alone)]
        i = i[(t[i] == t[i + d]) & (n[i] >= threshold * n[i + d] - 1e-9)]  # sizes rise within a gram
        if not len(i):
            break
        yield alone[i], alone[i + d]
        d += 1
    if len(alone) == len(tok):
        return
    new = np.concatenate(([True], tok[1:] != tok[:-1]))
    run = np.cumsum(new) - 1
    begin, end = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:], [len(tok)]))
    none = np.bincount(run, weights=star == 0, minlength=len(begin)).astype(np.int64)
    first = np.flatnonzero(new | np.concatenate(([True], star[1:] != star[:-1])))
    after = np.repeat(np.concatenate((first[1:], [len(tok)])), np.diff(np.concatenate((first, [len(tok)]))))
    mine = np.flatnonzero(star)
    for a, z in ((begin[run[mine]], begin[run[mine]] + none[run[mine]]), (after[mine], end[run[mine]])):
        total = np.cumsum(z - a)
        at = 0
        while at < len(mine):
            till = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD_PAIRS, side="right")))
            n = (z - a)[at:till]
            i = np.repeat(mine[at:till], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - a[at:till], n)
            i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
            ok = size[i] >= threshold * size[j] - 1e-9
            if ok.any():
                yield i[ok], j[ok]
            at = till


def _candidates(threshold: float, hot: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = list(zip(*(x for b in batches for x in zip(*([x.as_buffer() for x in b[c]] for c in ("tok", "gid", "size", "pos", "star"))))))
        parts = -(-sum(x.size for x in packed[0]) // 5 // PART_POSTINGS) or 1

        def unpacked(p: int):
            """tok, gid, size, pos and star of one part of the grams; only the packed form of all parts is held."""
            cols: tuple[list, ...] = ([], [], [], [], [])
            for raws in zip(*packed):
                t = _wide(np.frombuffer(raws[0], dtype=_FIVE))
                at = np.flatnonzero(tk.mix(t.view(_U)) % _U(parts) == p)
                for col, v in zip(cols, (t, *(_unplaned(x, kind) for x, kind in zip(raws[1:], (np.int64, np.int32, np.uint16, np.int64))))):
                    col.append(v[at])
            return map(np.concatenate, cols)

        found: list[tuple[np.ndarray, ...]] = []
        held, room_for = 0, HELD_PAIRS

        def squeeze() -> None:
            nonlocal found
            a, b, k, m = (np.concatenate(x) for x in zip(*found))
            o = np.lexsort((k, b, a))
            a, b = a[o], b[o]
            at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            found = [(a[at], b[at], k[o][at], np.add.reduceat(m[o], at))]

        def sent() -> pa.RecordBatch:
            """What was found so far; the counts of a pair are added up later."""
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(found[0], kinds)], names=["ga", "gb", "k", "m"])

        for p in range(parts):
            tok, gid, size, pos, star = unpacked(p)
            order = np.argsort(tok, kind="stable")
            t = tok[order]
            same = np.concatenate(([False], t[1:] == t[:-1], [False]))
            order = order[same[:-1] | same[1:]]  # grams that at least two groups have
            order = order[np.lexsort((size[order], star[order], tok[order]))]
            tok, gid, size, pos, star = tok[order], gid[order], size[order].astype(np.int64), pos[order].astype(np.int64), star[order]
            head = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, dtype=np.int64)
            nth = np.arange(len(tok)) - np.repeat(head, np.diff(np.concatenate((head, [len(tok)]))))
            split = _parts(tok >> 35, hot)
            crossed = tok >> 34 & 1 == 1  # here only groups of different parts meet
            side = _part(gid, split)
            for i, j in _meeting(tok, star, size, threshold):
                room = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
                # a clipped position is no bound
                ok = (room >= threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9) | (pos[i] == 65535) | (pos[j] == 65535)
                ok &= (gid[i] != gid[j]) & ~(crossed[i] & (side[i] == side[j]))
                x, y = i[ok], j[ok]
                part = nth[x] // BLOCK_DOCS * 1_000_003 + nth[y] // BLOCK_DOCS
                beyond = np.maximum(0, np.ceil(threshold * size[y] - 1e-9).astype(np.int64) - SHARED)
                need = np.ceil(threshold / (1 + threshold) * (size[x] + size[y]) - beyond - 1e-6).astype(np.int64)
                where = tk.mix((tok[x] * 31 + part).view(_U)).view(np.int64) & 0xFFFFFF
                found.append((np.minimum(gid[x], gid[y]), np.maximum(gid[x], gid[y]), (need << 32) | where, np.ones(len(x), dtype=np.int32)))
                held += len(x)
                if held > room_for:
                    squeeze()
                    held = len(found[0][0])
                    room_for = max(HELD_PAIRS, 2 * held)
                    if held > SENT_PAIRS:
                        yield sent()
                        found, held, room_for = [], 0, HELD_PAIRS
        if found:
            squeeze()
            yield sent()
        found = []
        give_back()

    return run


def _likely(threshold: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(left["doc"].to_pylist(), zip(left["size"].to_pylist(), left["bits"].to_pylist())))
        keep = []
        for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist()):
            (n, x), (m, y) = held[a], held[b]
            keep.append(least_difference(x, y) <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-6)
        return right.select(["a", "b", "k"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocked(pairs: DataFrame, n_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with a block chosen by their gram, and the documents (block, doc) that each block needs."""
    blocks = int(max(12, -(-n_pairs // BLOCK_PAIRS)))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    return pairs.select(F.col("block").alias("pair_block"), "a", "b", "k"), pairs.select("block", F.explode(F.array("a", "b")).alias("doc")).distinct()


def _small(places: DataFrame) -> DataFrame:
    """With a broadcast hint up to `BROADCAST_ROWS` rows, counted first: then sets go to their blocks in one shuffle instead of two."""
    return F.broadcast(places) if places.count() <= BROADCAST_ROWS else places


def _checked(threshold: float, left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and similarity of the pairs that have it."""
    sets = {d: np.frombuffer(x, dtype=_U) for d, x in zip(left["doc"].to_pylist(), left["grams"].to_pylist())}
    out: tuple[list, list, list] = ([], [], [])
    for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist()):
        x, y = sets[a], sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        j = both / (len(x) + len(y) - both)
        if j >= threshold:
            for col, v in zip(out, (a, b, j)):
                col.append(v)
    return np.array(out[0], dtype=np.int64), np.array(out[1], dtype=np.int64), np.array(out[2])


def _verify(threshold: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("a", "b", "jaccard"), map(pa.array, _checked(threshold, left, right)))))

    return run


def _tally(threshold: float):
    """(doc, links, root) of a block's documents with links: how many documents these lead to, and the smallest one reached within the block."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, _ = _checked(threshold, left, right)
        nodes, ia, ib, root = linked(a, b)
        copies = dict(zip(left["doc"].to_pylist(), left["copies"].to_pylist()))
        n = np.array([copies[x] for x in nodes.tolist()], dtype=np.int64)
        links = np.bincount(ia, weights=n[ib], minlength=len(n)) + np.bincount(ib, weights=n[ia], minlength=len(n))
        return pa.table({"doc": pa.array(nodes), "links": pa.array(links.astype(np.int64)), "root": pa.array(root)})

    return run


def in_company(reps: DataFrame) -> DataFrame:
    """(rep, nth, h) of those (rep, mins) that agree with enough others in a pair of min-hashes: the one in which the most agree."""
    keys = reps.select("rep", F.posexplode("mins").alias("nth", "h"))
    heavy = keys.groupBy("nth", "h").agg(F.count("*").alias("c")).where(F.col("c") >= STAR_DOCS)
    return keys.join(heavy, ["nth", "h"]).groupBy("rep").agg(F.max(F.struct("c", "nth", "h")).alias("top")).select("rep", "top.nth", "top.h")


def core_of(flat: np.ndarray, rows: int) -> tuple[np.ndarray, int]:
    """What most of the sets have, with an end mark, and a hash of it."""
    tok, c = np.unique(flat, return_counts=True)
    core = np.concatenate((tok[2 * c > rows], [_U(0xFFFFFFFFFFFFFFFF)]))
    return core, int(np.add.reduce(tk.mix(core)).view(np.int64))


def near_core(core: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    both = np.bincount(np.repeat(np.arange(len(size)), size), weights=core[np.searchsorted(core, flat)] == flat, minlength=len(size))
    return both >= STAR_NEAR * (size + len(core) - 1 - both)


def _stars(docs: DataFrame, reps: DataFrame, n: int, classes) -> DataFrame:
    """(psig, size, doc, copies, star, parts, grams) of the representatives in a star, which goes by its smallest one; all of a group are in it or none."""
    mine = written(in_company(reps.select("rep", "mins")).join(reps.drop("mins"), "rep"), "min-hashes")

    def near(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = None
        for b in batches:
            data, off = tk.string_buffers(b["grams"])
            flat, size = np.frombuffer(data[off[0] : off[-1]].tobytes(), dtype=_U), np.diff(off) // 8
            if core is None:
                core, name = core_of(flat, b.num_rows)
            ok = near_core(core, flat, size)
            b = b.filter(pa.array(ok)).drop_columns(["nth", "h"])
            yield b.append_column("core", pa.array(np.full(b.num_rows, name)))
        give_back()

    sets = _sets(docs, mine.select(F.col("rep").alias("doc")), n, classes).join(mine.withColumnRenamed("rep", "doc"), "doc")
    order = ["psig", "size", "doc", "copies", "gid", "n", "grams"]
    got = sets.select(*order, "nth", "h").groupBy("nth", "h").applyInArrow(near, "psig long, size int, doc long, copies long, gid long, n long, grams binary, core long")
    got = written(got, "near")
    whole = got.groupBy("gid").agg(F.first("core").alias("core"), F.min("core").alias("lo"), F.max("core").alias("hi"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("size").alias("size"), F.min("doc").alias("least"))
    whole = whole.where("lo = hi and c = n")
    cores = whole.groupBy("core").agg((F.min("least") + 1).alias("star"), F.sum(F.col("size") * F.col("c")).alias("held"), F.sum("c").alias("members")).where("members > 1")
    cores = cores.select("core", F.when(F.col("star") > 0, F.col("star")).otherwise(F.col("star") - 1).alias("star"), F.ceil(F.col("held") / STAR_GRAMS).cast("int").alias("parts"))
    place = whole.select("gid", "core").join(cores, "core").select("gid", "star", "parts")
    return got.drop("core", "n").join(place, "gid").select("psig", "size", "doc", "copies", "star", "parts", "grams")


def in_common(row: np.ndarray, tok: np.ndarray, m: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(lo, matrix): what each of the rows left[lo:lo + STAR_ROWS] has in common with each of `right`, which is `left` or disjoint from it.

    (row, tok) are distinct; m rows.  A token counts as its weight, or 1.  Whole numbers are exact.
    """
    _, first, inv, n = np.unique(tok, return_index=True, return_inverse=True, return_counts=True)
    w = np.ones(len(n)) if weight is None else weight[first].astype(float)
    wide = n > max(8, m // 64)
    kind = np.float32 if (w * n).sum() < 1 << 24 or w[wide].sum() < 1 << 24 else np.float64
    x = np.zeros((m, int(wide.sum())), dtype=kind)
    at = wide[inv]
    x[row[at], (np.cumsum(wide) - 1)[inv[at]]] = 1
    y = np.ascontiguousarray(x[right].T)
    x = x[left] * w[wide].astype(kind)
    few = np.flatnonzero(~at & (n[inv] > 1))
    few = few[np.argsort(inv[few], kind="stable")]
    r, c = np.full(m, -1), np.full(m, -1)
    r[left], c[right] = np.arange(len(left)), np.arange(len(right))
    theirs = few[c[row[few]] >= 0]
    col, held = c[row[theirs]], np.bincount(inv[theirs], minlength=len(n))
    first = np.cumsum(held) - held
    mine = few[r[row[few]] >= 0]
    mine = mine[np.argsort(r[row[mine]], kind="stable")]
    nth, line = inv[mine], r[row[mine]]
    for lo in range(0, len(left), STAR_ROWS):
        both = (x[lo : lo + STAR_ROWS] @ y).astype(float)
        a, z = np.searchsorted(line, (lo, lo + STAR_ROWS))
        k = held[nth[a:z]]
        at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k - first[nth[a:z]], k)
        np.add.at(both.ravel(), np.repeat((line[a:z] - lo) * len(right), k) + col[at], np.repeat(w[nth[a:z]], k))
        yield lo, both


def joined(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Give the components of row i and of others (any number) the smallest of their labels."""
    seen = label[others]
    low = min(int(seen.min(initial=label[i])), int(label[i]))
    if label[i] != low or (seen != low).any():
        label[np.isin(label, np.append(seen, label[i]))] = low


def _star_tally(threshold: float):
    """As _tally, for all pairs of two parts of a star, or within one."""

    def run(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        got = got.sort_by("doc").combine_chunks()
        doc, copies, part = (got[c].to_numpy() for c in ("doc", "copies", "part"))
        data, off = tk.string_buffers(got["grams"].chunk(0))
        tok, size = np.frombuffer(data[off[0] : off[-1]].tobytes(), dtype=_U), np.diff(off) // 8
        a, b = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
        links, label, n = np.zeros(len(doc)), np.arange(len(doc)), copies.astype(float)
        for lo, both in in_common(np.repeat(np.arange(len(doc)), size), tok, len(doc), left, right):
            mine = left[lo : lo + len(both)]
            ok = both / (size[mine][:, None] + size[right] - both) >= threshold
            if a == b:
                ok[np.arange(len(mine)), lo + np.arange(len(mine))] = False
            else:
                links[right] += n[mine] @ ok
            links[mine] += ok @ n[right]
            for i, hit in zip(mine.tolist(), ok):
                joined(label, i, right[hit])
        has = links > 0
        give_back()
        return pa.table({"doc": pa.array(doc[has]), "links": pa.array(links[has].astype(np.int64)), "root": pa.array(doc[label[has]])})

    return run


def _within_stars(stars: DataFrame, threshold: float) -> DataFrame:
    """(doc, links, root) over all pairs within a star."""
    part = stars.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = part.select("star", "doc", "copies", "part", "grams", other).select("star", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "doc", "copies", "part", "grams")
    return met.groupBy("star", "a", "b").applyInArrow(_star_tally(threshold), "doc long, links long, root long")


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nodes of some edges, both ends as numbers of nodes, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, ia, before[ib])
        np.minimum.at(label, ib, before[ia])
        label = label[label]
        if (label == before).all():
            return nodes, ia, ib, nodes[label]


def _sets(docs: DataFrame, ids: DataFrame, n: int, classes) -> DataFrame:
    """(doc, grams) for the documents of `ids` (doc) and few others: a Bloom filter keeps most from moving before the exact join."""
    hashed = ids.select(F.xxhash64("doc").alias("h"))
    bloom = collect_bloom(hashed, "h", hashed.count())
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(held.value.hit(b.column(2).to_numpy(zero_copy_only=False).view(_U))))
            if not b.num_rows:
                continue
            for lo, hi, row, tok in ordered_sets(b.column(1), n, classes.value):
                if len(tok):
                    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    ends = np.concatenate((at, [len(tok)])) * 8
                    blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(tok.tobytes())])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at] + lo)), blob], names=["doc", "grams"])

    return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc long, grams binary")


def _candidate_sets(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, starred: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Signatures; representatives with the number of their copies; sets (block, doc, copies, grams) and pairs (pair_block, a, b, k) to verify; stars, whose own pairs these leave out."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("need 0 < threshold <= 1 and n >= 1")
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    total = d.select(F.count("*"), F.count_distinct("doc_id"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if total[0] != total[1]:
        d = d.groupBy("doc_id").agg(F.max("text").alias("text"))
    width = 1 << 16
    while width < total[2] // 6 and width < SKETCH_MAX:  # about a slot for each gram
        width *= 2
    held = spark.sparkContext.broadcast(sketch(d, n, width))
    rows = signatures(d, n, threshold, held)
    groups = rows.groupBy("psig", "size").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"))
    sigs = written(rows.select("doc_id", "size", "psig", "ssig", "bits", *["mins"] * starred), "signatures")
    sizes = sigs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_buckets = int(max(12, -(-sizes * (1 - threshold) // BUCKET_POSTINGS)))
    hot = max(HOT_CLASS, int(sizes // width).bit_length() + 2)  # well over what slots hold by chance
    reps = sigs.groupBy("psig", "size", "ssig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first("mins").alias("mins")] * starred)
    group = Window.partitionBy("psig", "size")
    reps = written(reps.withColumns({"gid": F.min("rep").over(group), "n": F.count("*").over(group)}), "representatives")
    several = reps.where("n > 1").select("gid", "rep")
    stars = None
    if starred:
        stars = written(_stars(d, reps, n, held), "stars")
        groups = groups.join(stars.select("psig", "size", "star").distinct(), ["psig", "size"], "left")
        several = several.join(stars.select(F.col("doc").alias("rep")), "rep", "left_anti")
    groups = groups.select("gid", "size", "prefix", F.coalesce("star", F.lit(0)).alias("star") if starred else F.lit(0).cast("long").alias("star"))
    cand = groups.mapInArrow(_blocks(n_buckets, hot), "bucket int, tok binary, pos binary, gid binary, size binary, star binary").groupBy("bucket").applyInArrow(_candidates(threshold, hot), "ga long, gb long, k long, m int")
    cand = cand.groupBy("ga", "gb").agg(F.min("k").alias("k"), F.sum("m").alias("m")).where("m >= shiftright(k, 32)").select("ga", "gb", "k")
    between = cand.join(reps.select(F.col("gid").alias("ga"), F.col("rep").alias("x")), "ga").join(reps.select(F.col("gid").alias("gb"), F.col("rep").alias("y")), "gb")
    within = several.withColumnRenamed("rep", "a").join(several.withColumnRenamed("rep", "b"), "gid").where("a < b").select(F.xxhash64("gid").alias("k"), "a", "b")
    pairs = written(between.select("k", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within), "candidates")
    right, places = _blocked(pairs, pairs.count())
    bits = sigs.select(F.col("doc_id").alias("doc"), "size", "bits").join(_small(places), "doc").select("block", "doc", "size", "bits")
    likely = bits.groupBy("block").cogroup(right.groupBy("pair_block")).applyInArrow(_likely(threshold), "a long, b long, k long")
    pairs = written(likely, "likely")
    right, places = _blocked(pairs, pairs.count())
    places = places.join(reps.select(F.col("rep").alias("doc"), "copies"), "doc")
    sets = _sets(d, places.select("doc").distinct(), n, held)
    return sigs, reps, sets.join(_small(places), "doc").select("block", "doc", "copies", "grams"), right, stars


def classes_and_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, rep): documents with grams and the smallest id with the same gram set.  Pairs (a, b, jaccard): a < b,
    representatives of different sets with at least the threshold.

    Null ids and null texts take no part; equal rows count once; of different texts under one id, the text that sorts last counts.
    """
    sigs, reps, left, right, _ = _candidate_sets(docs, n, threshold, id_col, text_col)
    found = left.groupBy("block").cogroup(right.groupBy("pair_block")).applyInArrow(_verify(threshold), "a long, b long, jaccard double")
    return _classes(sigs, reps), written(found, "pairs")


def _classes(sigs: DataFrame, reps: DataFrame) -> DataFrame:
    return sigs.join(reps, ["psig", "size", "ssig"]).select("doc_id", "rep")


def _linked(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, links (rep, others) without those of copies, and roots (rep, root) of representatives that have any."""
    sigs, reps, left, right, stars = _candidate_sets(docs, n, threshold, id_col, text_col, starred=True)
    between = left.groupBy("block").cogroup(right.groupBy("pair_block")).applyInArrow(_tally(threshold), "doc long, links long, root long")
    tally = written(between.unionByName(_within_stars(stars, threshold)), "tally")
    roots = components(tally.select(F.col("doc").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    return sigs.join(reps, ["psig", "size", "ssig"]).select("doc_id", "rep", "copies"), tally.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("others")), roots


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for every non-null id of `docs`, once.

    n_links is the number of other documents whose similarity is at least the threshold, copies included; class_id is the smallest
    id that can be reached over such links.  A document without words or text is alone.  For the pairs themselves
    see classes_and_pairs, also for nulls and repeats.
    """
    classes, links, roots = _linked(docs, n, threshold, id_col, text_col)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(classes, "doc_id", "left").join(links.join(roots, "rep", "left"), "rep", "left")
    n_links = F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), n_links.alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the edges (a, b), by alternating large and small stars."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small, "edges")
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those that a smaller id of their connected group stands for; all columns stay.

    Documents without words and rows with a null id or text always stay; rows that repeat an id share its fate.
    """
    classes, _, roots = _linked(docs, n, threshold, id_col, text_col)
    gone = classes.join(roots, "rep", "left").where(F.coalesce("root", "rep") != F.col("doc_id"))
    name = fresh(docs, "_gone")
    gone = written(gone.select(F.col("doc_id").alias(name)), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') as w from documents
), g as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as gram from w
), s as (
  select doc_id, count(*) as n, list(gram order by gram) as grams from g group by doc_id
), c as (
  select min(doc_id) as rep, any_value(n) as n, list(doc_id) as docs from s group by grams
), r as (
  select g.doc_id, g.gram from g join c on g.doc_id = c.rep
), p as (
  select x.doc_id as a, y.doc_id as b, count(*) as m from r x join r y on x.gram = y.gram and x.doc_id <> y.doc_id group by all
), e as (
  select a, b, len(cb.docs) as nb from p join c ca on ca.rep = a join c cb on cb.rep = b where m / (ca.n + cb.n - m) >= 0.6
), reach as (
  select rep as a, rep as b from c union select reach.a, e.b from reach join e on reach.b = e.a
), root as (
  select a as rep, min(b) as class_id from reach group by a
), links as (
  select a as rep, sum(nb) as others from e group by a
), got as (
  select unnest(docs) as doc_id, class_id, len(docs) - 1 + coalesce(others, 0) as n_links from c join root using (rep) left join links using (rep)
)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, cast(coalesce(n_links, 0) as bigint) as n_links from documents d left join got using (doc_id)
"""
