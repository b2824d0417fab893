"""Operator 7: best-fit packing into sequences of several permitted lengths.

A text is measured in units: its whitespace-separated words by default, or any numeric column, such as true token counts.
A text longer than the largest length is cut into full pieces and a rest, so nothing is lost.  Within a packing
group pieces go, longest first, into the open bin with the least room that still holds them.  If none does, a new
bin is opened.  For every size that holds the piece it is worked out what the pieces that are still to come would fill it with, and the
size is taken that costs least for each unit it would then hold; the cost of size c is ``overhead + c + c * c / quadratic``.  The same is packed
with the smallest size that holds the piece, and the cheaper of the two packings stays.  At the end every bin shrinks to the smallest
permitted length that holds its contents.

Plan: only (id, length) is shuffled, once, to packing groups of about `group_rows` documents chosen by a hash of the
id; groups are independent, so the work is spread evenly whatever the data, and the loss is at most a few
half-filled bins a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

LENGTHS = (512, 1024, 2048, 4096, 8192)
SCHEMA = "bin_id string, capacity int, used int, doc_id long, piece int, piece_start long, piece_length int, bin_offset int"
_INK = np.ones(256, dtype=bool)
_INK[[ord(c) for c in " \t\n\r\f\x0b"]] = False


def word_count(text: Column) -> Column:
    """Number of runs without blanks, tabs and line ends; 0 for a null."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        out = [np.zeros(0, dtype=np.int64)]
        for lo, hi, data, off in tk.slices(column):
            s, _ = tk.runs(_INK[data], off)
            out.append(np.bincount(tk.rows_of(s, off), minlength=hi - lo))
        return pa.array(np.concatenate(out), pa.int64())

    return run(text)


def _fill(sizes: list[int], down: list[int], i: int, capacity: int) -> int:
    """What a bin of `capacity` opened for piece i would hold if, time and again, the largest of the later pieces that fits went in.

    sizes fall; down holds their negatives for bisection.
    """
    used, at = sizes[i], i + 1
    while used < capacity:
        at = bisect_left(down, used - capacity, at)
        if at == len(sizes):
            break
        used += sizes[at]
        at += 1
    return used


def _packed(pieces: list[tuple[int, int]], lengths: tuple[int, ...], cost: dict[int, float], ahead: bool) -> list[list[int]]:
    sizes = [n for _, n in pieces]
    down = [-n for n in sizes]
    rooms: list[int] = []  # sorted room of open bins
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i, (key, n) in enumerate(pieces):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at], by_room[room]
        else:
            fit = lengths[bisect_left(lengths, n) :]
            room = fit[0]
            if ahead and len(fit) > 1:
                held = {c: _fill(sizes, down, i, c) for c in fit}
                room = min(fit, key=lambda c: (cost[lengths[bisect_left(lengths, held[c])]] / held[c], c))
            bins.append([room, 0])
            b = len(bins) - 1
        bins[b][1] += n
        bins[b].append(key)
        room -= n
        if room:
            if room in by_room:
                by_room[room].append(b)
            else:
                by_room[room] = [b]
                insort(rooms, room)
    for b in bins:
        b[0] = lengths[bisect_left(lengths, b[1])]
    return bins


def total_cost(bins: list[list[int]], overhead: float = 16.0, quadratic: float = 8192.0) -> float:
    return sum(overhead + b[0] + b[0] * b[0] / quadratic for b in bins)


def pack(pieces: list[tuple[int, int]], lengths: tuple[int, ...] = LENGTHS, overhead: float = 16.0, quadratic: float = 8192.0) -> list[list[int]]:
    """Best fit for (key, length) pieces, longest first and equal ones by key: a list [capacity, used, keys...] for each bin.

    Pieces need 0 < length <= max(lengths).  Of a packing that looks ahead and one that always opens the smallest size, the cheaper one.
    """
    lengths = tuple(sorted(set(lengths)))
    cost = {c: overhead + c + c * c / quadratic for c in lengths}
    ordered = sorted(pieces, key=lambda p: (-p[1], p[0]))
    return min((_packed(ordered, lengths, cost, ahead) for ahead in (True, False)), key=lambda b: total_cost(b, overhead, quadratic))


def packer(lengths: tuple[int, ...], overhead: float, quadratic: float):
    most = max(lengths)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sizes = table["doc_id"].to_pylist(), table["n"].to_pylist()
        parts = []  # (row, piece, start, length)
        for r in sorted(range(len(ids)), key=lambda i: (ids[i], sizes[i])):
            for k, at in enumerate(range(0, sizes[r], most)):
                parts.append((r, k, at, min(most, sizes[r] - at)))
        bins = pack([(i, p[3]) for i, p in enumerate(parts)], lengths, overhead, quadratic)
        rows: list[list] = [[] for _ in range(8)]
        for b, (cap, used, *members) in enumerate(bins):
            at = 0
            for i in members:
                r, k, start, n = parts[i]
                for col, v in zip(rows, (f"{key[0].as_py()}-{b}", cap, used, ids[r], k, start, n, at)):
                    col.append(v)
                at += n
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        names = ("bin_id", "capacity", "used", "doc_id", "piece", "piece_start", "piece_length", "bin_offset")
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, rows, kinds)})

    return run


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = 16.0, quadratic: float = 8192.0, group_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """SCHEMA: a row for every piece of every document with at least one unit.

    Null ids, null and blank texts, and lengths that are null or not positive bring no piece.  Repeated rows are packed
    each.  Equal lengths go in the order of ids, so a result depends on the data alone.
    """
    if not lengths or min(lengths) <= 0 or group_rows <= 0:
        raise ValueError("lengths and group_rows must be positive")
    size = F.col(length_col).cast("long") if length_col else word_count(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n"))
    groups = max(1, -(-docs.select(id_col).count() // group_rows))
    rows = rows.where("doc_id is not null and n > 0").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    return rows.groupBy("g").applyInArrow(packer(tuple(lengths), overhead, quadratic), SCHEMA)
