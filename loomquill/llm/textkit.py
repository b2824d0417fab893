"""Vectorised byte-level primitives shared by the training-data operators.

Everything here works on Arrow string or binary columns handed over by ``mapInArrow``: the UTF-8 buffer is
viewed as a numpy byte array and processed in slices of about ``SLICE_BYTES`` so that temporaries stay small,
whatever the length of a batch.  A single text longer than a slice forms its own slice and is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64

#: Word bytes: ASCII letters, digits, and every byte of a multi-byte character.
WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
LETTER = WORD.copy()
LETTER[48:58] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([_U(1)], np.multiply.accumulate(np.full(n, base, dtype=_U))))


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_BASE_INV, 1 << 12)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INV, size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, off, data = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    if n == 0 or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about `size` bytes, or one longer row."""
    data, off = string_buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that never cross a document border."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(mask))])
    cut = inner[mask[inner] & mask[inner - 1]]
    if len(cut):
        s, e = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
    return s, e


def range_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit content hash of data[s:e] for rising arrays of starts and ends.

    Ranges are taken in groups that span about a slice, so temporaries don't grow with the length of a text.
    """
    if len(data) > 2 * SLICE_BYTES and len(s) > 1:
        out, i = np.empty(len(s), dtype=_U), 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE_BYTES, side="right")))
            out[i:j] = _range_hash(data[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i])
            i = j
        return out
    return _range_hash(data, s, e)


def _range_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    up, down = _Powers.get(len(data))
    acc = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=acc[1:])
    return mix((acc[e] - acc[s]) * down[s] + (e - s).astype(_U))


def rows_of(pos: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row (document of the slice) of each byte position."""
    return np.searchsorted(off, pos, side="right") - 1


def char_index(data: np.ndarray, off: np.ndarray, pos: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Character offset within its document of each byte position."""
    acc = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=acc[1:])
    return acc[pos] - acc[off[row]]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Byte-wise lower case of ASCII and the Latin-1 letters, lengths kept."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        hit = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[hit] += 32
    return out


_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW = 32


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each position: sum of G[byte] << age, built by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            nxt = h.copy()
            nxt[k:] += h[:-k] << np.uint32(k)
            h = nxt
    return h


def cdc_cuts(data: np.ndarray, off: np.ndarray, least: int, normal: int, most: int, window: int = WINDOW) -> list[np.ndarray]:
    """Ends of the normalised content-defined chunks of each document of a slice.

    A cut needs more zero bits before the `normal` size than after it, which narrows the spread of sizes.  Cuts
    are moved to the next character border.  As `least` is at least the hash window, a cut depends on nothing but
    the bytes of its own document; on the last `window` of them, for the hash's higher bits are dropped.  An empty document has no chunk.
    """
    bits = max(1, int(np.log2(max(1, normal))))
    if not bits + 1 <= window <= WINDOW or not window <= least <= normal <= most:
        raise ValueError(f"chunk sizes need window <= least <= normal <= most, and a window of {bits + 1} to {WINDOW}")
    h = gear(data) << np.uint32(WINDOW - window)
    top = h >> np.uint32(32 - min(31, bits + 1))
    weak = np.flatnonzero(top < 4)  # bits - 1 leading zeros
    strong = top[weak] == 0  # bits + 1 leading zeros
    lo = np.searchsorted(weak, off)
    lead = (data & 0xC0) != 0x80
    out = []
    for d in range(len(off) - 1):
        begin, end = int(off[d]), int(off[d + 1])
        pos, tight = weak[lo[d] : lo[d + 1]].tolist(), strong[lo[d] : lo[d + 1]].tolist()
        cuts, at, k, m = [], begin, 0, len(pos)
        while end - at > least:
            first, mid, last = at + least, at + normal, min(end, at + most)
            while k < m and pos[k] + 1 < first:
                k += 1
            j, cut = k, last
            while j < m and pos[j] + 1 < last:
                if tight[j] or pos[j] + 1 >= mid:
                    cut = pos[j] + 1
                    break
                j += 1
            k = j
            while cut < end and not lead[cut]:
                cut += 1
            if cut >= end:
                break
            cuts.append(cut)
            at = cut
        if end > begin:
            cuts.append(end)
        out.append(np.array(cuts, dtype=np.int64))
    return out


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values)
