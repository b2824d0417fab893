"""Content-defined chunks that several rows share: found by digest counts, kept once, joined back by digest.

Only chunks that occur at least twice are worth moving.  Their digests are counted in one aggregate over 16-byte
digests; a split-block Bloom filter of them, of bounded size, tells each task which of its chunks to look for in the store.  A false positive, and
there are more beyond some 30 million repeated digests, costs a needless store row; the store's own counts say what is shared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .support import collect_bloom, written

Sizes = tuple[int, int, int]


def chunks_of(column: pa.Array, sizes: Sizes):
    """(row, its bytes, its chunk ends, 16-byte digest of each chunk) for each row; an empty row has no chunk."""
    for lo, _, data, off in tk.slices(column):
        raw = data.tobytes()
        for k, cuts in enumerate(tk.cdc_cuts(data, off, *sizes)):
            begin = int(off[k])
            ends = cuts.tolist()
            digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([begin, *ends], ends)]
            yield lo + k, raw[begin : int(off[k + 1])], [e - begin for e in ends], digests


def keys_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2]


def repeated(df: DataFrame, sizes: Sizes, name: str):
    """Broadcast of the Bloom filter of digests that occur twice or more in the one column of `df`."""

    def run(batches):
        for b in batches:
            out: list[bytes] = []
            for _, _, _, digests in chunks_of(b.column(0), sizes):
                out += digests
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(out).view(np.int64)), pa.array(out, pa.binary())], names=["h", "digest"])

    seen = df.mapInArrow(run, "h long, digest binary").groupBy("h", "digest").count().where("count > 1").select("h")
    seen = written(seen, name)
    return df.sparkSession.sparkContext.broadcast(collect_bloom(seen, "h", seen.count()))


def is_shared(bloom, digests: list[bytes]) -> list[bool]:
    if not digests:
        return []
    return bloom.hit(keys_of(digests)).tolist()


def store(df: DataFrame, sizes: Sizes, held, pack: Callable[[bytes], bytes]) -> DataFrame:
    """(digest, payload, n): each chunk that may be shared once, packed before it is shuffled, and how often it occurs."""

    def run(batches):
        for b in batches:
            got: dict[bytes, bytes] = {}
            n: Counter[bytes] = Counter()
            for _, raw, ends, digests in chunks_of(b.column(0), sizes):
                for d, a, e, hit in zip(digests, [0, *ends], ends, is_shared(held.value, digests)):
                    if hit:
                        n[d] += 1
                        if d not in got:
                            got[d] = pack(raw[a:e])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary()), pa.array([n[d] for d in got], pa.int64())], names=["digest", "payload", "n"])

    return df.mapInArrow(run, "digest binary, payload binary, n long").groupBy("digest").agg(F.first("payload").alias("payload"), F.sum("n").alias("n"))


def fetch(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows with uid and refs (array of digests) get `found`, a list of (k, payload, n) for each reference k.

    References join the store by digest and come back by uid.
    """
    refs = rows.select("uid", F.posexplode("refs").alias("k", "digest"))
    found = refs.join(kept, "digest").groupBy("uid").agg(F.collect_list(F.struct("k", "payload", "n")).alias("found"))
    return rows.join(found, "uid")
