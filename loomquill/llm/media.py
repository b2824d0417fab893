"""Operator 9: media columns as content-defined chunks that are stored once, and their verified reconstruction.

A payload is cut where a rolling gear hash says so, and becomes an ordered list of chunk digests (128-bit XXH3).  Digests
are counted in one aggregate.  A chunk that occurs twice or more goes into the chunk store, once, and payloads refer to it; one
that occurs once is stored in the manifest row of its payload, between the references.  So every distinct chunk is stored once, in one of two
written tables, and every payload is rebuilt from them: references join the store by digest, chunks are put in order, and length and
SHA-256 are compared with the manifest's.

Plan: the manifest is written by a narrow stage; only references and shared chunks are shuffled.  A task holds a batch of rows and a slice of one payload
at a time, or one longer payload.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkstore as cs
from .support import written

SIZES = (256, 1024, 4096)
SCHEMA = "media_id long, n_bytes long, sha256 string, n_shared int, chunks array<string>, verified boolean, payload binary"
MANIFEST = "uid long, media_id long, n_bytes long, sha256 string, chunks array<binary>, own array<binary>, refs array<binary>"
_KIND = pa.schema([("media_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("n_shared", pa.int32()), ("chunks", pa.list_(pa.string())), ("verified", pa.bool_()), ("payload", pa.binary())])
_MANIFEST = pa.schema([("uid", pa.int64()), ("media_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("chunks", pa.list_(pa.binary())), ("own", pa.list_(pa.binary())), ("refs", pa.list_(pa.binary()))])
_NONE = {"n_bytes": None, "sha256": None, "n_shared": 0, "chunks": None, "verified": None, "payload": None}


def _pick(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("media_id"), F.col(payload_col).cast("binary").alias("payload"))


def _rebuilt(media_id, n_bytes: int, sha256: str, n_shared: int, digests: list[bytes], parts: list[bytes]) -> dict:
    whole = b"".join(parts)
    same = len(whole) == n_bytes and hashlib.sha256(whole).hexdigest() == sha256
    return {"media_id": media_id, "n_bytes": n_bytes, "sha256": sha256, "n_shared": n_shared, "chunks": [d.hex() for d in digests], "verified": same, "payload": whole if same else None}


def _in_batches(rows, schema: pa.Schema, size: int = 8 << 20):
    held, n = [], 0
    for r, weight in rows:
        held.append(r)
        n += weight + 64
        if n > size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def manifest(media: DataFrame, held, sizes: cs.Sizes = SIZES) -> DataFrame:
    """MANIFEST for every row of (media_id, payload): own[i] holds the bytes ahead of refs[i], the last one those at the end."""

    def run(batches):
        for b in batches:
            ids, uids, valid = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).is_valid().to_pylist()

            def rows():
                for r, raw, ends, digests in cs.chunks_of(b.column(1), sizes):
                    if not valid[r]:
                        yield {"uid": uids[r], "media_id": ids[r], "n_bytes": None, "sha256": None, "chunks": None, "own": [], "refs": []}, 0
                        continue
                    own, refs, at = [], [], 0
                    for d, a, e, hit in zip(digests, [0, *ends], ends, cs.is_shared(held.value, digests)):
                        if hit:
                            own.append(raw[at:a])
                            refs.append(d)
                            at = e
                    own.append(raw[at:])
                    yield {"uid": uids[r], "media_id": ids[r], "n_bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "chunks": digests, "own": own, "refs": refs}, len(raw)

            yield from _in_batches(rows(), _MANIFEST)

    return media.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, MANIFEST)


def _from_rows(batches):
    for b in batches:

        def done():
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["chunks"] is None:
                    yield {"media_id": r["media_id"], **_NONE}, 0
                    continue
                found = {x["k"]: x["payload"] for x in r["found"] or ()}
                n_shared = sum(x["n"] > 1 for x in r["found"] or ())
                parts = [x for k, own in enumerate(r["own"]) for x in (own, found.get(k, b""))]
                yield _rebuilt(r["media_id"], r["n_bytes"], r["sha256"], n_shared, r["chunks"], parts), r["n_bytes"]

        yield from _in_batches(done(), _KIND)


def reconstruct(rows: DataFrame, store: DataFrame) -> DataFrame:
    """SCHEMA from manifest rows and the chunk store; a payload that isn't verified is null."""
    columns = ("media_id", "n_bytes", "sha256", "chunks", "own", "refs")
    alone = rows.where(F.size("refs") == 0).select(*columns, F.lit(None).cast("array<struct<k:int,payload:binary,n:bigint>>").alias("found"))
    return alone.mapInArrow(_from_rows, SCHEMA).unionByName(cs.fetch(rows.where(F.size("refs") > 0), store).select(*columns, "found").mapInArrow(_from_rows, SCHEMA))


def media_chunks(df: DataFrame, sizes: cs.Sizes = SIZES, id_col: str = "media_id", payload_col: str = "payload") -> DataFrame:
    """SCHEMA for every row: ordered chunk digests, how many of them occur elsewhere or again, and the payload rebuilt from the stored chunks.

    A null payload has null columns and no chunk; an empty payload has 0 bytes, no chunk and is verified.  Null ids and
    repeated rows are kept as they are; a text column counts as its UTF-8 bytes; other columns are ignored.
    """
    media = _pick(df, id_col, payload_col)
    payloads = media.select("payload")
    held = cs.repeated(payloads, sizes, "media-chunks")
    rows = written(manifest(media, held, sizes), "media-manifest")
    return reconstruct(rows, written(cs.store(payloads, sizes, held, bytes), "media-store"))
