"""Operator 4: byte-level BPE with content-defined chunk reuse.

Texts are cut into content-defined chunks.  Chunks that occur more than once are encoded once and joined back by digest;
whatever lies between them is encoded in place.  A chunk encoded alone can differ from the same bytes within a text near
its two ends, so joins are repaired: the split pattern never joins a blank to a preceding non-blank, hence a token border
is certain before every blank that follows a non-blank.  Around each join the bytes from the last such border on the left to the
first one on the right are encoded anew; if a side has none, the stretch widens over the next piece, until both ends
agree with the neighbouring tokens.  The result is exactly that of encoding each text whole, and decoding gives its bytes.

Plan: documents without a shared chunk are encoded in one narrow stage; only the others' tokens are shuffled.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunkstore as cs
from . import textkit as tk
from .support import give_back, written

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIZES = (128, 512, 2048)
SCHEMA = "doc_id long, n_bytes long, n_tokens int, round_trip boolean, tokens array<int>"
#: Runs of what the pattern calls a blank that are too long for its engine.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
_open: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of a rank file."""

    def __init__(self, file: str, pattern: str = PATTERN):
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("loomquill", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.blanks = _BLANKS if pattern == PATTERN else None
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    @classmethod
    def get(cls, file: str) -> Codec:
        """One codec a worker."""
        if file not in _open:
            _open[file] = cls(file)
        return _open[file]

    def encode(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokens(raw.decode()), dtype=np.int32)

    def tokens(self, text: str) -> list[int]:
        """Tokens of a whole text.

        The pattern engine can't take a run of very many blanks.  The default pattern makes one piece of such a run but for its last blank,
        or of all of it at the end of the text, so that piece is encoded by itself and the rest goes on from there.
        """
        if not self.blanks:
            return self.encoder.encode_ordinary(text)
        out, at = [], 0
        for m in self.blanks.finditer(text):
            a, z = m.span()
            z -= z < len(text)
            out += self.encoder.encode_ordinary(text[at:a])
            out += self.encoder._core_bpe.encode_single_piece(text[a:z].encode())
            at = z
        return out + self.encoder.encode_ordinary(text[at:]) if at else self.encoder.encode_ordinary(text)

    def decode(self, tokens: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, tokens.tolist()))

    def join(self, parts: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
        """Tokens and bytes of consecutive separately encoded parts, repaired to the encoding of the whole."""
        raws = [self.decode(p) for p in parts]
        out: list[np.ndarray] = []
        open_bytes = b""  # bytes since the last certain border, still to be encoded
        for i, (p, raw) in enumerate(zip(parts, raws)):
            last = i == len(parts) - 1
            first_cut = 0 if i == 0 else _border(raws[i - 1][-1:], raw, False)
            last_cut = len(raw) if last else _border(raws[i - 1][-1:] if i else b"", raw, True)
            if first_cut is None or last_cut is None or last_cut < first_cut or (last_cut == first_cut and not last):
                if first_cut is not None and i == 0 and last_cut is None:
                    first_cut = None
                if last and first_cut is not None:
                    pass
                else:
                    open_bytes += raw
                    continue
            ends = np.cumsum(self.sizes[p])
            a = int(np.searchsorted(ends, first_cut, side="right")) if first_cut else 0
            b = int(np.searchsorted(ends, last_cut, side="left")) + 1 if last_cut else 0
            if last_cut and (ends[b - 1] != last_cut or (first_cut and (a == 0 or ends[a - 1] != first_cut))):
                open_bytes += raw  # no token ends there: the stretch widens over this part
                continue
            if open_bytes or first_cut:
                out.append(self.encode(open_bytes + raw[:first_cut]))
            out.append(p[a:b])
            open_bytes = raw[last_cut:]
        if open_bytes:
            out.append(self.encode(open_bytes))
        return (np.concatenate(out) if out else np.zeros(0, dtype=np.int32)), b"".join(raws)


_BLANK = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _border(before: bytes, raw: bytes, backwards: bool) -> int | None:
    """First or last offset of a blank (0x20) that follows an ASCII non-blank; `before` is the byte ahead of `raw`."""
    at = raw.rfind(b" ") if backwards else raw.find(b" ")
    while at >= 0:
        prev = raw[at - 1] if at else (before[0] if before else 32)
        if 33 <= prev < 127:
            return at
        at = raw.rfind(b" ", 0, at) if backwards else raw.find(b" ", at + 1)
    return None


def _batch(ids: list, raws: list[bytes], tokens: list[np.ndarray], decoded: list[bytes]) -> pa.RecordBatch:
    flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int32)
    n = np.array([len(t) for t in tokens], dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(n.astype(np.int32)), pa.array([a == b for a, b in zip(raws, decoded)], pa.bool_()), tk.list_array(pa.array(flat.astype(np.int32)), n)],
        names=["doc_id", "n_bytes", "n_tokens", "round_trip", "tokens"],
    )


def encode(docs: DataFrame, ranks_file: str, sizes: cs.Sizes = SIZES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row: exact tokens, and whether decoding them gave the text's bytes again.

    A null text counts as empty; an empty text has no tokens.  Null ids and repeated rows are encoded like any other;
    other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = d.select(F.col("text").cast("binary").alias("text"))
    held = cs.repeated(texts, sizes, "bpe-chunks")

    def alone(batches):
        for b in batches:
            codec = Codec.get(ranks_file)
            ids = b.column(0).to_pylist()
            got: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for r, raw, _, digests in cs.chunks_of(b.column(1), sizes):
                if not any(cs.is_shared(held.value, digests)):
                    t = codec.encode(raw)
                    for col, v in zip(got, (ids[r], raw, t, codec.decode(t))):
                        col.append(v)
                    size += len(raw)
                    if size > 4 << 20:
                        yield _batch(*got)
                        got, size = ([], [], [], []), 0
            if got[0]:
                yield _batch(*got)

    def split(batches):
        kind = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.binary()), ("n_bytes", pa.int64()), ("own", pa.list_(pa.binary())), ("refs", pa.list_(pa.binary()))])
        for b in batches:
            codec = Codec.get(ranks_file)
            ids, uids = b.column(0).to_pylist(), b.column(2).to_pylist()
            rows = []
            for r, raw, ends, digests in cs.chunks_of(b.column(1), sizes):
                shared = cs.is_shared(held.value, digests)
                if any(shared):
                    own, refs, at = [], [], 0  # own[i] comes before refs[i]; the last one after all
                    for d_, a, e, hit in zip(digests, [0, *ends], ends, shared):
                        if hit:
                            own.append(codec.encode(raw[at:a]).tobytes())
                            refs.append(d_)
                            at = e
                    own.append(codec.encode(raw[at:]).tobytes())
                    rows.append({"uid": uids[r], "doc_id": ids[r], "hash": cs.xxhash.xxh3_128_digest(raw), "n_bytes": len(raw), "own": own, "refs": refs})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    def encode_store(batches):
        for b in batches:
            codec = Codec.get(ranks_file)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.encode(x).tobytes() for x in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["digest", "payload", "n"])

    def repair(batches):
        for b in batches:
            codec = Codec.get(ranks_file)
            for lo in range(0, b.num_rows, 500):
                got: tuple[list, list, list, list] = ([], [], [], [])
                for r in b.slice(lo, 500).to_pylist():
                    refs = {x["k"]: x["payload"] for x in r["found"]}
                    parts = []
                    for i, own in enumerate(r["own"]):
                        parts += [own] + ([refs[i]] if i < len(r["refs"]) else [])
                    tokens, raw = codec.join([np.frombuffer(p, dtype=np.int32) for p in parts if p])
                    whole = codec.decode(tokens)
                    same = whole == raw and len(raw) == r["n_bytes"] and cs.xxhash.xxh3_128_digest(whole) == r["hash"]
                    for col, v in zip(got, (r["doc_id"], raw, tokens, raw if same else None)):
                        col.append(v)
                yield _batch(*got)

    direct = d.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(alone, SCHEMA)
    keyed = d.select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = written(keyed.mapInArrow(split, "uid long, doc_id long, hash binary, n_bytes long, own array<binary>, refs array<binary>"), "bpe-rows")
    kept = cs.store(texts, sizes, held, bytes).mapInArrow(encode_store, "digest binary, payload binary, n long")
    joined = cs.fetch(rows, kept).select("doc_id", "hash", "n_bytes", "own", "refs", "found")
    return direct.unionByName(joined.mapInArrow(repair, SCHEMA))


def token_count(text: Column, ranks_file: str) -> Column:
    """Number of tokens of each whole text; 0 for a null."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        encode = Codec.get(ranks_file).tokens
        out = [len(encode(t.as_py() or "")) for t in column]
        give_back()
        return pa.array(out, pa.int64())

    return run(text)


def decode(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give a null text, bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def run(tokens: pa.Array) -> pa.Array:
        codec = Codec.get(ranks_file)
        return pa.array([None if t is None else codec.decode(np.array(t, dtype=np.int64)).decode(errors="replace") for t in tokens.to_pylist()], pa.string())

    return encoded.select("doc_id", run("tokens").alias("text"))
