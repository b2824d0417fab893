"""Shared Spark plumbing: the shared folder, written tables, bounded training samples, split-block Bloom filters."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='loomquill-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at interpreter exit
            pass


atexit.register(_clean)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it again.  Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomquill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(df: DataFrame) -> DataFrame:
    """`df`, a written table, after its driver has collected its garbage: only then does Spark remove shuffle files that nothing reads any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def rested(spark: SparkSession) -> None:
    """Let the executors' JVMs and the driver collect their garbage and so give memory back that an earlier stage of a pipeline took: Python needs it beside them."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on between stages, beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_unit(col: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def stratified(df: DataFrame, key: str, stratum: str, per_stratum: int, salt: int = 7) -> DataFrame:
    """About `per_stratum` rows of each value of `stratum`, chosen by a hash of `key`; never more than 1.5 times that.

    Needs one count by stratum and no sort.  Null keys and strata are left out.
    """
    df = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(stratum) == F.lit(value)) & (hash_unit(F.col(key), salt) < F.lit(min(1.0, per_stratum / n))))
    return df.where(keep).limit(int(1.5 * per_stratum * max(1, len(counts))))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def long_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a long column (XXH64 of eight bytes, seed 42)."""
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + _P5 + np.uint64(8)) ^ (_turned(x.astype(np.uint64, copy=False) * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


class Bloom:
    """Split-block Bloom filter of 64-bit hashes: one 256-bit block a key, one bit in each of its eight words."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def hit(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.uint64, copy=False)
        words = self.table[long_hash(h) & np.uint64(len(self.table) - 1)]
        out = np.ones(len(h), dtype=bool)
        for i in range(8):
            out &= (words[:, i] >> ((h >> np.uint64(5 * i)) & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return out


def bloom_blocks(hashes: DataFrame, h: str, n_keys: int, bits_per_key: int = 16, most: int | None = None) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the filter, built with bit_or aggregates, and the number of blocks (a power of two, `most` at most)."""
    blocks = 1
    while blocks * 256 < max(1, n_keys) * bits_per_key and (most is None or 2 * blocks <= most):
        blocks *= 2
    c = F.col(h)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(c, 5 * i).bitwiseAND(F.lit(31)).cast("int"))).alias(f"w{i}") for i in range(8)]
    return hashes.groupBy(block_of(c, blocks).alias("block")).agg(*words), blocks


def block_of(h: Column, blocks: int) -> Column:
    """Of a second hash of `h`, so that it is independent of the bits within the block."""
    return F.xxhash64(h).bitwiseAND(F.lit(blocks - 1))


def collect_bloom(hashes: DataFrame, h: str, n_keys: int, max_bytes: int = 64 << 20) -> Bloom:
    """The filter on the driver, for a broadcast, of `max_bytes` at most.

    With more keys than that gives 16 bits each, more of the others pass.  So a caller has to judge what passes exactly; size changes its
    cost and never its result.
    """
    table, blocks = bloom_blocks(hashes, h, n_keys, most=max(1, max_bytes // 32))
    got = table.toArrow()
    out = np.zeros((blocks, 8), dtype=np.uint32)
    at = got["block"].to_numpy().astype(np.int64)
    for i in range(8):
        out[at, i] = got[f"w{i}"].to_numpy().astype(np.int32).view(np.uint32)
    return Bloom(out)
