"""Shared helpers: tables in the shared folder, and byte-level hashing with numpy."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the numpy kernels take at once; bounds their temporaries.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a single-JVM session may fall back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by saved() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_graphloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    if frames:  # Spark drops shuffle files only once the driver has collected what refers to them
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first, end) of runs of rows with about `most` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor, shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, _BASE)].astype(np.uint64))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each segment of data; segments ascend, do not overlap and are not empty."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * longest, _BASE)].astype(np.uint64))
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    values = byte_values[data[at]]
    values *= _POWERS[within]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True, cut at the given positions too."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[breaks[(breaks >= 0) & (breaks <= len(inside))]] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    return at[:-1][keep], at[1:][keep]
