"""Helpers shared by the training-data operators: scratch tables, row keys and byte-level tokenizing.

Scratch tables go to the folder named by ``spark.checkpoint.dir``. Where that is unset, a folder of the application on the default file
system is set, which executors and driver share; on a cluster whose default file system is each machine's own disk that is an error.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables and checkpoints."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        home = sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).toString().rstrip("/")
        if home.startswith("file:") and sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{home}/tmp/alphaloom-{sc.applicationId}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    _sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


_swept = [0.0]


def _sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished writes, which else stay for the whole job."""
    if time.monotonic() - _swept[0] > 2:  # a sweep takes a tenth of a second: not after every small table
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, a written table of narrow rows, broadcast if it has at most ``rows`` of them."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column | str = "text") -> Column:
    """A 64-bit key of a text; with the id it names a row, so repeated rows share one result."""
    return F.coalesce(F.xxhash64(F.col(text) if isinstance(text, str) else text), F.lit(0))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


# --- byte-level helpers for work inside tasks -----------------------------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _R, np.uint64), np.full(size, _RINV, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span data[start:end]; equal spans get equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes of one text and the starts and ends of its words, cut at ASCII white space."""
    low = _LOWER[data]
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return low, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_set(data: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of one text; of the whole sequence if it has fewer words."""
    low, starts, ends = words_of(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return shingles_from_words(span_hashes(low, starts, ends), k)


def shingles_from_words(h: np.ndarray, k: int) -> np.ndarray:
    n = min(k, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix64(out + h[j : len(h) - n + 1 + j] * np.uint64(2 * j + 3))
    return np.unique(out)
