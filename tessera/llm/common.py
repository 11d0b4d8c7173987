"""What the training-data operators share: tables, scratch space, and word spans of Arrow text columns.

Word spans are found on UTF-8 bytes with numpy, never per character in Python.
Texts of one Arrow batch lie behind each other in one buffer, so a whole block
of documents is scanned at once.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy block holds at most (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20

#: White space of the contracts: space and the controls 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
#: Byte map that lower-cases A-Z and leaves everything else alone.
LOWER = _UPPER

#: Bytes of words that white space bounds.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters and digits: 0-9, a-z (after lower-casing) and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one Arrow batch, where the session doesn't say.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, wherever the driver's Python was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    # bounded memory whatever the texts' lengths: Arrow batches of so many bytes, and freed memory goes back to the system
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine without it (tests) gets a folder of its own; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    got = spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; the files go when its scope ends, or else the driver's Python."""
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    _own(spark, path)
    return path


def _own(spark: SparkSession, path: str) -> None:
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(remove_path, spark, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written inside are removed at the end, but for those added to the list that it gives."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        keep = {df._scratch for df in kept}
        for path in _scopes.pop():
            if path in keep:
                _own(spark, path)
            else:
                remove_path(spark, path)


def free(*frames: DataFrame) -> None:
    """Remove the files of stashed tables that nothing reads any more."""
    for df in frames:
        remove_path(df.sparkSession, df._scratch)


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone: its shared folder is then its owner's to clear
        pass


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def stash(df: DataFrame, tag: str = "cut") -> DataFrame:
    """df, computed once and written as a Parquet table to the shared folder, and read again: its lineage ends there, lost executors
    cost nothing, and Spark's estimate of its size is that of the files (a checkpoint keeps the plan's, which joins multiply)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


cut = stash


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's columns; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")), F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*parts))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (an invertible scramble)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept by the worker."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


class Block:
    """Texts of consecutive rows and their words: bytes (A-Z lower-cased), word spans, and the words of each text.

    first[i] and first[i + 1] bound the words of text i; a null text has none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.low = LOWER[data]
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = is_word[self.low]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here[:n] & (~before[:n] | edge[:n]))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        out, a = np.empty(len(self.start), dtype=np.uint64), 0
        while a < len(out):  # a long text is hashed in runs of words, so that sums of eight bytes a byte stay small
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + 2 * BLOCK_BYTES, side="right")))
            low = self.low[self.start[a] : self.end[b - 1]]
            start, end = self.start[a:b] - self.start[a], self.end[a:b] - self.start[a]
            sums = np.zeros(len(low) + 1, dtype=np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _pow(_BASE, len(low)), out=sums[1:])
            out[a:b] = mix((sums[end] - sums[start]) * _pow(_INVERSE, len(low))[start] + (end - start).astype(np.uint64) * _M1)
            a = b
        return out

    def words(self, i: int) -> list[bytes]:
        low = self.low.tobytes() if len(self) == 1 else None
        a, b = self.first[i], self.first[i + 1]
        if low is None:
            at = int(self.offsets[i])
            low = self.low[at : self.offsets[i + 1]].tobytes()
            return [low[s - at : e - at] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]
        return [low[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, at each place where k are left."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= _M1
        out += h[j : j + n]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null text is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, dtype=np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, dtype=np.uint8)
    return d, o - o[0]


def blocks(column: pa.Array, is_word: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, last row + 1, Block) for runs of rows of `most` bytes at most."""
    data, offsets = text_buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], is_word)
        a = b
