"""Shared helpers: scratch tables in the cluster's shared folder, byte texts, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used in local mode (tests); on a cluster that is an
    error, as executors don't see each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(scratch_root, "local", None)
    if own is None:
        own = scratch_root.local = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes ``df`` under the scratch folder and rereads it: lineage ends here, and a lost
    executor costs no recomputation of what came before. Returns the table and its path."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table on whatever file system it lies."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder (set up first where tests have none)."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def parallel(spark: SparkSession) -> int:
    """Shuffle partitions of the session: set by whoever sized the cluster for the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(text: str | Column = "text") -> Column:
    """A text column as UTF-8 bytes; null is empty. Python workers then need not decode it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b""))


def doc_hash(text: str | Column = "text") -> Column:
    """With ``doc_id`` this names a document, so that repeated ids with other texts stay apart."""
    return F.xxhash64(text)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in whatever letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def offsets_of(col: pa.Array) -> np.ndarray:
    """Where the values of a binary column begin and end in its buffer."""
    return np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]


def raw_bytes(col: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, one value after another, without a copy."""
    at = offsets_of(col)
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)


def record_batch(schema: pa.Schema, values: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def slices(batches: Iterable[pa.RecordBatch], name: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the binary column ``name`` holds about ``max_bytes`` in each
    (a longer single text gets a batch of its own): bounds a worker's memory for long texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        if col.nbytes <= max_bytes:
            yield batch
            continue
        at = offsets_of(col)
        ends = at[1:].astype(np.int64) - at[0]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


_CACHES: list[dict] = []


def claim(cache: dict) -> None:
    """Empties the caches of all other operators: workers are used again by the next stages, and
    several full caches at once would take too much of an executor's memory."""
    if not _CACHES:
        with contextlib.suppress(OSError, AttributeError):  # large arrays go back to the system when they are freed
            ctypes.CDLL(None).mallopt(-3, 1 << 20)
    if not any(c is cache for c in _CACHES):
        _CACHES.append(cache)
    for c in _CACHES:
        if c is not cache:
            c.clear()


def trim() -> None:
    """Gives memory that isn't used back to the system: a worker that waits for its next task would
    keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only in some C libraries
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for a bounded number of distinct words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Those of a worker, whatever it runs.
WORD_HASHES = WordHashes()

#: Odd multiplier of the polynomial hash over word hashes, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser, so that all bits of a polynomial hash depend on all of its words."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive entries of ``h`` (uint64), in O(len(h) * log k): windows of
    powers of two are combined, so that no inverse or prefix of the whole array is needed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = None, 0
    level, width, mult = h, 1, int(BASE)
    left = k
    while left:
        if left & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else out * np.uint64(mult) + part
            done += width
        left >>= 1
        if left:
            level = level[: len(level) - width] * np.uint64(mult) + level[width:]
            width *= 2
            mult = mult * mult % (1 << 64)
    return mix(out)
