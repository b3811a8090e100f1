"""Shared plumbing of the training-data operators: scratch tables, column hygiene and vectorised text scanning.

Text scanning works on the UTF-8 bytes that Arrow already holds: a 256-entry table says which bytes belong to a word, runs
of such bytes are words, and sums of random numbers by byte and place give a 64-bit hash of every word without Python strings.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shingle length and similarity of near-duplicate operators, unless a contract says otherwise.
SHINGLE, SIMILARITY = 5, 0.8
#: Sides with at most so many rows (narrow rows, under 64 bytes each) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 50_000
#: Bytes of text that are scanned at once; a longer text is scanned by itself, its bytes hashed BLOCK at a time.
CHUNK = BLOCK = 1 << 18

_scratch: dict[str, list[str]] = {}
_scope = ["session"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset, and then only in local mode (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaver-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables made within belong to name, and go with release(spark, name)."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by release() or at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_at_exit)
    _scratch.setdefault(_scope[-1], []).append(path)
    return path


def release(spark: SparkSession, name: str) -> None:
    """Removes the scratch tables of a scope. Only for callers whose results of that scope are written out."""
    for path in _scratch.pop(name, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            for name in list(_scratch):
                release(spark, name)
        except Exception as e:  # the JVM may be gone already; the folder is temporary anyway
            print(f"scratch tables stay: {type(e).__name__}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df to broadcast if its counted rows are within limit; otherwise as it is, to be joined by a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def text_column(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


# ---------------------------------------------------------------- words in bytes

WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits of ASCII (after lower-casing) and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: Random numbers of a byte at a place of a word, for the first PLACES places.
PLACES = 64
_AT = mix(np.arange(PLACES * 256, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(1))


class Words:
    """The words of a chunk of documents: start and end in buf, hash, and first[i]:first[i + 1] are those of document i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool, hashes: bool = True):
        self.buf = buf = LOWER[buf] if lower else buf
        n = len(buf)
        flag = np.zeros(n + 2, bool)
        flag[1:-1] = is_word[buf]
        inner = flag[1:]  # inner[i]: byte i is in a word; inner[n] is False
        start = inner & ~flag[:-1]
        begins = offsets[:-1][offsets[:-1] < n]
        start[begins] = inner[begins]  # a word never goes over from one text to the next
        self.start = np.flatnonzero(start)
        stop = flag[:-1] & ~inner
        stop[begins] = flag[:-1][begins]
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        """The sum over a word of a random number for each byte at its place, mixed: no algebra of bytes makes words collide. In
        runs of words of about BLOCK bytes, so that what is held besides the hashes does not grow with a text."""
        out = np.empty(len(self.start), np.uint64)
        i, m = 0, len(self.start)
        while i < m:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK, "right")))
            size = self.end[i:j] - self.start[i:j]
            if j == i + 1 and size[0] > BLOCK:
                out[i] = self._long(int(self.start[i]), int(self.end[i]))
                i = j
                continue
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
            byte = self.buf[place + np.repeat(self.start[i:j], size)]
            at = (np.minimum(place, PLACES - 1) << 8) + byte
            value = _AT[at]
            far = np.flatnonzero(place >= PLACES)
            if len(far):
                value[far] = _far(byte[far], place[far])
            out[i:j] = np.add.reduceat(value, first)
            i = j
        return mix(out)

    def _long(self, a: int, b: int) -> np.uint64:
        total = np.zeros(1, np.uint64)
        for lo in range(a, b, BLOCK):
            byte = self.buf[lo : min(b, lo + BLOCK)]
            place = np.arange(lo - a, lo - a + len(byte), dtype=np.int64)
            near = place < PLACES
            total += np.where(near, _AT[(np.minimum(place, PLACES - 1) << 8) + byte], _far(byte, place)).sum(dtype=np.uint64)
        return total[0]


def _far(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(((place.astype(np.uint64) << np.uint64(8)) + byte) * np.uint64(_BASE) + np.uint64(1))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(offsets) else buf[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about most bytes in that string column, so that Python objects are made for few texts at once."""
    offsets = string_buffers(batch.column(column))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def chunks(buf: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, bytes, offsets) of runs of documents of about most bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SALT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all n-word shingles of one document in order; a shorter text is one shingle, an empty one has none."""
    if len(words) == 0:
        return words[:0]
    if len(words) < n:
        return mix(np.array([np.sum(words * _SALT[n : n + len(words)], dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    m = len(words) - n + 1
    h = words[:m] * _SALT[0]
    for k in range(1, n):
        h = h + words[k : m + k] * _SALT[k]
    return mix(h)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
