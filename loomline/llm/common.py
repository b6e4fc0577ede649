"""What the training-data operators share: Arrow mapping and word hashing.

Words ``[^\\x20\\x09-\\x0D]+`` of a text are what bytes.split() without arguments gives, and
bytes.lower() lower-cases exactly A-Z.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

HOME = str(Path(__file__).resolve().parents[2])
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000


def map_arrow(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    env = df.sparkSession.sparkContext.environment  # workers must find this package, wherever the driver was started
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """An ended task's memory goes back to the system, so an idle worker holds none that other stages need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's or file's URI; Spark's names for object stores are known too."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


class NewFile:
    """A file written under a temporary name and renamed when whole; a failed attempt leaves nothing behind.

    The temporary name holds the task attempt, so an attempt never writes into another's file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        task = TaskContext.get()
        self.part = f"{self.path}.{task.taskAttemptId() if task else 0}.tmp"
        self.out = self.fs.open_output_stream(self.part)

    def write(self, raw: bytes) -> None:
        self.out.write(raw)

    def commit(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.part, self.path)
        except OSError:  # some file systems don't replace: what an earlier attempt wrote has the same content
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.part)

    def discard(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty: no decoding on the way to Python."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column is called so (names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything beyond ``most`` words to bound memory."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift-multiply rounds), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; fewer words make one shingle, none an empty set."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = max(1, n - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(min(n, k)))
        for i in range(min(n, k)):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m])
    return np.unique(h)

