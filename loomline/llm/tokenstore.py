"""Sorted-string-table shards of token ids.

File layout, all numbers little-endian or LEB128 varints:

* blocks of about ``block_bytes``, each Zstandard-compressed: entries in key order, each
  ``shared, unshared, n_ids`` (varints), the unshared key bytes and the ids, 2 bytes each if the
  vocabulary fits, else 4. A key is the doc_id as a big-endian 64-bit number with its sign bit
  flipped, so byte order is number order; a null doc_id is nine bytes 0xff, after every number.
  ``shared`` bytes are taken from the key before. The first key of a block is written whole.
* sparse index: per block its first key (its first 8 bytes), offset, stored size and plain size (u64 each).
* Bloom filter over the keys: 10 bits a key, 7 probes of one 128-bit hash.
* footer: offsets and sizes of index and filter, counts, first and last key, a magic number.

A shard is written under a temporary name and renamed, and counts only once the manifest
names it; a task that is run again replaces its own file by an equal one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loomline.llm.common import NewFile, file_system, map_arrow
from loomline.llm.tokens import default_path, encoder
from loomline.session import materialise, scratch_path

MAGIC = b"LLSST002"
FOOTER = struct.Struct("<QQQQQQQ8s8s8s")
INDEX = struct.Struct("<8sQQQ")
BITS, PROBES = 10, 7


NULL_KEY = b"\xff" * 9


def key_bytes(doc_id: int | None) -> bytes:
    return NULL_KEY if doc_id is None else ((doc_id + (1 << 63)) % (1 << 64)).to_bytes(8, "big")


def key_number(key: bytes) -> int | None:
    return None if key == NULL_KEY else int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % 2**64 % bits for i in range(PROBES)]


class ShardWriter:
    def __init__(self, path: str, block_bytes: int = 256 << 10, width: int = 4):
        self.out = NewFile(path)
        self.block_bytes, self.block, self.index, self.keys = block_bytes, bytearray(), [], []
        self.codec, self.width = pa.Codec("zstd", compression_level=1), width
        self.before = self.first = b""
        self.at = self.n = self.ids = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        key = key_bytes(doc_id)
        if key < self.before:
            raise ValueError("keys must ascend")
        if len(self.block) >= self.block_bytes:
            self._end_block()
        if not self.block:
            self.first, self.before = key, b""
        shared = 0
        while shared < len(self.before) and self.before[shared] == key[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(raw) // 4) + key[shared:]
        self.block += raw if self.width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()
        self.keys.append(key)
        self.before, self.n, self.ids = key, self.n + 1, self.ids + len(raw) // 4

    def _end_block(self) -> None:
        stored = self.codec.compress(bytes(self.block), asbytes=True)
        self.out.write(stored)
        self.index.append(INDEX.pack(self.first, self.at, len(stored), len(self.block)))
        self.at += len(stored)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._end_block()
        index, bits = b"".join(self.index), max(64, BITS * self.n)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        edge = (self.keys[0], self.keys[-1]) if self.keys else (b"\0" * 8,) * 2
        self.out.write(index + bloom.tobytes() + FOOTER.pack(self.at, len(index), len(bloom), bits, self.n, self.ids, self.width, *edge, MAGIC))
        self.out.commit()


class Shard:
    """Reads a shard: whole, block by block, or one key by filter, binary search and one block."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        start, self.index_size, self.bloom_size, self.bits, self.n, self.ids, self.width, self.low, self.high, magic = foot
        if magic != MAGIC or size != start + self.index_size + self.bloom_size + FOOTER.size:
            raise ValueError(f"{path} is not a whole shard")
        self.index = [INDEX.unpack(x) for x in _chunks(self.file.read_at(self.index_size, start), INDEX.size)]
        self.bloom = self.file.read_at(self.bloom_size, start + self.index_size)

    def _entries(self, block: tuple) -> Iterator[tuple[int | None, bytes]]:
        raw = pa.Codec("zstd").decompress(self.file.read_at(block[2], block[1]), block[3], asbytes=True)
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            ids = raw[at : at + self.width * n]
            yield key_number(key), ids if self.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            at += self.width * n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for block in self.index:
            yield from self._entries(block)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids stored under a key, once for each of its documents; those of documents without an id under None."""
        key = key_bytes(doc_id)
        if not self.n or any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        low, high, key = 0, len(self.index), key[:8]
        while low < high:  # first block that starts at the key or after it
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found, at = [], max(0, low - 1)
        while at < len(self.index) and self.index[at][0] <= key:
            found += [raw for k, raw in self._entries(self.index[at]) if k == doc_id]
            at += 1
        return found


def _chunks(raw: bytes, n: int) -> Iterator[bytes]:
    return (raw[i : i + n] for i in range(0, len(raw), n))


def _written(batches: Iterable[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    end, part, writer = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), None
    try:
        with encoder(path) as ids:
            for batch in batches:
                for doc_id, raw in zip(batch["doc_id"].to_pylist(), ids.encode_all(batch["text"])):
                    writer = writer or ShardWriter(f"{folder}/shard-{part:06d}.sst", width=2 if max(ids.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
                    writer.add(doc_id, raw + end)
        if writer:
            writer.close()
    except BaseException:
        if writer:
            writer.out.discard()
        raise
    if writer:
        yield pa.RecordBatch.from_pydict({"shard": [part], "path": [f"{folder}/shard-{part:06d}.sst"], "n_docs": [writer.n], "n_ids": [writer.ids]})


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; gives the manifest (shard, path, n_docs, n_ids).

    Texts travel once, in the range shuffle. Rows that share a doc_id lie next to each other,
    in the order of their text's hash. Rows with a null doc_id come after all others and are read
    back with a null id. A null text is empty. An empty table gives an empty manifest.
    """
    path = path or default_path()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = src.repartitionByRange(shards, *keys) if shards else src.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys)
    done = map_arrow(ranged, lambda b: _written(b, folder, path, end_id), "shard long, path string, n_docs long, n_ids long")
    return materialise(done, "manifest")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
            rows: list[tuple] = []
            for doc_id, raw in Shard(path):
                rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
                start += len(raw) // 4
                if len(rows) >= 10_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files a manifest names.

    The running total is taken over the manifest, which has one row per shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spark = manifest.sparkSession
    rows = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    rows = rows.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return map_arrow(rows, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, scratch_path(spark, "token-shards")))
