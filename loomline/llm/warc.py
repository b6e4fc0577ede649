"""Deterministic sharded WARC writer and reader.

Equal payloads of at least ``least`` bytes: the record with the largest page_id is the
response, the others are revisits that name it. Records are sorted by page_id in range
shards; a shard rolls to its next file once the compressed size passes ``roll_bytes``. Every
record is a gzip member of its own with regenerated headers and digests. A file is written
under a temporary name, renamed when whole, and counts only once the manifest names it.
Record ids and dates derive from content, so the same input gives the same bytes.

Payloads are shuffled once. What decides about revisits (page_id, digest, winner) travels
apart from them and meets them in the same range shuffle as small rows that sort first.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomline.llm.common import NewFile, file_system, map_arrow, text_bytes
from loomline.operators.joins import join_hot
from loomline.session import materialise, scratch_path

LEAST = 1000
ROLL_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"  # regenerated headers carry no wall clock
LEVEL = 5


def _uuid(*parts: object) -> str:
    h = hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _one_line(url: str | None) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = ("response", head + payload) if refers_to is None else ("revisit", head)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uuid(kind, page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}", *([] if page_id is None else [f"X-Page-ID: {page_id}"]), f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uuid('response', refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without name or time
    return packer.compress(raw) + packer.flush()


class _File:
    def __init__(self, folder: str, shard: int, number: int):
        self.name = f"pages-{shard:06d}-{number:04d}.warc.gz"
        self.uri, self.number, self.size, self.n, self.first, self.last = f"{folder}/{self.name}", number, 0, 0, None, None
        self.out, self.sha = NewFile(self.uri), hashlib.sha256()
        info = f"software: loomline\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\nfile: {number}\r\n".encode()
        lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_uuid('warcinfo', shard, number)}", f"WARC-Date: {DATE}", f"WARC-Filename: {self.name}", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}"]
        self._put(("\r\n".join(lines) + "\r\n\r\n").encode() + info + b"\r\n\r\n")

    def _put(self, raw: bytes) -> None:
        packed = _member(raw)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self._put(raw)
        self.first, self.last, self.n = page_id if self.first is None else self.first, self.last if page_id is None else page_id, self.n + 1

    def close(self) -> tuple:
        self.out.commit()
        return (self.uri, self.size, self.n, self.first, self.last, self.sha.hexdigest())


_MANIFEST = "path string, bytes long, records long, first_page long, last_page long, sha256 string"


def _written(batches: Iterable[pa.RecordBatch], folder: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    shard, file, number = TaskContext.get().partitionId(), None, 0
    page, winners, done = None, {}, []
    try:
        for batch in batches:
            for page_id, is_page, url, payload, digest, winner in zip(*(batch[c].to_pylist() for c in ("page_id", "is_page", "url", "payload", "digest", "winner"))):
                if page_id != page:
                    page, winners = page_id, {}
                if not is_page:  # (winner, how many of this page's rows with this digest are responses)
                    winners[digest] = winner
                    continue
                refers_to = winners.get(digest)
                if refers_to is None and digest in winners:
                    winners[digest] = page_id  # the first of equal rows of the winning page is the response
                if file and file.size >= roll_bytes:
                    done.append(file.close())
                    file = None
                if not file:
                    file, number = _File(folder, shard, number), number + 1
                file.add(page_id, record(page_id, url, payload, digest, refers_to))
        if file:
            done.append(file.close())
    except BaseException:
        if file:
            file.out.discard()
        raise
    if done:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], [c.split()[0] for c in _MANIFEST.split(", ")])


def write_warc(pages: DataFrame, folder: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; gives the manifest, one row per file.

    A null html is an empty payload, a null url an empty target. Rows that repeat a page_id are
    records each; of equal rows of the winning page the first is the response and the others
    revisit it. A row with a null page_id is a response after all others, without an X-Page-ID: no
    record can name it, and it revisits none. An empty table writes nothing.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    src = src.withColumn("digest", F.sha1("payload"))
    large = materialise(src.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "warc-digests")
    winners = materialise(large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("c")).where("c > 1"), "warc-winners")
    decided = join_hot(large, winners, "digest", "c", "inner")
    # The winner's own row carries no winner; it stays, as its digest marks repeated rows of that page.
    notes = decided.distinct().select("page_id", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.when(F.col("winner") != F.col("page_id"), F.col("winner")).alias("winner"))
    rows = src.select("page_id", F.lit(True).alias("is_page"), "url", "payload", "digest", F.lit(None).cast("long").alias("winner"))
    rows = rows.unionByName(materialise(notes, "warc-notes"))
    page = F.col("page_id").asc_nulls_last()
    ranges = [page, F.when(F.col("page_id").isNull(), F.xxhash64("digest", "url"))]  # rows of one page stay together, those of none need not
    rows = rows.repartitionByRange(shards, *ranges) if shards else rows.repartitionByRange(*ranges)
    rows = rows.sortWithinPartitions(page, "is_page", "digest", "url")
    return materialise(map_arrow(rows, lambda b: _written(b, folder, roll_bytes), _MANIFEST), "warc-manifest")


def parse(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open, uncompressed stream."""
    while True:
        line = raw.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := raw.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        block = raw.read(int(head["content-length"]))
        if raw.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch["path"].to_pylist():
            fs, path = file_system(uri)
            rows = []
            with fs.open_input_stream(path, compression=None) as packed, gzip.open(packed) as raw:
                for head, block in parse(raw):
                    if head["warc-type"] == "warcinfo":
                        continue
                    if hashlib.sha1(block).digest() != base64.b32decode(head["warc-block-digest"][5:]):
                        raise ValueError(f"{uri}: a block does not match its digest")
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32decode(head["warc-payload-digest"][5:]).hex()
                    size, refers_to = int(head["x-payload-length"]), head.get("x-refers-to-page-id")
                    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{uri}: a payload does not match its digest")
                    rows.append((int(head["x-page-id"]) if "x-page-id" in head else None, head["warc-target-uri"] if "warc-target-uri" in head else "", size, digest, head["warc-type"], None if refers_to is None else int(refers_to)))
                    if len(rows) >= 5000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _READ.split(", ")])


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, checked against the files' own digests."""
    spark = manifest.sparkSession
    files = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return map_arrow(files, _read, _READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_warc(write_warc(pages, scratch_path(spark, "warc")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> last THEN last END AS refers_to
FROM d"""
