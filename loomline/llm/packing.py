"""Cost-balanced packing of documents into token sequences of fixed capacity.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention within the piece).
Pieces are placed in descending cost, each into the lowest-cost sequence that can hold it
whole; a piece that no sequence can hold is cut at the room of the lowest-cost open one.

Nothing is shuffled: each task packs the documents of its own partition as they stream by,
a window of about ``window`` sequences at a time. A window fills all its sequences; what is
left over opens the next window, so only a partition's last sequence is padded. Every
sequence lies in one task, so a task that is run again gives a whole result again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomline.llm.common import map_arrow
from loomline.llm.tokens import Encoder, default_path, encoder
from loomline.session import spread

CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


def place(lengths: list[int], capacity: int, last: bool, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pack documents of these lengths. Gives (document, start, length, sequence, offset) rows and what is left over.

    Left over are (document, start, length) rows of under ``capacity`` tokens together; none if ``last``.
    Of sequences of equal cost the first is taken, of documents of equal cost too.
    """
    total = sum(lengths)
    n = -(-total // capacity) if last else total // capacity
    room, costs = np.full(n, capacity), np.zeros(n)
    pieces = [(-x, d, 0) for d, x in enumerate(lengths) if x]
    heapq.heapify(pieces)  # equal cost order and length order: cost grows with length
    rows, open_ = [], n
    while pieces and open_:
        size, doc, start = heapq.heappop(pieces)
        size = -size
        holds = np.where(room >= size, costs, np.inf)
        seq = int(holds.argmin())
        if holds[seq] == np.inf:
            seq = int(np.where(room > 0, costs, np.inf).argmin())
        free = int(room[seq])
        take = min(size, free)
        rows.append((doc, start, take, seq, capacity - free))
        room[seq] = free - take
        costs[seq] += cost(take, linear, quadratic)
        open_ -= take == free
        if take < size:
            heapq.heappush(pieces, (take - size, doc, start + take))
    return rows, [(doc, start, -size) for size, doc, start in sorted(pieces)]


def _packed(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int, window: int, linear: float, quadratic: float, keep_cache: bool) -> Iterator[pa.RecordBatch]:
    with encoder(path, keep_cache) as ids:
        yield from _sequences(batches, ids, end_id.to_bytes(4, "little"), capacity, window, linear, quadratic)


def _sequences(batches: Iterable[pa.RecordBatch], ids: Encoder, end: bytes, capacity: int, window: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    made = 0
    open_: list[tuple[object, int, int, bytes]] = []  # doc_id, its tokens, first token here, ids from there on
    held = 0
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    def flush(last: bool) -> list[tuple]:
        nonlocal made, open_, held
        placed, left = place([len(d[3]) // 4 for d in open_], capacity, last, linear, quadratic)
        rows = []
        for d, start, n, seq, offset in placed:
            doc_id, tokens, first, raw = open_[d]
            rows.append((doc_id, first + start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), tokens, base + made + seq, offset))
        made += 1 + max((r[3] for r in placed), default=-1)
        open_ = [(open_[d][0], open_[d][1], open_[d][2] + s, open_[d][3][4 * s : 4 * (s + n)]) for d, s, n in left]
        held = sum(n for _, _, n in left)
        return rows

    for batch in batches:
        full: list[tuple] = []
        for doc_id, raw in zip(batch["doc_id"].to_pylist(), ids.encode_all(batch["text"])):
            raw += end
            tokens, at = len(raw) // 4, 0
            while tokens - at >= capacity:  # whole sequences of its own
                full.append((doc_id, at, capacity, zlib.crc32(raw[4 * at : 4 * (at + capacity)]), tokens, base + made, 0))
                made, at = made + 1, at + capacity
            if at < tokens:
                open_.append((doc_id, tokens, at, raw[4 * at :]))
                held += tokens - at
            if held >= window * capacity:
                full += flush(False)
        if full:
            yield out(full)
    if open_ and (rows := flush(True)):
        yield out(rows)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, window: int = 512, linear: float = 1.0, quadratic: float = 1 / 1024, keep_cache: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text is the
    end id alone, so every row of ``docs`` has at least one piece; rows that repeat a doc_id
    are packed each. Memory is bounded by one window of ids and one text. An empty table
    gives no rows. sequence_id is unique over the result, not consecutive. ``keep_cache``
    leaves the encoder's cache in the workers: faster, but memory that later stages lack.
    """
    path = path or default_path()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(src, lambda b: _packed(b, path, end_id, capacity, window, linear, quadratic, keep_cache), SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
