"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive item words (an item of fewer words is one window).
Symbols are words and a block is two of them. For the patterns of one length m the shift
table says, for the block under the cursor, how far the search may move without passing an
occurrence: m for a last word in no pattern, m - 1 for a block in no pattern, less for one that
ends j words before a pattern's end, nothing for a pattern's last block. There the bucket of
that suffix block, divided by the hash of the words before it, gives the windows that are
compared directly with the text. Patterns of one word are looked up by word.

The benchmark is read in blocks whose tables take bounded memory; each block's tables are
broadcast as arrays and all documents pass them without a shuffle. With several blocks each pass
reads the texts and writes only what it hit, and the hits of a document are put together after the last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.llm.common import map_arrow, text_bytes
from loomline.session import materialise, spread

WINDOW = 13
#: A worker's memory for one block's tables, and what a benchmark word takes of it at most (measured: 60 to 260).
TABLE_BYTES = 160 << 20
WORD_BYTES = 300
_PRIME = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: every other ASCII byte becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


class Patterns:
    """Shift tables and suffix buckets, one pair for each pattern length, over numbered words.

    Pickled it is arrays of 8 to 30 bytes a benchmark word; the shift tables' dictionaries are built where it is unpickled.
    """

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.items: list[str | None] = []
        vocabulary: dict[bytes, int] = {}
        texts = []
        for item, raw in items:
            self.items.append(item)
            texts.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words_of(raw)], np.int32))
        sizes = np.array([len(x) for x in texts], np.int64)
        self.vocabulary, self.flat = list(vocabulary), np.concatenate([np.empty(0, np.int32), *texts])
        self.first = np.cumsum(sizes) - sizes
        lengths = np.minimum(sizes, window)
        self.tables = {int(m): self._table(int(m), np.flatnonzero(lengths == m), sizes) for m in np.unique(lengths) if m}
        self._index()

    def _table(self, m: int, own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(blocks, their shifts, bucket keys of distinct windows, their places, owners, where each window's owners start)."""
        place = np.concatenate([np.arange(self.first[i], self.first[i] + sizes[i] - m + 1) for i in own])
        owner = np.repeat(own, sizes[own] - m + 1).astype(np.int32)
        blocks, shifts = np.empty(0, np.int64), np.empty(0, np.int16)
        if m > 1:
            # The block at words q, q + 1 of an item ends a window, or as many words before the end as the item's start forces.
            q = np.concatenate([np.arange(sizes[i] - 1) for i in own])
            at = np.concatenate([self.first[i] + np.arange(sizes[i] - 1) for i in own])
            blocks, shifts = self._pairs(at), (m - 1 - np.minimum(m - 1, q + 1)).astype(np.int16)
            order = np.lexsort((shifts, blocks))
            new = np.diff(blocks[order], prepend=-1) != 0
            blocks, shifts = blocks[order][new], shifts[order][new]
        keys = np.zeros(len(place), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(m):  # the hash of the prefix, and the suffix block in it last
                keys = keys * np.uint64(_PRIME) + self.flat[place + j].astype(np.uint64) + np.uint64(1)
        order = np.lexsort((place, keys))
        keys, place, owner = keys[order], place[order], owner[order]
        equal = np.ones(len(place), bool)
        for j in range(m):
            equal[1:] &= self.flat[place[1:] + j] == self.flat[place[:-1] + j]
        starts = np.flatnonzero(~equal | (np.arange(len(place)) == 0))
        return blocks, shifts, keys[starts], place[starts], owner, np.append(starts, len(place))

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        return self.flat[at].astype(np.int64) * len(self.vocabulary) + self.flat[at + 1]

    def _index(self) -> None:
        self.number = {x: i for i, x in enumerate(self.vocabulary)}
        self.shift = {m: dict(zip(t[0].tolist(), t[1].tolist())) for m, t in self.tables.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "shift")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._index()

    def _occurs(self, m: int, ids: list[int]) -> np.ndarray | None:
        """Items with the window ``ids``; None if there is none."""
        _, _, keys, place, owner, starts = self.tables[m]
        key = 0
        for x in ids:
            key = (key * _PRIME + x + 1) & _ALL
        at = int(np.searchsorted(keys, np.uint64(key)))
        while at < len(keys) and int(keys[at]) == key:
            if self.flat[place[at] : place[at] + m].tolist() == ids:
                return owner[starts[at] : starts[at + 1]]
            at += 1
        return None

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals (start, end) of all occurrences, and the items whose windows occur."""
        spans, items = [], set()
        if not self.tables:
            return spans, items
        ids, n, words = list(map(self.number.get, w)), len(w), len(self.vocabulary)
        seen: set[tuple] = set()  # a window that a text repeats names its items once
        for m, shift in self.shift.items():
            i, far = m - 1, m - 1
            while i < n:
                last = ids[i]
                if last is None:
                    i += m
                    continue
                if m > 1:
                    before = ids[i - 1]
                    step = far if before is None else shift.get(before * words + last, far)
                    if step:
                        i += step
                        continue
                window = ids[i - far : i + 1]
                owners = None if None in window else self._occurs(m, window)
                if owners is not None:
                    spans.append((i - far, i + 1))
                    if tuple(window) not in seen:
                        seen.add(tuple(window))
                        items.update(owners.tolist())
                i += 1
        return spans, items


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_HITS = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _searched(batches: Iterable[pa.RecordBatch], patterns, hits_only: bool) -> Iterator[pa.RecordBatch]:
    table = patterns.value
    for batch in batches:
        n, spans, items, keep = [], [], [], []
        for row, raw in enumerate(batch["_text"]):
            w = words_of(raw.as_py())
            found, who = table.find(w)
            if hits_only and not found:
                continue
            keep.append(row)
            n.append(len(w))
            spans.append([{"a": a, "b": b} for a, b in _merge(found)])
            items.append(sorted({table.items[i] for i in who} - {None}))
        key = batch.column(0).take(pa.array(keep, pa.int64())) if hits_only else batch.column(0)
        yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [batch.schema.names[0], "n_words", "spans", "items"])


def _blocks(benchmark: DataFrame, window: int, table_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks whose tables take about ``table_bytes``; the driver holds one at a time.

    An item of more words than a block takes comes in pieces that share window - 1 words, so no window is lost.
    """
    most = max(window, table_bytes // WORD_BYTES)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text")).groupBy("item_id", "text").agg(F.lit(1))
    block, size = [], 0
    for r in rows.toLocalIterator():
        w = words_of(bytes(r["text"]))
        for at in range(0, max(1, len(w) - window + 1), most):
            piece = w[at : at + most + window - 1]
            block.append((r["item_id"], b" ".join(piece)))
            size += len(piece) + 1
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` (its columns untouched) with n_words, n_hit, items (ids, sorted as strings), n_items and contaminated.

    A null or empty text has no words and is clean, as is every text when the benchmark is
    empty. Rows with a null item id hit like others, but name no item; rows that repeat an item_id with other texts are windows
    of one item. Repeated rows of ``docs`` are searched each; an empty table gives no rows. Columns of ``docs`` with the names
    added here are replaced; all others stay, whatever their names.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*own).alias("_row"), text_bytes().alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    share = lambda block: spark.sparkContext.broadcast(Patterns(block, window))
    blocks = _blocks(benchmark, window, table_bytes)
    one, two = next(blocks, []), next(blocks, None)
    if two is None:
        found = map_arrow(rows, lambda b, t=share(one): _searched(b, t, False), f"_row {kind}, {_HITS}")
    else:
        rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "decontamination")
        texts, hits = rows.select("_id", "_text"), None
        for i, block in enumerate(chain([one, two], blocks)):
            tables = share(block)
            part = materialise(map_arrow(texts, lambda b, t=tables, later=i > 0: _searched(b, t, later), f"_id long, {_HITS}"), "decontamination-hits")
            hits = part if hits is None else hits.unionByName(part)
            tables.destroy()
        together = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731 - a document's own hits
        hits = hits.groupBy("_id").agg(F.max("n_words").alias("n_words"), together("spans"), together("items"))
        found = rows.select("_id", "_row").join(hits, "_id")
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(s["b"], acc["end"]).alias("end"))
    hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), add, lambda acc: acc["n"])
    out = found.select("_row", "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    return out.select("_row.*", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


ADDED = ("n_words", "n_hit", "items", "n_items", "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``, whatever their names.

    Rows with a null or empty text stay; equal rows stay or go together; an empty table, or benchmark, takes nothing away.
    """
    marked = contamination(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), benchmark)
    return marked.where(~F.col("contaminated")).select("_doc.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = contamination(spread(read("documents").select("doc_id", "text")), read("benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p))),
o AS (SELECT g.r, g.i, g.m, p.item_id FROM g JOIN p ON g.k = p.k AND g.m = p.m),
h AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, m)) AS j FROM o) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM o GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
