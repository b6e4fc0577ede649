"""Rows without a key are written and read back like the others."""

import zlib

from loomline.llm import tokenstore, warc
from tests.llm.test_llm import ids_of


def test_token_shards_keep_null_ids(spark, tmp_path):
    rows = [(None, "no id"), (2**63 - 1, "last"), (None, None), (-5, "first"), (None, "no id"), (3, None)]
    rows += [(None, f"text {i}") for i in range(40)]
    m = tokenstore.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s", shards=3)
    got = sorted(map(tuple, tokenstore.read_shards(m).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-5, 3, 2**63 - 1] + [None] * 43
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert sorted((str(k), zlib.crc32(ids_of(t, 2))) for k, t in rows) == sorted((str(r[0]), r[3]) for r in got)
    shards = [tokenstore.Shard(r["path"]) for r in m.collect()]
    assert sum(len(s.get(None)) for s in shards) == 43 and [x for s in shards for x in s.get(2**63 - 1)] == [ids_of("last", 2)]
    alone = tokenstore.write_shards(spark.createDataFrame([(None, "x")], "doc_id long, text string"), f"file://{tmp_path}/a")
    assert [r["doc_id"] for r in tokenstore.read_shards(alone).collect()] == [None]


def test_null_keys_over_several_blocks(tmp_path):
    w = tokenstore.ShardWriter(f"file://{tmp_path}/x.sst", block_bytes=16)
    entries = [(1, b"\1\0\0\0"), (2**63 - 1, b"\2\0\0\0")] + [(None, bytes([i, 0, 0, 0])) for i in range(9)]
    for k, raw in entries:
        w.add(k, raw)
    w.close()
    s = tokenstore.Shard(f"file://{tmp_path}/x.sst")
    assert list(s) == entries and s.get(None) == [raw for k, raw in entries if k is None] and s.get(2**63 - 1) == [b"\2\0\0\0"] and s.get(1) == [b"\1\0\0\0"]


def test_warc_keeps_null_pages(spark, tmp_path):
    big = "x" * 2000
    pages = [(None, "u", big), (1, "a", big), (None, "v", big), (4, "b", big), (None, None, None), (2, "c", "s")]
    schema = "page_id long, url string, html string"
    m = warc.write_warc(spark.createDataFrame(pages, schema), f"file://{tmp_path}/w", shards=2)
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(m).collect()), key=str)
    want = [(None, "u", 2000, "response", None), (1, "a", 2000, "revisit", 4), (None, "v", 2000, "response", None), (4, "b", 2000, "response", None), (None, "", 0, "response", None), (2, "c", 1, "response", None)]
    assert got == sorted(want, key=str)
    alone = warc.write_warc(spark.createDataFrame([(None, "u", big)], schema), f"file://{tmp_path}/n").collect()
    assert [(r["records"], r["first_page"], r["last_page"]) for r in alone] == [(1, None, None)]
