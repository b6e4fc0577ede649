"""Benchmark rows without an id hit like the others."""

from loomline.llm import decontam


def test_null_items_hit(spark):
    bench = spark.createDataFrame([(None, "one two three"), (4, "five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, "five six one two three"), (3, "clean")], "doc_id long, text string")
    for size in (1 << 24, 1):
        got = {r["doc_id"]: (r["n_hit"], r["items"], r["n_items"], r["contaminated"]) for r in decontam.contamination(docs, bench, table_bytes=size).collect()}
        assert got == {1: (3, [], 0, True), 2: (5, ["4"], 1, True), 3: (0, [], 0, False)}
