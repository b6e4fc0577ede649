"""The URL models keep what the corpus shows, however much else it holds."""

import pytest

from loomline.llm import urls


def test_rare_grams_stay_in_a_large_corpus(spark):
    rows = [("^ab$", 1_000_000, True), ("^zq$", 5, False), ("^x$", 1, False)]
    model = {r["gram"]: r["delta"] for r in urls.train(spark.createDataFrame(rows, "_s string, _n long, accept boolean")).collect()}
    assert model["zq"] < 0 and model["^zq$"] < 0 and "x" not in model
    more = [(s, 50 * n, a) for s, n, a in rows]
    assert "x" in {r["gram"] for r in urls.train(spark.createDataFrame(more, "_s string, _n long, accept boolean")).collect()}


def test_repeated_and_null_urls_come_back(spark):
    rows = [(1, None)] * 3 + [(i, None) for i in range(2, 9)] + [(9, "http://a.net/7"), (10, "http://a.net/8"), (None, "http://b.org/fr/")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    by = {r["page_id"]: r["score"] for r in got}
    assert by[9] == pytest.approx(by[10], abs=1e-12) and by[1] == by[2] and by[None] > by[9]
