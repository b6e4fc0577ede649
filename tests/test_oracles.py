"""Every query with oracle SQL, against DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

from loomline.plans import registry

registry.load_all()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return "[" + ",".join(map(_norm, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    want = duck.execute(registry.ORACLES[name])
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in sorted(df.columns)]
    assert sorted(got) == sorted(tuple(_norm(r[i]) for i in at) for r in want.fetchall())
