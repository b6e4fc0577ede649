"""One row of each component, where ids repeat or are null."""

import random

from loomline.llm import neardup
from tests.llm.test_llm import brute_components


def some_rows():
    r = random.Random(11)
    a, b, c, d, e = ([f"w{r.randrange(10**6)}" for _ in range(120)] for _ in range(5))
    near = lambda t, i: " ".join([*t[:-1], f"edit{i}"])
    rows = [(1, " ".join(a))] * 40 + [(2, near(a, 1)), (2, " ".join(b)), (2, near(b, 2))]
    rows += [(None, " ".join(c)), (None, near(c, 3)), (None, near(c, 4)), (None, " ".join(d)), (None, " ".join(d))]
    return rows + [(None, " ".join(e)), (7, near(e, 5)), (None, ""), (None, ""), (3, None), (3, "")]


def test_one_row_of_each_component(spark):
    rows = some_rows()
    label = brute_components([t for _, t in rows])
    groups = [[rows[i] for i in range(len(rows)) if label[i] == x] for x in sorted(set(label))]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, n long").repartition(5)
    got = [(r["doc_id"], r["text"]) for r in neardup.keep_first_of_each(docs).collect()]
    assert len(got) == len(groups)
    for group in groups:
        assert sum(x in group for x in got) >= 1
        first = min(group, key=lambda x: (x[0] is None, x[0] or 0))[0]
        assert any(x in group and x[0] == first for x in got)


def test_null_ids_are_linked(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = neardup.near_duplicates(docs).where("key is not null").collect()
    assert len({r["component"] for r in got}) == len(set(brute_components([t for _, t in rows if t])))
    assert sum(r["component_id"] == 7 for r in got) == 2
