"""Betweenness against a count over all pairs, on graphs of several shapes; size and speed."""

from __future__ import annotations

import time

import numpy as np
import pytest

from loomline.operators import graph as G, paths as P

r = np.random.default_rng(5)
N = 120


def power(size):
    return [tuple(x) for x in (N * r.random((size, 2)) ** 3).astype(int).tolist()]


SHAPES = {
    "even": [(a, (7 * a + k) % N) for a in range(N) for k in range(5) if (a + k) % 6],
    "sparse": [tuple(x) for x in r.integers(0, N, (N, 2)).tolist()],
    "power": power(600),
    "hub": [(0, a) for a in range(N)] + [(a, 1) for a in range(N)] + power(60),
    "chain": [(a, a + 1) for a in range(N - 1)],
    "comet": [tuple(x) for x in r.integers(0, 60, (200, 2)).tolist()] + [(a, a + 1) for a in range(59, N - 1)],
    "grid": [(a, a + 10) for a in range(N - 10)] + [(a, a + 1) for a in range(N - 1)],
    "loops": [(a, a) for a in range(5)] + [(0, 1), (1, 2), (2, 0), (2, 3)],
}


def brute(edges):
    """A pair's paths through a middle node: as many as lead there, times as many as lead on, if no detour."""
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    n = len(nodes)
    step = np.zeros((n, n))
    for a, b in edges:
        step[at[a], at[b]] = 1
    far, ways, now = np.where(np.eye(n) > 0, 0.0, np.inf), np.eye(n), np.eye(n)
    for d in range(1, n):
        now = np.where(np.isinf(far), now @ step, 0)
        far[now > 0], ways = d, ways + now
    score = {}
    for v in range(n):
        on = (far[:, [v]] + far[[v], :] == far) & np.isfinite(far) & (far > 0)
        on[v, :] = on[:, v] = False
        score[nodes[v]] = float((ways[:, [v]] * ways[[v], :] / np.where(on, ways, 1))[on].sum())
    return score


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("narrow", [0, P.NARROW, 10**9])
@pytest.mark.parametrize("width, chunk", [(4, 4096), (1, 16)])
def test_paths_are_those_of_all_pairs(monkeypatch, shape, narrow, width, chunk):
    monkeypatch.setattr(P, "NARROW", narrow)  # 0: always by levels; 10**9: always by loops
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "ALONE", 10**9 if width > 1 else 0)
    want = brute(SHAPES[shape])
    nodes = {x: i for i, x in enumerate(want)}
    src, dst = (np.array([nodes[e[i]] for e in sorted(set(SHAPES[shape]))]) for i in (0, 1))
    paths = P.Paths(src, dst, len(nodes))
    paths.loops = narrow == 10**9
    paths.add(np.arange(len(nodes)))
    assert paths.sums == pytest.approx(list(want.values()), rel=1e-12, abs=1e-12)


def test_betweenness_of_names_nulls_and_nothing(spark):
    want = brute([(str(a), str(b)) for a, b in SHAPES["power"]])
    rows = [(str(a), str(b)) for a, b in SHAPES["power"]] + [(None, "5"), ("5", None)]
    got = {x["node"]: x["score"] for x in G.betweenness(spark.createDataFrame(rows, "src string, dst string")).collect()}
    n = len(want)
    assert got == pytest.approx({v: s / ((n - 1) * (n - 2)) for v, s in want.items()}, rel=1e-9, abs=1e-12)
    assert G.betweenness(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_more_than_two_million_edges_are_not_refused(spark):
    n = 1450  # each node leads to all but itself and the next one, which it reaches by any of the n - 3 others
    e = spark.range(n * n).selectExpr(f"id div {n} as src", f"id % {n} as dst").where(f"src != dst and dst != (src + 1) % {n}")
    got = [x["score"] for x in G.betweenness(e).collect()]
    assert len(got) == n and e.count() > 2_000_000 and got == pytest.approx([1 / ((n - 1) * (n - 2))] * n)


def test_wide_levels_take_a_fraction_of_the_time_of_loops():
    n = 15_000
    a = np.repeat(np.arange(n), 5)
    paths = P.Paths(a, (a * 7 + np.tile(np.arange(5), n)) % n, n)
    took = {}
    for how in (paths.stepped, paths.looped):
        began = time.thread_time()
        for i in range(0, 40, 4):
            how(np.arange(i, i + 4), True)
        took[how.__name__] = time.thread_time() - began
    assert took["stepped"] * 3 < took["looped"]
