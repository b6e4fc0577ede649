"""Connected components by alternating large-star and small-star steps.

The edge list stays distributed. Each step is a grouped minimum (combined on the
map side) and a join, and every round is written to the shared folder, so plans
stay short and a lost executor costs one round. Rounds grow with the logarithm of
the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomline.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v for every row.

    large: every neighbour above u is linked to u's least neighbour (or u).
    small: u and its lower neighbours are linked to the least of those.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        linked = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        linked = (
            edges.join(least, F.col("u") == F.col("k"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        )
    return linked.where("u > v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node.

    Self loops and repeated edges are allowed; rows with a null end are ignored.
    Nodes that occur only in self loops get themselves. An empty list gives no rows.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    work = materialise(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    loops = work.where("u = v").select(F.col("u").alias("node"))
    work = work.where("u > v")
    seen = None
    for _ in range(max_rounds):
        work = materialise(_star(_star(work, True), False), "cc")
        now = _fingerprint(work)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    labelled = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = work.select(F.col("v").alias("node")).unionByName(loops).distinct()
    roots = roots.join(labelled.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return labelled.unionByName(roots)
