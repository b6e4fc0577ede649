"""Graph operators over edge DataFrames (src, dst, weight, type). Frontiers and ranks are joins; each round is
written to the shared folder, so plans stay short and survive lost executors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loomline.operators.components import connected_components
from loomline.operators.paths import Paths
from loomline.session import materialise, ship


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of nodes within ``depth`` steps of the start nodes (one column, node), start included."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    hops = edges.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        step = front.join(hops, front["node"] == hops["src"]).select(F.col("dst").alias("node")).distinct()
        front = materialise(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, source, target, most: int = 6) -> DataFrame:
    """All shortest paths from source to target of at most ``most`` edges, as arrays."""
    paths = edges.select("src", "dst").distinct().where(F.col("src") == F.lit(source)).select(F.array("src", "dst").alias("path"), "dst")
    hops = edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct()
    for _ in range(most):
        paths = materialise(paths, "paths")
        done = paths.where(F.col("dst") == F.lit(target))
        if not done.isEmpty():
            return done.select("path")
        paths = paths.join(hops, F.col("dst") == F.col("s")).where(~F.array_contains("path", F.col("d"))).select(F.concat("path", F.array("d")).alias("path"), F.col("d").alias("dst"))
    return paths.where(F.lit(False)).select("path")


def simple_paths(edges: DataFrame, source, target, most: int = 5) -> DataFrame:
    """Every path without a repeated node, of at most ``most`` edges."""
    hops = edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct()
    front = hops.where(F.col("s") == F.lit(source)).select(F.array("s", "d").alias("path"), F.col("d").alias("dst"))
    out = front.where(F.col("dst") == F.lit(target)).select("path")
    for _ in range(most - 1):
        live = front.where(F.col("dst") != F.lit(target))
        front = materialise(live.join(hops, F.col("dst") == F.col("s")).where(~F.array_contains("path", F.col("d"))).select(F.concat("path", F.array("d")).alias("path"), F.col("d").alias("dst")), "paths")
        out = out.unionByName(front.where(F.col("dst") == F.lit(target)).select("path"))
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, weighted) over undirected edges."""
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"))


def degree_centrality(edges: DataFrame, top: int) -> DataFrame:
    """The ``top`` nodes by degree / (n - 1), ties by node."""
    d = degrees(edges)
    score = F.col("degree") / F.lit(float(max(1, d.count() - 1)))
    return d.select("node", score.alias("score")).orderBy(F.desc("score"), "node").limit(top)


def step(edges: DataFrame, direction: str = "out", types: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst) hops of some types, out, in or both ways."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    out = e.select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back}[direction].distinct() if direction != "both" else out.unionByName(back).distinct()


def neighbourhood(edges: DataFrame, node, depth: int = 1, direction: str = "out", types: tuple[str, ...] = ()) -> DataFrame:
    """(node, depth) of successors, predecessors or both within ``depth`` steps over edges of ``types``; the node itself only at depth 0."""
    start = edges.sparkSession.createDataFrame([(node,)], f"node {edges.schema['src'].dataType.simpleString()}")
    found = reach(step(edges, direction, types), start, depth)
    return found if depth <= 0 else found.where("depth > 0")


def depth_first(edges: DataFrame, node, most: int = 100_000) -> DataFrame:
    """(ordinal, node) in depth-first order from ``node``, neighbours by id. An order over one walk: its size is checked and it is made in one place."""
    start = edges.sparkSession.createDataFrame([(node,)], f"node {edges.schema['src'].dataType.simpleString()}")
    inside = reach(edges, start, most)
    hops = edges.select("src", "dst").distinct().join(inside.select(F.col("node").alias("src")), "src").limit(most + 1).collect()
    if len(hops) > most:
        raise ValueError(f"a depth-first order is over at most {most} edges")
    after: dict = {}
    for s, d in sorted((r["src"], r["dst"]) for r in hops):
        after.setdefault(s, []).append(d)
    order, seen, stack = [], set(), [node]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            order.append((len(order), x))
            stack += [y for y in reversed(after.get(x, [])) if y not in seen]
    return edges.sparkSession.createDataFrame(order, f"ordinal long, node {edges.schema['src'].dataType.simpleString()}")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def has_cycle(edges: DataFrame) -> bool:
    """Whether peeling nodes without in-edges leaves any."""
    return not topological_levels(edges)[1].isEmpty()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank). Mass of nodes without out-edges is not redistributed; repeated edges count in the out-degree."""
    e = materialise(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), "pr-edges")
    nodes = materialise(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "pr-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.sum("m").alias("out"))
    share = materialise(e.join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")), "pr-share")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        flow = share.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        new = nodes.join(flow, F.col("node") == F.col("dst"), "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        new = materialise(new, "pr-ranks")
        change = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new
        if change < tolerance:
            break
    return ranks


def topological_levels(edges: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(node, level) by peeling nodes without in-edges, and what remains: edges of cycles and beyond (empty for a DAG).

    A graph of more levels than ``rounds`` is refused, not returned in part.
    """
    left = materialise(edges.select("src", "dst").distinct(), "topo")
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    done, todo = None, materialise(nodes, "topo-nodes")
    for level in range(rounds):
        free = materialise(todo.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "topo-free")
        if free.isEmpty():
            break
        ranked = free.withColumn("level", F.lit(level))
        done = ranked if done is None else done.unionByName(ranked)
        left = materialise(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "topo")
        todo = materialise(todo.join(free, "node", "left_anti"), "topo-nodes")
    else:
        if not todo.isEmpty():
            raise RuntimeError(f"the graph has more than {rounds} levels")
    return (done if done is not None else nodes.withColumn("level", F.lit(0)).where(F.lit(False))), left


def strongly_connected(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): least node of the strongly connected component, by forward and backward colouring.

    Each round gives every live node the least node that reaches it; the nodes that reach that colour's root
    within the colour form its component and leave. Rounds grow with the depth of components, not with their number;
    a graph that needs more than ``rounds`` is refused, not returned in part.
    """
    live = materialise(edges.select("src", "dst").where("src != dst").distinct(), "scc")
    todo = materialise(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "scc-nodes")
    out = None
    for _ in range(rounds):
        if todo.isEmpty():
            return out if out is not None else todo.withColumn("component", F.col("node"))
        colour = _spread(todo.withColumn("c", F.col("node")), live)
        tinted = live.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = materialise(tinted, "scc-back")
        found = colour.where("node = c").select("node", F.col("c").alias("component"))
        front = found
        while True:
            front = materialise(front.join(back, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "component").distinct().join(found, ["node", "component"], "left_anti"), "scc-front")
            if front.isEmpty():
                break
            found = materialise(found.unionByName(front), "scc-found")
        out = found if out is None else out.unionByName(found)
        todo = materialise(todo.join(found.select("node"), "node", "left_anti"), "scc-nodes")
        live = materialise(live.join(todo.select(F.col("node").alias("src")), "src", "left_semi").join(todo.select(F.col("node").alias("dst")), "dst", "left_semi"), "scc")
    if not todo.isEmpty():
        raise RuntimeError(f"components remain after {rounds} rounds")
    return out


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """Least colour along edges, to a fixed point."""
    now = materialise(colour, "scc-colour")
    while True:
        got = edges.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("c").alias("g"))
        new = materialise(now.join(got, F.col("node") == F.col("dst"), "left").select("node", F.least("c", F.coalesce("g", "c")).alias("c"), (F.coalesce("g", "c") < F.col("c")).alias("changed")), "scc-colour")
        if new.where("changed").isEmpty():
            return new.select("node", "c")
        now = new.select("node", "c")


def betweenness(edges: DataFrame, most_edges: int = 5_000_000) -> DataFrame:
    """(node, score): exact directed betweenness, scaled by 1/((n-1)(n-2)). Rows with a null end are ignored.

    Sources are dealt out to tasks; each holds the edges as numbers, whose size is checked: beyond
    ``most_edges`` distinct edges it is refused rather than broadcast. Work grows with nodes times edges.
    """
    spark = edges.sparkSession
    ship(spark)
    pairs = materialise(edges.select("src", "dst").dropna().distinct(), "betweenness")
    if pairs.count() > most_edges:
        raise ValueError("too many edges to broadcast for exact betweenness")
    rows = pairs.toArrow()
    codes, nodes = pd.factorize(np.concatenate([rows[c].to_numpy() for c in ("src", "dst")]), sort=True)
    src, dst = np.split(codes.astype(np.int32), 2)
    shared, n = spark.sparkContext.broadcast((src, dst, nodes)), len(nodes)
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, n // DEALT))
    kind = edges.schema["src"].dataType.simpleString()
    parts = spark.range(0, tasks, 1, tasks).mapInPandas(lambda it: _between(it, shared, tasks), f"node {kind}, score double")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return parts.groupBy("node").agg((F.sum("score") * scale).alias("score"))


DEALT = 32  # sources dealt out at once


def _between(frames: Iterator[pd.DataFrame], shared, tasks: int) -> Iterator[pd.DataFrame]:
    src, dst, nodes = shared.value
    paths, least = Paths(src, dst, len(nodes)), np.full(len(nodes), len(nodes))
    np.minimum.at(least, src, dst)
    sources = np.argsort(least, kind="stable")[: np.count_nonzero(least < len(nodes))]  # of like neighbours; without those that lead nowhere
    for f in frames:
        for task in f["id"]:
            for i in range(task * DEALT, len(sources), tasks * DEALT):
                paths.add(sources[i : i + DEALT])
    yield pd.DataFrame({"node": nodes, "score": paths.sums})


def clusters(edges: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """(node, component, size) of components of allowed size."""
    c = connected_components(edges)
    size = c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    return c.join(size, "component")


def cluster_metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, size, internal_edges, external_edges, average_similarity, density, separation, connectivity, quality.

    Separation is 1 less the mean similarity of edges that leave the cluster (1 without any); connectivity is the
    mean internal degree over size - 1.
    """
    a, b = members.select(F.col("node").alias("src"), F.col("component").alias("ca")), members.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.count("*").alias("internal_edges"), F.avg("weight").alias("average_similarity"))
    outer = e.where("ca is distinct from cb")
    cross = outer.where("ca is not null").select(F.col("ca").alias("component"), "weight").unionByName(outer.where("cb is not null").select(F.col("cb").alias("component"), "weight"))
    cross = cross.groupBy("component").agg(F.count("*").alias("external_edges"), F.avg("weight").alias("leaving"))
    m = members.select("component", "size").distinct().join(inner, "component", "left").join(cross, "component", "left").fillna(0, ["internal_edges", "average_similarity", "external_edges"])
    full = F.when(F.col("size") > 1, F.col("size") * (F.col("size") - 1) / 2).otherwise(1.0)
    m = m.withColumns({
        "density": F.col("internal_edges") / full, "separation": F.coalesce(1 - F.col("leaving"), F.lit(1.0)),
        "connectivity": F.when(F.col("size") > 1, 2 * F.col("internal_edges") / F.col("size") / (F.col("size") - 1)).otherwise(1.0),
    }).drop("leaving")
    quality = F.col("average_similarity") * 0.35 + F.col("density") * 0.25 + F.col("separation") * 0.20 + F.col("connectivity") * 0.20
    return m.withColumn("quality", F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality)))


def cluster_statistics(metrics: DataFrame) -> DataFrame:
    """One row: clusters, members, sizes (mean, median, least, most), mean density and quality."""
    return metrics.agg(
        F.count("*").alias("clusters"), F.sum("size").alias("members"), F.sum("internal_edges").alias("edges"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"),
        F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.avg("density").alias("mean_density"), F.avg("quality").alias("mean_quality"),
    )


def quality_bins(metrics: DataFrame) -> DataFrame:
    """(bin, n): clusters by quality in bins a tenth wide, named by their edges; 1.0 is in the last."""
    at = F.least(F.floor(F.round(F.col("quality") * 10, 9)), F.lit(9)) / 10
    return metrics.groupBy(F.format_string("%.1f-%.1f", at, at + 0.1).alias("bin")).agg(F.count("*").alias("n"))


def cluster_issues(members: DataFrame, edges: DataFrame, representatives: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """(code, severity, cluster, node): what a validator finds in ``members`` (node, cluster; rows as stored)."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    issue = lambda df, code, severity, node=None: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("cluster"), (F.col(node) if node else F.lit(None)).cast("string").alias("node"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    inside = edges.join(members.select(F.col("node").alias("src"), "cluster"), "src").join(members.select(F.col("node").alias("dst"), F.col("cluster").alias("other")), "dst").where("cluster = other").select("cluster").distinct()
    named = size.join(representatives.withColumnsRenamed({"representative": "node"}), "cluster", "left")
    found = [
        issue(size.where(F.col("size") < least), "MIN_SIZE_VIOLATION", "ERROR"),
        issue(size.where(F.col("size") > most), "MAX_SIZE_VIOLATION", "ERROR"),
        issue(members.groupBy("cluster", "node").count().where("count > 1").select("cluster").distinct(), "DUPLICATE_MEMBERS", "ERROR"),
        issue(named.where("node is null"), "MISSING_REPRESENTATIVE", "ERROR"),
        issue(named.where("node is not null").join(members, ["cluster", "node"], "left_anti"), "REPRESENTATIVE_NOT_IN_CLUSTER", "ERROR", "node"),
        issue(members.join(nodes, "node", "left_anti"), "ORPHAN_MEMBER_ID", "ERROR", "node"),
        issue(members.distinct().groupBy("node").agg(F.max("cluster").alias("cluster"), F.count("*").alias("n")).where("n > 1"), "OVERLAPPING_MEMBER", "WARN", "node"),
        issue(size.where("size > 1").join(inside, "cluster", "left_anti"), "DISCONNECTED_CLUSTER", "WARN"),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def post_process(members: DataFrame, edges: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """(node, cluster) after the four steps in order: singletons go, clusters over ``most`` go, small ones merge, those still under ``least`` go."""
    sized = lambda m: m.join(m.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    kept = materialise(sized(members.select("node", "cluster")).where((F.col("size") > 1) & (F.col("size") <= most)).select("node", "cluster"), "clusters-sized")
    merged = materialise(merge_small(kept, edges, least, most), "clusters-merged")
    return sized(merged).where(F.col("size") >= least).select("node", "cluster")


def find_clusters(members: DataFrame, representatives: DataFrame, cluster=None, member=None, representative=None) -> DataFrame:
    """(cluster, node) rows of the clusters with this id, this member or this representative."""
    want = members.select("cluster").distinct()
    if cluster is not None:
        want = want.where(F.col("cluster") == cluster)
    if member is not None:
        want = want.join(members.where(F.col("node") == member).select("cluster"), "cluster", "left_semi")
    if representative is not None:
        want = want.join(representatives.where(F.col("representative") == representative).select("cluster"), "cluster", "left_semi")
    return members.join(want, "cluster", "left_semi").select("cluster", "node")


#: Community providers by name; those without an implementation say so when they are called.
PROVIDERS = {"connected_components": lambda edges: connected_components(edges).withColumnRenamed("component", "cluster")}


def communities(provider: str, edges: DataFrame) -> DataFrame:
    """(node, cluster) by a registered provider."""
    if provider in ("louvain", "leiden"):
        raise NotImplementedError(f"{provider} is declared but not implemented")
    if provider not in PROVIDERS:
        raise ValueError(f"no community provider {provider}")
    return PROVIDERS[provider](edges)


def representatives(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, representative): largest weighted degree within, then average similarity, then least node."""
    own = edges.join(members.select(F.col("node").alias("src"), F.col("component").alias("ca")), "src").join(members.select(F.col("node").alias("dst"), F.col("component").alias("cb")), "dst").where("ca = cb")
    d = degrees(own).join(members, "node")
    best = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.round("weighted", 9)), F.desc(F.round(F.col("weighted") / F.col("degree"), 9)), "node"))
    return d.withColumn("rn", best).where("rn = 1").select("component", F.col("node").alias("representative"))


def average_linkage(edges: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster): agglomerative average linkage within each component (missing edges are 0), stopping under the threshold.

    A component is one group of bounded size (see clusters); merging is sequential by nature.
    """
    ship(edges.sparkSession)
    own = edges.join(members.select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst", "weight")
    return own.groupBy("component").applyInPandas(lambda f: _linkage(f, threshold), "node long, cluster long")


def _linkage(f: pd.DataFrame, threshold: float) -> pd.DataFrame:
    groups = {int(x): [int(x)] for x in set(f["src"]) | set(f["dst"])}
    sums: dict[int, dict[int, float]] = {x: {} for x in groups}  # sum of similarities between two groups, both ways
    for s, d, w in zip(f["src"].tolist(), f["dst"].tolist(), f["weight"].tolist()):
        if s != d:
            sums[s][d] = sums[d][s] = float(w)

    def entry(a: int, b: int) -> tuple[float, int, int, int, int]:
        a, b = min(a, b), max(a, b)
        return (-round(sums[a][b] / (len(groups[a]) * len(groups[b])), 12), a, b, len(groups[a]), len(groups[b]))

    # The best average first, ties to the least pair; an entry is stale once either group has grown or gone.
    heap = [entry(a, b) for a in sums for b in sums[a] if a < b]
    heapq.heapify(heap)
    while heap:
        average, a, b, na, nb = heapq.heappop(heap)
        if a not in groups or b not in groups or (na, nb) != (len(groups[a]), len(groups[b])):
            continue
        if -average < threshold:
            break
        groups[a] += groups.pop(b)
        for other, total in sums.pop(b).items():
            del sums[other][b]
            if other != a:
                sums[a][other] = sums[other][a] = sums[a].get(other, 0.0) + total
        for other in sums[a]:
            heapq.heappush(heap, entry(a, other))
    return pd.DataFrame([(n, min(g)) for g in groups.values() for n in g], columns=["node", "cluster"])


def merge_small(members: DataFrame, edges: DataFrame, small: int, most: int = 500) -> DataFrame:
    """(node, cluster): clusters under ``small`` join the larger cluster of best average similarity, if that is above 0 and stays within ``most``."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    m = members.join(size, "cluster")
    e = edges.join(m.select(F.col("node").alias("src"), F.col("cluster").alias("ca"), F.col("size").alias("sa")), "src").join(m.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"), F.col("size").alias("sb")), "dst").where("ca != cb")
    both = e.select("ca", "sa", "cb", "sb", "weight").union(e.select("cb", "sb", "ca", "sa", "weight"))
    affinity = both.where((F.col("sa") < small) & (F.col("sb") >= small) & (F.col("sa") + F.col("sb") <= most)).groupBy("ca", "sa", "cb", "sb").agg((F.sum("weight") / (F.col("sa") * F.col("sb"))).alias("affinity")).where("affinity > 0")
    best = affinity.withColumn("rn", F.row_number().over(Window.partitionBy("ca").orderBy(F.desc("affinity"), "cb"))).where("rn = 1").select(F.col("ca").alias("cluster"), F.col("cb").alias("into"))
    return members.join(best, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
