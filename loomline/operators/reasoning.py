"""Rules over a typed edge table (src, dst, type, confidence): inference, chains, root causes, confidence."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.operators.components import connected_components
from loomline.operators.graph import degrees
from loomline.session import materialise
from loomline.sources.sinks import StaleAsset, read_asset, read_manifest, write_asset


# Edge types each rule reads.
TRANSITIVE_TYPES = ("causes", "depends_on", "contains", "belongs_to", "derived_from", "references")
EVIDENCE_TYPES = ("references", "supported_by", "derived_from")
CAUSE_TYPES = ("causes", "blocks", "depends_on")
LEAST_CONFIDENCE = 0.15


def _four(c: Column) -> Column:
    """Four digits; the last bits of a sum, which depend on its order, don't decide a half."""
    return F.round(F.round(c, 9), 4)


def _confidences(nodes: DataFrame, name: str, value: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias(name), F.col("confidence").alias(value))


def transitive(edges: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """One two-hop step within a type: a -> b -> c gives a -> c, without a = c; the best product of confidences counts.

    The step is a sort-merge join, which the runtime splits where a hub holds most of a partition.
    """
    e = edges.where("src != dst")
    a, b = e.alias("a"), e.hint("merge").alias("b")
    j = a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.src") != F.col("b.dst")))
    c = F.col("a.confidence") * F.col("b.confidence")
    return j.where(c >= least).groupBy(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), F.col("a.type").alias("type")).agg(F.max(c).alias("confidence"))


def convergence(edges: DataFrame, least: int = 2) -> DataFrame:
    """Nodes that several sources support, with the mean confidence."""
    return edges.where("src != dst").groupBy("dst").agg(F.count_distinct("src").alias("sources"), F.avg("confidence").alias("confidence")).where(F.col("sources") >= least)


_RESULT = ("inference_id", "rule", "src", "dst", "confidence", "provenance")


def _result(df: DataFrame, rule: str, key: Column, src, dst, confidence, provenance) -> DataFrame:
    rows = df.select(F.sha2(key, 256).alias("inference_id"), F.lit(rule).alias("rule"), src.alias("src"), dst.alias("dst"), _four(confidence).alias("confidence"), provenance.alias("provenance"))
    return rows.select(*_RESULT)


def rule_transitive(nodes: DataFrame, edges: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Two hops of one transitive type; the product of the three nodes' confidences counts."""
    e = edges.where(F.col("type").isin(*TRANSITIVE_TYPES)).select("src", "dst", "type").distinct()
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").join(e.hint("merge").select(F.col("src").alias("b"), F.col("dst").alias("c"), "type"), ["b", "type"]).where("a != c")
    for name in "abc":
        two = two.join(_confidences(nodes, name, f"{name}_conf"), name, "left")
    known = lambda c: F.coalesce(F.col(f"{c}_conf"), F.lit(0.5))
    conf = known("a") * known("b") * known("c")
    key = F.concat_ws(":", F.lit("transitive"), "type", "a", "b", "c", F.lit("1.0"))
    return _result(two.where(conf >= least), "transitive_closure", key, F.col("a"), F.col("c"), conf, F.array("a", "b", "c"))


def _support(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, src, cs, ct): distinct sources of evidence and both confidences."""
    e = edges.where(F.col("type").isin(*EVIDENCE_TYPES)).select("src", "dst").distinct()
    j = e.join(_confidences(nodes, "src", "cs"), "src", "left").join(_confidences(nodes, "dst", "ct"), "dst", "left")
    return j.select("dst", "src", F.coalesce("cs", F.lit(0.5)).alias("cs"), F.coalesce("ct", F.lit(0.5)).alias("ct"))


def rule_convergence(nodes: DataFrame, edges: DataFrame, least: float = LEAST_CONFIDENCE, sources: int = 2) -> DataFrame:
    """Nodes with at least two sources over the evidence types; the mean over sources of the mean of both confidences.

    The id is a hash over the sorted sources, so the distinct sources of one node are one row.
    """
    g = _support(nodes, edges).groupBy("dst").agg(F.count("*").alias("n"), F.avg((F.col("cs") + F.col("ct")) / 2).alias("conf"), F.array_sort(F.collect_set("src")).alias("srcs"))
    g = g.where((F.col("n") >= sources) & (F.col("conf") >= least))
    key = F.concat_ws(":", F.lit("evidence_convergence"), "dst", F.array_join("srcs", ":"), F.lit("1.0"))
    return _result(g, "evidence_convergence", key, F.lit(None).cast("string"), F.col("dst"), F.col("conf"), F.concat(F.array("dst"), F.col("srcs")))


def _back(paths: DataFrame, edges: DataFrame, types: tuple[str, ...], most: int) -> DataFrame:
    """Maximal paths against the edges of ``types``: (effect, path from the effect back to a root)."""
    hops = edges.where(F.col("type").isin(*types)).select(F.col("src").alias("p"), F.col("dst").alias("at")).distinct()
    out = None
    for _ in range(most):
        paths = materialise(paths, "causal")
        step = paths.join(hops, "at", "left")
        ended = step.where("p is null").select("effect", "path")
        out = ended if out is None else out.unionByName(ended)
        paths = step.where("p is not null").where(~F.array_contains("path", F.col("p"))).select("effect", F.concat("path", F.array("p")).alias("path"), F.col("p").alias("at"))
        if paths.isEmpty():
            return out
    last = materialise(paths, "causal").join(hops, "at", "left_anti")
    return out.unionByName(last.select("effect", "path"))


def along(paths: DataFrame, nodes: DataFrame, method: str = "multiplicative", decay: float = 0.9) -> DataFrame:
    """Adds ``confidence`` of each ``path`` (array of nodes), by the nodes' confidences (0.5 where unknown) of every step's two ends."""
    rows = paths.withColumn("_p", F.sha2(F.array_join("path", "\u0001"), 256))
    at = rows.select("_p", "path").distinct().select("_p", F.posexplode("path").alias("i", "node")).join(_confidences(nodes, "node", "c"), "node", "left")
    cs = at.groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("c", F.lit(0.5)).alias("c")))), lambda x: x["c"]).alias("cs"))  # a path is short
    c, n = F.col("cs"), F.size("cs")
    inner = F.slice(c, 2, F.greatest(n - 2, F.lit(0)))
    if method == "multiplicative":  # every inner node is an end of two steps
        value = F.aggregate(c, F.lit(1.0), lambda a, x: a * x) * F.aggregate(inner, F.lit(1.0), lambda a, x: a * x)
    elif method == "minimum":
        value = F.array_min(c)
    elif method == "decay":
        value = F.get(c, F.lit(0)) * F.pow(F.lit(decay), n - 1)
    elif method == "weighted_average":  # step i weighs 1 / i
        steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1.0 / i)
        value = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(c, i - 1) + F.get(c, i)) / 2.0 / i) / total
    else:
        raise ValueError(f"no way to propagate called {method}")
    value = F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return rows.join(cs, "_p").withColumn("confidence", value).drop("_p", "cs")


def rule_causal(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """From each problem signal back over ``causes`` to its roots: the maximal paths, with the propagated confidence."""
    signals = nodes.where("node_type = 'problem_signal'").select(F.col("node_id").alias("effect"), F.array("node_id").alias("path"), F.col("node_id").alias("at"))
    paths = along(_back(signals, edges, ("causes",), most).where(F.size("path") >= 2), nodes)
    root = F.element_at("path", -1)
    key = F.concat_ws(":", F.lit("causal"), "effect", root, F.array_join("path", "_"), F.lit("1.0"))
    return _result(paths, "causal_chain", key, root, F.col("effect"), F.col("confidence"), F.col("path"))


#: Rules by name: (priority, dependencies, function of nodes and edges).
RULES = {
    "transitive_closure": (100, (), rule_transitive),
    "evidence_convergence": (90, ("transitive_closure",), rule_convergence),
    "causal_chain": (80, ("transitive_closure",), rule_causal),
}


def resolve(enabled: tuple[str, ...] = ()) -> list[str]:
    """The rules to run, by priority, with those they depend on; a rule that needs an unknown one is left out."""
    names = [n for n in sorted(RULES, key=lambda n: -RULES[n][0]) if not enabled or n in enabled]
    for name in list(names):
        for need in RULES[name][1]:
            if need not in RULES:
                names.remove(name)
                break
            if need not in names:
                names.append(need)
    return names


def infer(nodes: DataFrame, edges: DataFrame, enabled: tuple[str, ...] = ()) -> DataFrame:
    """All results of the rules, one row an inference, with the ordinal of its rule.

    Rules read the graph as it is and never one another's results, so passes after the first add nothing: one is made.
    """
    out = None
    for i, name in enumerate(resolve(enabled)):
        got = RULES[name][2](nodes, edges).withColumn("ordinal", F.lit(i))
        out = got if out is None else out.unionByName(got)
    return out.dropDuplicates(["inference_id"])


def steps(inferences: DataFrame) -> DataFrame:
    """Provenance: (chain_id, inference_id, step_id, rule, input, confidence), a row for each node an inference went through."""
    chain = F.sha2(F.concat_ws(":", F.lit("chain"), "inference_id", F.lit("1.0")), 256)
    return inferences.select(chain.alias("chain_id"), "inference_id", "rule", "confidence", F.posexplode("provenance").alias("step_id", "input"))


def causes(nodes: DataFrame, edges: DataFrame, ranking: str = "transitive_impact", most: int = 8) -> DataFrame:
    """Root causes of problem signals: cause, effect, path_length, confidence, impact, evidence, score.

    Back over causes, blocks and depends_on; a signal without any is its own cause. Of several paths the most confident counts.
    Impact is how many nodes lie downstream of the cause. Ranked by transitive_impact, confidence or depth.
    """
    signals = nodes.where("node_type = 'problem_signal'").select(F.col("node_id").alias("effect"), F.array("node_id").alias("path"), F.col("node_id").alias("at"))
    paths = along(_back(signals, edges, CAUSE_TYPES, most), nodes).withColumn("cause", F.element_at("path", -1))
    best = paths.groupBy("cause", "effect").agg(F.max_by(F.struct("path", "confidence"), F.struct("confidence", (-F.size("path")).alias("l"), F.array_join("path", ",").alias("p"))).alias("b"))
    best = materialise(best.select("cause", "effect", (F.size("b.path") - 1).alias("path_length"), _four(F.col("b.confidence")).alias("confidence")), "causes")
    typed = edges.where(F.col("type").isin(*CAUSE_TYPES)).select("src", "dst").distinct()
    front = seen = best.select("cause", F.col("cause").alias("node")).distinct()
    for _ in range(most):
        front = materialise(front.join(typed, F.col("node") == F.col("src")).select("cause", F.col("dst").alias("node")).distinct().join(seen, ["cause", "node"], "left_anti"), "causes-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    impact = seen.where("node != cause").groupBy("cause").agg(F.count("*").alias("impact"))
    support = edges.where(F.col("type").isin("references", "supported_by")).select("dst", "src", "type").distinct().groupBy(F.col("dst").alias("effect")).agg(F.count("*").alias("evidence"))
    out = best.join(impact, "cause", "left").join(support, "effect", "left").fillna(0, ["impact", "evidence"])
    if ranking == "confidence":
        return out.withColumn("score", F.col("confidence"))
    top = out.agg(F.greatest(F.max("impact"), F.lit(1)).alias("mi"), F.greatest(F.max("evidence"), F.lit(1)).alias("me"), F.greatest(F.max("path_length"), F.lit(1)).alias("ml"))
    out = out.join(F.broadcast(top))  # one row
    score = F.col("path_length") / F.col("ml") if ranking == "depth" else F.col("impact") / F.col("mi") * F.col("confidence") * (F.col("evidence") / F.col("me") + 0.5)
    return out.withColumn("score", _four(score)).drop("mi", "me", "ml")


def aggregate_evidence(nodes: DataFrame, edges: DataFrame, least: int = 2, conflict: float = 0.3) -> DataFrame:
    """conclusion, evidence_count, confidence (mean product of both ends), conflicting (neighbours, either way, of low confidence) for nodes with enough sources."""
    s = _support(nodes, edges).groupBy(F.col("dst").alias("conclusion")).agg(F.count("*").alias("evidence_count"), F.avg(F.when(F.col("cs") * F.col("ct") > 0, F.col("cs") * F.col("ct"))).alias("c"))
    s = s.where(F.col("evidence_count") >= least)
    low = nodes.where(F.col("confidence") < conflict).select(F.col("node_id").alias("other"))
    both = edges.select(F.col("dst").alias("conclusion"), F.col("src").alias("other"), F.lit("in").alias("way")).unionByName(edges.select(F.col("src").alias("conclusion"), F.col("dst").alias("other"), F.lit("out").alias("way"))).distinct()
    doubt = both.join(low, "other").groupBy("conclusion").agg(F.count("*").alias("conflicting"))
    return s.join(doubt, "conclusion", "left").select("conclusion", "evidence_count", _four(F.coalesce("c", F.lit(0.0))).alias("confidence"), F.coalesce("conflicting", F.lit(0)).alias("conflicting"))


def graph_hash(nodes: DataFrame, edges: DataFrame, rules: tuple[str, ...] = (), version: str = "1.0") -> str:
    """Identifies a graph, the rules and their version; order-free sums of row hashes."""
    total = lambda df, c: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(c).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    n, e = total(nodes, "node_id"), total(edges, "edge_id")
    raw = "|".join(map(str, (*n, *e, version, *sorted(rules))))
    return hashlib.sha256(raw.encode()).hexdigest()[:16]


def cached(nodes: DataFrame, edges: DataFrame, folder: str, enabled: tuple[str, ...] = ()) -> DataFrame:
    """Inferences from ``folder`` if they are of this graph, else made and written there under the graph's hash."""
    spark, key = nodes.sparkSession, graph_hash(nodes, edges, enabled)
    try:
        if read_manifest(spark, folder, "inferences")["run_id"] == key:
            return read_asset(spark, folder, "inferences", key)
    except StaleAsset:
        pass
    write_asset(infer(nodes, edges, enabled), folder, "inferences", key)
    return read_asset(spark, folder, "inferences", key)


def chains(edges: DataFrame, most: int = 8) -> DataFrame:
    """(start, path): maximal paths from nodes without in-edges, of at most ``most`` edges."""
    hops = edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct()
    starts = hops.select("s").distinct().join(hops.select(F.col("d").alias("s")).distinct(), "s", "left_anti")
    live = starts.join(hops, "s").select(F.col("s").alias("start"), F.array("s", "d").alias("path"), F.col("d").alias("at"))
    out = None
    for _ in range(most - 1):
        live = materialise(live, "chains")
        step = live.join(hops, (F.col("at") == F.col("s")) & ~F.array_contains("path", F.col("d")), "left")
        ended = step.where("d is null").select("start", "path")
        out = ended if out is None else out.unionByName(ended)
        live = step.where("d is not null").select("start", F.concat("path", F.array("d")).alias("path"), F.col("d").alias("at"))
        if live.isEmpty():
            return out
    return out.unionByName(live.select("start", "path"))


def root_causes(edges: DataFrame, most: int = 8) -> DataFrame:
    """(root, impact, rank): nodes without causes, how many nodes lie downstream, and their rank by that."""
    hops = edges.select("src", "dst").distinct()
    roots = hops.select("src").distinct().join(hops.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("root"))
    front = seen = roots.select("root", F.col("root").alias("node"))
    for _ in range(most):
        front = materialise(front.join(hops, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"), "roots")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    impact = materialise(seen.where("node != root").groupBy("root").agg(F.count("*").alias("impact")), "roots-impact")
    ranks = impact.select("impact").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("impact"))))  # distinct impacts alone meet in one task
    return impact.join(ranks, "impact").select("root", "impact", "rank")


def path_confidence(c: Column, method: str, decay: float = 0.9) -> Column:
    """Confidence along a path from an array of step confidences."""
    if method == "multiplicative":
        return F.aggregate(c, F.lit(1.0), lambda a, x: a * x)
    if method == "minimum":
        return F.array_min(c)
    if method == "decay":
        return F.get(c, F.lit(0)) * F.pow(F.lit(decay), F.size(c) - 1)
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)


def weighted(confidence: str, weight: str) -> Column:
    return F.sum(F.col(confidence) * F.col(weight)) / F.sum(F.abs(F.col(weight)))


def explanation(kind: Column, src: Column, dst: Column, confidence: Column, path: Column) -> Column:
    """One sentence; paths of more than four steps keep two at either end."""
    steps = F.when(F.size(path) > 4, F.concat(F.slice(path, 1, 2), F.array(F.format_string("... %d more ...", F.size(path) - 4)), F.slice(path, -2, 2))).otherwise(path)
    return F.format_string("%s: %s leads to %s with confidence %.2f via %s", kind, src, dst, confidence, F.array_join(steps, " -> "))


def graph_metadata(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """nodes, edges, avg_degree, density, orphans, components, largest_component and avg_confidence of the graph as one row.

    Without ``nodes`` (node_id, confidence) the nodes are the ends of the edges and avg_confidence is null.
    """
    ends = degrees(edges.withColumn("weight", F.lit(1.0)) if "weight" not in edges.columns else edges)
    if nodes is None:
        at = ends.withColumn("confidence", F.lit(None).cast("double"))
    else:
        at = nodes.select(F.col("node_id").alias("node"), "confidence").join(ends, "node", "left").fillna(0, ["degree"])
    n = at.agg(F.count("*").alias("nodes"), F.avg("degree").alias("avg_degree"), F.count_if(F.col("degree") == 0).alias("orphans"), F.avg("confidence").alias("avg_confidence"))
    e = edges.agg(F.count("*").alias("edges"))
    c = connected_components(edges).groupBy("component").agg(F.count("*").alias("c")).agg(F.count("*").alias("joined"), F.coalesce(F.max("c"), F.lit(0)).alias("largest"))
    m = n.join(F.broadcast(e)).join(F.broadcast(c))  # one row each
    m = m.withColumn("components", F.col("joined") + F.col("orphans")).withColumn("largest_component", F.greatest("largest", F.when(F.col("orphans") > 0, 1).otherwise(0))).drop("joined", "largest")
    m = m.withColumn("largest_ratio", F.col("largest_component") / F.greatest(F.col("nodes"), F.lit(1)))
    return m.withColumn("density", F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def health(meta: DataFrame, least: dict[str, float]) -> DataFrame:
    """100 less up to 20 points for each measure's shortfall against its minimum."""
    score = F.lit(100.0)
    for name, floor in least.items():
        score = score - F.greatest(F.lit(0.0), (F.lit(floor) - F.col(name)) / floor * 20)
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return meta.withColumn("score", F.round(s, 2)).withColumn("status", F.when(s >= 80, "healthy").when(s >= 50, "degraded").otherwise("critical"))
