"""Queries: the knowledge graph built from documents, and search, rules and neighbourhoods over a typed graph."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomline.operators import evidence as V, graph as G, knowledge as K, opportunity as O, reasoning as R
from loomline.plans.extract import SIGNALS_SQL, observations
from loomline.plans.registry import query, table
from loomline.session import materialise

# ---- the graph of the documents' observations, evidence, signals and clusters of evidence

LEAST = 0.2


def _id(kind: str, asset: str, sid: str) -> str:
    return f"sha256('{kind}:{asset}:' || {sid} || ':{K.PIPELINE_VERSION}:{K.SCHEMA_VERSION}')"


def _eid(kind: str, src: str, dst: str) -> str:
    return f"sha256({kind} || ':' || {src} || ':' || {dst} || ':{K.PIPELINE_VERSION}:{K.SCHEMA_VERSION}:1.0')"


_SIGNAL = "substr(sha256('sig:' || category || ':' || signal_text), 1, 16)"
_CLUSTER = "substr(sha256('cluster:' || category), 1, 16)"
_KG = f"""{SIGNALS_SQL},
kc AS (SELECT {_CLUSTER} AS cluster_id, category, arg_min(evidence_id, (-observation_count, evidence_id)) AS rep, list_sort(list(evidence_id)) AS members, round(avg(confidence), 6) AS quality FROM e WHERE category IS NOT NULL GROUP BY category),
kn AS (SELECT DISTINCT {_id('observation', 'observations.parquet', 'observation_id')} AS node_id, 'observation' AS node_type, observation_id AS source_id, NULL::DOUBLE AS confidence FROM o
 UNION ALL SELECT {_id('evidence', 'evidence.parquet', 'evidence_id')}, 'evidence', evidence_id, confidence FROM e
 UNION ALL SELECT {_id('problem_signal', 'problem_signals.parquet', _SIGNAL)}, 'problem_signal', {_SIGNAL}, confidence FROM sg
 UNION ALL SELECT {_id('cluster', 'semantic_clusters.parquet', 'cluster_id')}, 'cluster', cluster_id, quality FROM kc),
kr AS (SELECT lag(evidence_id) OVER w AS a, evidence_id AS b, 1 - abs(confidence - lag(confidence) OVER w) AS weight FROM e WHERE category IS NOT NULL WINDOW w AS (PARTITION BY category ORDER BY evidence_id)),
km AS (SELECT cluster_id, rep, unnest(members) AS m FROM kc),
ks AS (SELECT {_SIGNAL} AS signal_id, confidence, unnest(evidence_ids) AS evidence_id FROM sg),
ke0 AS (SELECT 'similar_to' AS type, {_id('evidence', 'evidence.parquet', 'a')} AS src, {_id('evidence', 'evidence.parquet', 'b')} AS dst, weight, weight AS confidence FROM kr WHERE a IS NOT NULL
 UNION ALL SELECT CASE WHEN m = rep THEN 'belongs_to' ELSE 'member_of_cluster' END, {_id('evidence', 'evidence.parquet', 'm')}, {_id('cluster', 'semantic_clusters.parquet', 'cluster_id')}, 1.0, CASE WHEN m = rep THEN 1.0 ELSE 0.8 END FROM km
 UNION ALL SELECT 'causes', {_id('evidence', 'evidence.parquet', 'evidence_id')}, {_id('problem_signal', 'problem_signals.parquet', 'signal_id')}, confidence, confidence FROM ks),
ke AS (SELECT *, {_eid('type', 'src', 'dst')} AS edge_id FROM ke0 WHERE confidence >= {LEAST} AND weight >= 0.1)"""


def assets(spark, d):
    """The pipeline's assets, and relationships between neighbouring evidence of a category."""
    obs = materialise(observations(spark, d), "kg-observations")
    ev = materialise(V.evidence(obs), "kg-evidence")
    sig = V.signals(ev, V.adaptive_minimum(table(spark, d, "documents").count()))
    sid = F.substring(F.sha2(F.concat_ws(":", F.lit("sig"), "category", "signal_text"), 256), 1, 16)
    sig = sig.select(sid.alias("signal_id"), F.col("signal_text").alias("label"), "category", "confidence", "evidence_ids")
    cid = F.substring(F.sha2(F.concat_ws(":", F.lit("cluster"), "category"), 256), 1, 16)
    grouped = ev.where("category is not null").groupBy("category").agg(
        F.min(F.struct((-F.col("observation_count")).alias("n"), "evidence_id")).alias("rep"), F.array_sort(F.collect_set("evidence_id")).alias("member_ids"), F.round(F.avg("confidence"), 6).alias("quality_score")
    )  # clusters hold their members' ids
    clusters = grouped.select(cid.alias("cluster_id"), F.col("rep.evidence_id").alias("representative_id"), "member_ids", "quality_score", "category")
    w = Window.partitionBy("category").orderBy("evidence_id")
    pairs = ev.where("category is not null").select(F.lag("evidence_id").over(w).alias("source_id"), F.col("evidence_id").alias("target_id"), (1 - F.abs(F.col("confidence") - F.lag("confidence").over(w))).alias("similarity_score"))
    o = obs.select("observation_id", F.col("value").alias("text"), "category", "entity", "platform", "confidence")
    e = ev.select("evidence_id", F.col("signal_text").alias("text"), "category", "entity", "document_count", "observation_count", "confidence")
    return {"observation": o, "evidence": e, "problem_signal": sig, "cluster": clusters}, pairs.where("source_id is not null")


def built(spark, d):
    found, pairs = assets(spark, d)
    nodes, edges = K.build(found, pairs, least_confidence=LEAST)
    return materialise(nodes, "kg-nodes"), materialise(edges, "kg-edges")


@query("kg_nodes", f"WITH {_KG} SELECT node_id, node_type, source_id FROM kn")
def kg_nodes(spark, d):
    return built(spark, d)[0].select("node_id", "node_type", "source_id")


@query("kg_edges", f"WITH {_KG} SELECT edge_id, src, dst, type, round(weight, 6) AS weight, round(confidence, 6) AS confidence FROM ke")
def kg_edges(spark, d):
    return built(spark, d)[1].select("edge_id", "src", "dst", "type", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"))


@query("kg_type_counts", f"WITH {_KG} SELECT 'node' AS what, node_type AS type, count(*) AS n FROM kn GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM ke GROUP BY 2")
def kg_type_counts(spark, d):
    nodes, edges = built(spark, d)
    count = lambda df, what, c: df.groupBy(F.col(c).alias("type")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node", "node_type").unionByName(count(edges, "edge", "type"))


_ENDS = "x AS (SELECT src AS node FROM ke UNION ALL SELECT dst FROM ke)"
_JOINED = "u AS (SELECT src AS a, dst AS b FROM ke UNION SELECT dst, src FROM ke), rr AS (SELECT DISTINCT a AS node, a AS least FROM u UNION SELECT u.b, rr.least FROM rr JOIN u ON u.a = rr.node), cc AS (SELECT node, min(least) AS component FROM rr GROUP BY node), cs AS (SELECT component, count(*) AS n FROM cc GROUP BY 1)"


@query("kg_metadata", f"WITH RECURSIVE {_KG}, {_ENDS}, {_JOINED}, f AS (SELECT count(*) AS n FROM kn), lo AS (SELECT count(*) AS n FROM kn WHERE node_id NOT IN (SELECT node FROM x)) SELECT f.n AS nodes, (SELECT count(*) FROM ke) AS edges, round((SELECT count(*) FROM x) / f.n::DOUBLE, 6) AS avg_degree, lo.n AS orphans, (SELECT count(*) FROM cs) + lo.n AS components, (SELECT max(n) FROM cs) AS largest_component, round(2.0 * (SELECT count(*) FROM ke) / (f.n * (f.n - 1)), 6) AS density FROM f, lo")
def kg_metadata(spark, d):
    nodes, edges = built(spark, d)
    m = R.graph_metadata(edges, nodes)
    return m.select("nodes", "edges", F.round("avg_degree", 6).alias("avg_degree"), "orphans", "components", F.col("largest_component").cast("long").alias("largest_component"), F.round("density", 6).alias("density"))


@query("kg_issues", f"""WITH RECURSIVE {_KG}, {_ENDS}, {_JOINED}, lo AS (SELECT count(*) AS n FROM kn WHERE node_id NOT IN (SELECT node FROM x)), dm AS (SELECT count(*) AS n FROM ke WHERE dst IN (SELECT node_id FROM kn WHERE node_type = 'cluster'))
SELECT code, n FROM (VALUES ('duplicate_nodes', 0), ('duplicate_edges', 0), ('self_loops', 0), ('invalid_confidence', 0), ('invalid_weight', 0), ('missing_metadata', 0), ('broken_references', 0), ('unknown_types', 0), ('empty_nodes', 0), ('empty_edges', 0), ('cycles', 0)) t(code, n)
UNION ALL SELECT 'orphan_edges', dm.n FROM dm UNION ALL SELECT 'orphan_nodes', lo.n FROM lo UNION ALL SELECT 'components', (SELECT count(*) FROM cs) + lo.n FROM lo""")
def kg_issues(spark, d):
    """The graph with its clusters left out of the nodes but not of the edges: those edges have lost an end."""
    nodes, edges = built(spark, d)
    found = K.issues(nodes.where("node_type != 'cluster'"), edges)
    return found.select("code", "n")


@query("kg_search", f"WITH {_KG} SELECT 'label' AS how, {_id('evidence', 'evidence.parquet', 'evidence_id')} AS node_id FROM e WHERE contains(lower(signal_text), 'quality') OR contains(lower(signal_text), 'issue') UNION ALL SELECT 'filter', {_id('evidence', 'evidence.parquet', 'evidence_id')} FROM e WHERE category = 'Quality' OR category IS NULL UNION ALL SELECT 'sure', {_id('evidence', 'evidence.parquet', 'evidence_id')} FROM e WHERE confidence >= 0.4")
def kg_search(spark, d):
    """Evidence by its label, by a property that may be missing, and by confidence."""
    nodes = built(spark, d)[0].where("node_type = 'evidence'")
    hit = lambda df, how: df.select(F.lit(how).alias("how"), "node_id")
    labels = K.by_label(nodes, "QUALITY").unionByName(K.by_label(nodes, "issue")).dropDuplicates(["node_id"])
    return hit(labels, "label").unionByName(hit(K.by_filters(nodes, "evidence", category="Quality"), "filter")).unionByName(hit(K.sure_nodes(nodes, 0.4), "sure"))


@query("kg_cluster_members", f"WITH {_KG} SELECT {_id('evidence', 'evidence.parquet', 'm')} AS node FROM km WHERE cluster_id = (SELECT min(cluster_id) FROM kc)")
def kg_cluster_members(spark, d):
    nodes, edges = built(spark, d)
    first = nodes.where("node_type = 'cluster'").orderBy("source_id").first()
    return K.members(edges, first["node_id"] if first else "")


@query("kg_similar", f"WITH {_KG}, p AS (SELECT max(dst) AS p FROM ke WHERE type = 'similar_to'), b AS (SELECT dst AS node, weight FROM ke, p WHERE type = 'similar_to' AND src = p UNION ALL SELECT src, weight FROM ke, p WHERE type = 'similar_to' AND dst = p) SELECT node, round(weight, 6) AS weight FROM b ORDER BY b.weight DESC, node LIMIT 10")
def kg_similar(spark, d):
    edges = built(spark, d)[1]
    last = edges.where("type = 'similar_to'").agg(F.max("dst")).first()[0]
    return K.similar(edges, last or "").withColumn("weight", F.round("weight", 6))


# ---- a typed graph of customers, suppliers, parts, nations and regions

_T = """tn AS (SELECT 'c' || c_custkey AS node_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'problem_signal' ELSE 'observation' END AS node_type, c_name AS label, 0.5 + (c_custkey % 6) / 10.0 AS confidence, 'customer.parquet' AS source_asset FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'company', s_name, (s_suppkey % 10) / 10.0, 'supplier.parquet' FROM supplier UNION ALL SELECT 'p' || p_partkey, 'product', p_name, p_size / 50.0, 'part.parquet' FROM part
 UNION ALL SELECT 'n' || n_nationkey, 'category', n_name, 0.9, 'nation.parquet' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'topic', r_name, 0.95, 'region.parquet' FROM region),
te AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'belongs_to' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'belongs_to' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'belongs_to' FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'causes' FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'causes' FROM nation
 UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'references' FROM lineitem)"""


def typed(spark, d):
    t = lambda name: table(spark, d, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    node = lambda df, prefix, c, kind, label, conf, asset: df.select(key(prefix, c).alias("node_id"), kind.alias("node_type"), F.col(label).alias("label"), conf.cast("double").alias("confidence"), F.lit(asset).alias("source_asset"))
    edge = lambda df, a, ac, b, bc, kind: df.select(key(a, ac).alias("src"), key(b, bc).alias("dst"), F.lit(kind).alias("type"))
    c, s, p, n, r = (t(x) for x in ("customer", "supplier", "part", "nation", "region"))
    nodes = node(c, "c", "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "problem_signal").otherwise("observation"), "c_name", 0.5 + (F.col("c_custkey") % 6) / 10.0, "customer.parquet")
    nodes = nodes.unionByName(node(s, "s", "s_suppkey", F.lit("company"), "s_name", (F.col("s_suppkey") % 10) / 10.0, "supplier.parquet")).unionByName(node(p, "p", "p_partkey", F.lit("product"), "p_name", F.col("p_size") / 50.0, "part.parquet"))
    nodes = nodes.unionByName(node(n, "n", "n_nationkey", F.lit("category"), "n_name", F.lit(0.9), "nation.parquet")).unionByName(node(r, "r", "r_regionkey", F.lit("topic"), "r_name", F.lit(0.95), "region.parquet"))
    edges = edge(c, "c", "c_custkey", "n", "c_nationkey", "belongs_to").unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey", "belongs_to")).unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey", "belongs_to"))
    edges = edges.unionByName(edge(c.where("c_mktsegment != 'MACHINERY'"), "n", "c_nationkey", "c", "c_custkey", "causes")).unionByName(edge(n, "r", "n_regionkey", "n", "n_nationkey", "causes"))
    return nodes, edges.unionByName(edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "s", "l_suppkey", "p", "l_partkey", "references"))


_TRANSITIVE = f"""{_T}, td AS (SELECT DISTINCT src, dst, type FROM te WHERE type IN ('causes', 'depends_on', 'contains', 'belongs_to', 'derived_from', 'references')),
t1 AS (SELECT a.type, a.src AS a, a.dst AS b, b.dst AS c, x.confidence * y.confidence * z.confidence AS conf FROM td a JOIN td b ON a.dst = b.src AND a.type = b.type JOIN tn x ON x.node_id = a.src JOIN tn y ON y.node_id = a.dst JOIN tn z ON z.node_id = b.dst WHERE a.src <> b.dst),
i1 AS (SELECT sha256('transitive:' || type || ':' || a || ':' || b || ':' || c || ':1.0') AS inference_id, 'transitive_closure' AS rule, a AS src, c AS dst, round(CAST(conf AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence FROM t1 WHERE conf >= 0.15),
s2 AS (SELECT te.dst, count(*) AS n, avg((x.confidence + y.confidence) / 2) AS conf, string_agg(te.src, ':' ORDER BY te.src) AS srcs, avg(CASE WHEN x.confidence * y.confidence > 0 THEN x.confidence * y.confidence END) AS prod FROM te JOIN tn x ON x.node_id = te.src JOIN tn y ON y.node_id = te.dst WHERE type = 'references' GROUP BY 1),
i2 AS (SELECT sha256('evidence_convergence:' || dst || ':' || srcs || ':1.0') AS inference_id, 'evidence_convergence' AS rule, NULL::VARCHAR AS src, dst, round(CAST(conf AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence FROM s2 WHERE n >= 2 AND conf >= 0.15),
p3 AS (SELECT e.dst AS effect, e.src AS mid, f.src AS root, x.confidence * y.confidence * y.confidence * z.confidence AS conf FROM te e JOIN te f ON f.dst = e.src AND f.type = 'causes' JOIN tn x ON x.node_id = e.dst JOIN tn y ON y.node_id = e.src JOIN tn z ON z.node_id = f.src WHERE e.type = 'causes' AND x.node_type = 'problem_signal'),
i3 AS (SELECT sha256('causal:' || effect || ':' || root || ':' || effect || '_' || mid || '_' || root || ':1.0') AS inference_id, 'causal_chain' AS rule, root AS src, effect AS dst, round(CAST(conf AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence FROM p3)"""


@query("rule_engine", f"WITH {_TRANSITIVE} SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3")
def rule_engine(spark, d):
    return R.infer(*typed(spark, d)).select("inference_id", "rule", "src", "dst", "confidence")


@query("reasoning_steps", f"WITH {_TRANSITIVE}, a AS (SELECT sha256('causal:' || effect || ':' || root || ':' || effect || '_' || mid || '_' || root || ':1.0') AS inference_id, [effect, mid, root] AS p FROM p3) SELECT sha256('chain:' || inference_id || ':1.0') AS chain_id, inference_id, i - 1 AS step_id, p[i] AS input FROM (SELECT *, unnest(range(1, 4)) AS i FROM a)")
def reasoning_steps(spark, d):
    return R.steps(R.rule_causal(*typed(spark, d))).select("chain_id", "inference_id", F.col("step_id").cast("long").alias("step_id"), "input")


_CAUSES = f"""{_TRANSITIVE}, im AS (SELECT 'r' || n_regionkey AS root, count(DISTINCT n_nationkey) + count(DISTINCT CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END) AS impact FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
rc AS (SELECT root AS cause, effect, 2 AS path_length, round(CAST(conf AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence, impact, 0 AS evidence FROM p3 JOIN im USING (root))"""


@query("typed_root_causes", f"WITH {_CAUSES} SELECT *, round(CAST(impact / (SELECT max(impact) FROM rc)::DOUBLE * confidence * 0.5 AS DECIMAL(18, 9)), 4)::DOUBLE AS score FROM rc")
def typed_root_causes(spark, d):
    return R.causes(*typed(spark, d)).select("cause", "effect", "path_length", "confidence", "impact", "evidence", "score")


@query("evidence_aggregation", f"WITH {_TRANSITIVE}, ne AS (SELECT DISTINCT * FROM (SELECT dst AS c, src AS o, 'in' AS w FROM te UNION ALL SELECT src, dst, 'out' FROM te)), cf AS (SELECT c, count(*) AS n FROM ne JOIN tn ON node_id = o WHERE confidence < 0.3 GROUP BY 1) SELECT dst AS conclusion, s2.n AS evidence_count, round(CAST(coalesce(prod, 0) AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence, coalesce(cf.n, 0) AS conflicting FROM s2 LEFT JOIN cf ON c = dst WHERE s2.n >= 2")
def evidence_aggregation(spark, d):
    return R.aggregate_evidence(*typed(spark, d))


@query("path_propagation", f"WITH {_TRANSITIVE} SELECT effect, round(conf, 6) AS multiplicative, round(least(cx, 0.9, 0.95), 6) AS minimum, round(cx * 0.81, 6) AS decay, round(((cx + 0.9) / 2 + (0.9 + 0.95) / 2 / 2) / 1.5, 6) AS weighted_average FROM (SELECT p3.*, confidence AS cx FROM p3 JOIN tn ON node_id = effect)")
def path_propagation(spark, d):
    """The four ways to carry confidence along the same paths."""
    nodes, edges = typed(spark, d)
    nodes = materialise(nodes, "typed-nodes")
    paths = materialise(R.rule_causal(nodes, edges).select(F.col("dst").alias("effect"), F.col("provenance").alias("path")), "typed-paths")
    out = paths
    for how in ("multiplicative", "minimum", "decay", "weighted_average"):
        out = out.join(R.along(paths, nodes, how).select("effect", F.round("confidence", 6).alias(how)), "effect")
    return out.drop("path")


@query("typed_neighbours", f"WITH RECURSIVE {_T}, b AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT te.src, depth + 1 FROM b JOIN te ON te.dst = b.node AND type = 'belongs_to' WHERE depth < 1) SELECT 'in' AS way, node, depth::INTEGER AS depth FROM b WHERE depth > 0 UNION ALL SELECT 'out', dst, 1 FROM te WHERE src = 'n3' AND type = 'causes'")
def typed_neighbours(spark, d):
    _, edges = typed(spark, d)
    way = lambda direction, kind: G.neighbourhood(edges, "n3", 1, direction, (kind,)).select(F.lit(direction).alias("way"), "node", "depth")
    return way("in", "belongs_to").unionByName(way("out", "causes"))


# ---- what lies around a problem

_HOOD = f"""{_T}, tu AS (SELECT src AS a, dst AS b FROM te WHERE type = 'belongs_to' UNION SELECT dst, src FROM te WHERE type = 'belongs_to'), pr AS (SELECT 'n' || n_nationkey AS problem FROM nation),
w AS (SELECT problem, problem AS node, 0 AS depth FROM pr UNION SELECT problem, tu.b, depth + 1 FROM w JOIN tu ON tu.a = w.node WHERE depth < 3), wm AS (SELECT problem, node, min(depth) AS depth FROM w GROUP BY ALL),
hd AS (SELECT problem, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY depth, node) AS rn FROM wm) WHERE rn <= 50)"""


def hoods(spark, d):
    nodes, edges = typed(spark, d)
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("problem"))
    return nodes, edges, O.neighbourhoods(edges.where("type = 'belongs_to'"), nations, 50, 3)


@query("neighbourhoods", f"WITH RECURSIVE {_HOOD} SELECT problem, node, depth::INTEGER AS depth FROM hd")
def neighbourhoods(spark, d):
    return hoods(spark, d)[2]


@query("affected_entities", f"""WITH RECURSIVE {_HOOD}, nb AS (SELECT DISTINCT src AS node, source_asset FROM (SELECT src, dst FROM te UNION ALL SELECT dst, src FROM te) x JOIN tn ON node_id = dst), sp AS (SELECT problem, count(DISTINCT source_asset) AS n FROM hd JOIN nb USING (node) GROUP BY 1)
SELECT problem, coalesce(string_agg(DISTINCT CASE WHEN node_type = 'company' THEN label END, ',' ORDER BY CASE WHEN node_type = 'company' THEN label END), '') AS companies, count(DISTINCT CASE WHEN node_type = 'product' THEN label END) AS products, greatest(coalesce(any_value(sp.n), 0), 1) AS platform_count FROM hd JOIN tn ON node_id = node LEFT JOIN sp USING (problem) GROUP BY problem""")
def affected_entities(spark, d):
    nodes, edges, around = hoods(spark, d)
    a = O.around(around, nodes, edges)
    return a.select("problem", F.array_join("affected_companies", ",").alias("companies"), F.size("affected_products").cast("long").alias("products"), "platform_count")


@query("linked_candidates", f"WITH {_TRANSITIVE}, ev AS (SELECT dst FROM s2 WHERE n >= 2), cl AS (SELECT 'p' || p_partkey AS node, p_brand AS cluster, (p_size % 10) / 10.0 AS density FROM part) SELECT 'p' || p_partkey AS key, CASE WHEN ev.dst IS NULL THEN 0 ELSE 1 END AS evidence_count, p_brand AS clusters, round(density, 6) AS cluster_density FROM part JOIN cl ON cl.node = 'p' || p_partkey LEFT JOIN ev ON ev.dst = 'p' || p_partkey")
def linked_candidates(spark, d):
    """Parts as problems, with the evidence and the brands (as clusters) they belong to."""
    nodes, edges = typed(spark, d)
    part = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), "p_brand", "p_size")
    found = O.linked(part.select("key", F.array("key").alias("path")), R.aggregate_evidence(nodes, edges), part.select(F.col("key").alias("node"), F.col("p_brand").alias("cluster"), ((F.col("p_size") % 10) / 10.0).alias("density")))
    return found.select("key", F.col("evidence_count").cast("int").alias("evidence_count"), F.array_join("cluster_ids", ",").alias("clusters"), F.round("cluster_density", 6).alias("cluster_density"))
