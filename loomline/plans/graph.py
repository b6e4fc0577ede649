"""Queries: vectors, relationships, clusters, graph algorithms, rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomline.operators import graph as G, reasoning as R, vectors as V
from loomline.operators.components import connected_components
from loomline.plans.registry import query, table
from loomline.session import materialise

# ---- vectors

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_NN = f"""{_E}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS target_id, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, target_id) AS rn FROM s) WHERE rn <= 6)"""
_REL = f"""{_NN}, r0 AS (SELECT query_id, target_id, least(greatest(score, 0.0), 1.0) AS score FROM n WHERE query_id <> target_id),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(query_id, target_id), greatest(query_id, target_id) ORDER BY query_id, target_id) AS rn FROM r0) WHERE rn = 1),
r AS (SELECT query_id AS source_id, target_id, score AS similarity FROM r1 WHERE score >= 0.2)"""


def vectors(spark, d):
    return table(spark, d, "embeddings")


def neighbours(spark, d):
    e = vectors(spark, d)
    return V.top_k(e, e, 6)


def rel(spark, d):
    return V.relationships(neighbours(spark, d), 0.2)


@query("knn_top_k", f"WITH {_NN} SELECT query_id, target_id, round(score, 6) AS score FROM n")
def knn_top_k(spark, d):
    return neighbours(spark, d).select("query_id", "target_id", F.round("score", 6).alias("score"))


@query("vector_metrics", f"WITH {_E} SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(1 - list_distance(a.v, b.v) / sqrt(4.0 * len(a.v)), 6) AS euclidean FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_metrics(spark, d):
    a = vectors(spark, d).select("vec_id", F.col("embedding").alias("x"))
    b = vectors(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select("vec_id", F.round(V.dot(x, y), 6).alias("dot"), F.round(V.cosine(x, y), 6).alias("cosine"), F.round(V.euclidean(x, y), 6).alias("euclidean"))


@query("unit_vectors", f"WITH {_E} SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e")
def unit_vectors(spark, d):
    return vectors(spark, d).select("vec_id", F.round(F.get(V.unit(F.col("embedding")), F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("embedding_statistics", f"WITH {_E} SELECT count(*) AS n, max(len(v)) AS dimension, round(avg(sqrt(list_inner_product(v, v))), 6) AS mean_norm, round(stddev_pop(sqrt(list_inner_product(v, v))), 6) AS std_norm, count(*) FILTER (WHERE sqrt(list_inner_product(v, v)) < 1e-10) AS zero, count(*) - count(DISTINCT v) AS duplicates FROM e")
def embedding_statistics(spark, d):
    e = vectors(spark, d).select("embedding", V.norm(F.col("embedding")).alias("n"))
    return e.agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.stddev_pop("n"), 6).alias("std_norm"), F.count_if(F.col("n") < 1e-10).alias("zero"), (F.count("*") - F.count_distinct("embedding")).alias("duplicates"))


@query("embedding_ids", "SELECT vec_id, sha256(vec_id::VARCHAR || '|local|hashed|1.0') AS embedding_id FROM embeddings")
def embedding_ids(spark, d):
    return vectors(spark, d).select("vec_id", F.sha2(F.concat_ws("|", F.col("vec_id").cast("string"), F.lit("local"), F.lit("hashed"), F.lit("1.0")), 256).alias("embedding_id"))


@query("relationships", f"WITH {_REL} SELECT source_id, target_id, round(similarity, 6) AS similarity, sha256(least(source_id::VARCHAR, target_id::VARCHAR) || '|' || greatest(source_id::VARCHAR, target_id::VARCHAR) || '|cosine|1.0') AS relationship_id FROM r")
def relationships(spark, d):
    return rel(spark, d).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"), V.relationship_id(F.col("source_id"), F.col("target_id"), "cosine").alias("relationship_id"))


@query("relationship_policy", f"WITH {_REL} SELECT r.source_id, r.target_id FROM r JOIN embeddings a ON a.vec_id = r.source_id JOIN embeddings b ON b.vec_id = r.target_id WHERE (a.label % 2, b.label % 2) IN ((0, 0), (0, 1))")
def relationship_policy(spark, d):
    kind = vectors(spark, d).select("vec_id", (F.col("label") % 2).alias("kind"))
    e = rel(spark, d).join(kind.select(F.col("vec_id").alias("source_id"), F.col("kind").alias("a")), "source_id").join(kind.select(F.col("vec_id").alias("target_id"), F.col("kind").alias("b")), "target_id")
    allowed = spark.createDataFrame([(0, 0), (0, 1)], "a int, b int")
    return e.join(F.broadcast(allowed), ["a", "b"], "left_semi").select("source_id", "target_id")


@query("relationship_statistics", f"WITH {_REL}, x AS (SELECT source_id AS x FROM r UNION SELECT target_id FROM r) SELECT count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets, count(*) AS pairs, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS std, (SELECT count(*) FROM x) AS nodes, round(count(*) / ((SELECT count(*) FROM x) * ((SELECT count(*) FROM x) - 1) / 2), 6) AS density FROM r")
def relationship_statistics(spark, d):
    s = V.statistics(rel(spark, d))
    return s.select("n", "sources", "targets", "pairs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "nodes", F.round("density", 6).alias("density"))


@query("threshold_recommendation", f"WITH {_REL} SELECT round(quantile_cont(similarity, 0.5), 6) AS p50, round(quantile_cont(similarity, 0.95), 6) AS p95, count(*) FILTER (WHERE similarity >= 0.3) AS at_30, count(*) FILTER (WHERE similarity >= 0.5) AS at_50 FROM r")
def threshold_recommendation(spark, d):
    t = V.thresholds(rel(spark, d), [0.3, 0.5])
    return t.select(F.round(F.get("p", F.lit(0)), 6).alias("p50"), F.round(F.get("p", F.lit(3)), 6).alias("p95"), "at_30", "at_50")


@query("relationship_confidence", f"WITH {_REL}, f AS (SELECT source_id, count(*) AS n FROM r GROUP BY 1) SELECT r.source_id, target_id, round(exp((ln(least(greatest(similarity, 1e-9), 1.0)) * 1.0 + ln(least(greatest(least(1.0, ln(1 + n::DOUBLE) / ln(100.0)), 1e-9), 1.0)) * 0.5) / 1.5), 6) AS confidence FROM r JOIN f ON f.source_id = r.source_id")
def relationship_confidence(spark, d):
    r = rel(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("source_id")))
    return r.select("source_id", "target_id", F.round(V.confidence([(F.col("similarity"), 1.0), (V.frequency_factor(F.col("n")), 0.5)]), 6).alias("confidence"))


@query("related_items", f"WITH {_REL} SELECT id, other FROM (SELECT source_id AS id, target_id AS other FROM r UNION SELECT target_id, source_id FROM r)")
def related_items(spark, d):
    r = rel(spark, d)
    return r.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(r.select("target_id", "source_id")).distinct().orderBy("id", "other")


@query("relationship_lookup", f"WITH {_REL}, p AS (SELECT min(source_id) AS s FROM r) SELECT source_id, target_id, round(similarity, 6) AS similarity FROM r, p WHERE source_id = s OR target_id = s ORDER BY similarity DESC, source_id, target_id LIMIT 5")
def relationship_lookup(spark, d):
    r = materialise(rel(spark, d), "lookup")
    return V.lookup(r, either=r.agg(F.min("source_id")).first()[0], top=5).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


_CONFIDENT = f"{_REL}, f AS (SELECT source_id, count(*) AS n FROM r GROUP BY 1), q AS (SELECT r.*, exp((ln(least(greatest(similarity, 1e-9), 1.0)) + ln(least(greatest(least(1.0, ln(1 + n::DOUBLE) / ln(100.0)), 1e-9), 1.0)) * 0.5) / 1.5) AS confidence FROM r JOIN f USING (source_id))"


@query("filter_pipeline", f"WITH {_CONFIDENT} SELECT 0 AS ordinal, 'similarity' AS stage, count(*) FILTER (WHERE similarity < 0.25) AS removed, count(*) FILTER (WHERE similarity >= 0.25) AS left FROM q UNION ALL SELECT 1, 'confidence', count(*) FILTER (WHERE confidence < 0.32), count(*) FILTER (WHERE confidence >= 0.32) FROM q WHERE similarity >= 0.25")
def filter_pipeline(spark, d):
    r = rel(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("source_id")))
    r = r.withColumn("confidence", V.confidence([(F.col("similarity"), 1.0), (V.frequency_factor(F.col("n")), 0.5)]))
    return V.filter_pipeline(r, [("similarity", lambda e: e.where("similarity >= 0.25")), ("confidence", lambda e: V.confident(e, 0.32))])[1]


@query("embedding_verification", f"WITH {_E} SELECT count(*) AS n, count(*) FILTER (WHERE abs(sqrt(list_inner_product(v, v)) - 1) > 0.1) AS not_unit, count(*) - count(DISTINCT vec_id) AS repeated_ids, count(DISTINCT label % 1) AS runs, count(*) FILTER (WHERE abs(sqrt(list_inner_product(v, v)) - 1) > 0.1) = 0 AS valid FROM e")
def embedding_verification(spark, d):
    return V.verify(vectors(spark, d).withColumn("run", F.col("label") % 1), "vec_id", "embedding", "run", 0.1)


@query("hashed_embeddings")
def hashed_embeddings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return V.embed(docs, docs.where("doc_id % 10 = 0"), "hashed", "doc_id")


# ---- clusters

_CC = """u AS (SELECT source_id AS a, target_id AS b FROM r WHERE similarity >= 0.4 UNION SELECT target_id, source_id FROM r WHERE similarity >= 0.4),
reach AS (SELECT DISTINCT a AS node, a AS least FROM u UNION SELECT u.b, reach.least FROM reach JOIN u ON u.a = reach.node),
c AS (SELECT node, min(least) AS component FROM reach GROUP BY node)"""


def strong(spark, d):
    return edges_of(spark, d).where("weight >= 0.4")


def edges_of(spark, d):
    return rel(spark, d).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("similarity").alias("weight"))


@query("similarity_components", f"WITH RECURSIVE {_REL}, {_CC} SELECT node, component FROM c")
def similarity_components(spark, d):
    return connected_components(strong(spark, d))


@query("clusters_by_size", f"WITH RECURSIVE {_REL}, {_CC} SELECT node, component, size FROM c JOIN (SELECT component, count(*) AS size FROM c GROUP BY 1 HAVING count(*) BETWEEN 3 AND 500) USING (component)")
def clusters_by_size(spark, d):
    return G.clusters(strong(spark, d))


_METRICS = f"""{_REL}, {_CC}, z AS (SELECT component, count(*) AS size FROM c GROUP BY 1 HAVING count(*) BETWEEN 3 AND 500), cz AS (SELECT node, component, size FROM c JOIN z USING (component)),
ew AS (SELECT similarity, a.component AS ca, b.component AS cb FROM r LEFT JOIN cz a ON a.node = r.source_id LEFT JOIN cz b ON b.node = r.target_id),
i AS (SELECT ca AS component, count(*) AS internal_edges, avg(similarity) AS m FROM ew WHERE ca = cb GROUP BY 1),
x AS (SELECT component, count(*) AS external_edges, avg(similarity) AS lv FROM (SELECT ca AS component, similarity FROM ew WHERE ca IS NOT NULL AND ca IS DISTINCT FROM cb UNION ALL SELECT cb, similarity FROM ew WHERE cb IS NOT NULL AND ca IS DISTINCT FROM cb) GROUP BY 1),
mt AS (SELECT component, size, internal_edges, coalesce(external_edges, 0) AS external_edges, m AS average_similarity, internal_edges / (size * (size - 1) / 2) AS density, coalesce(1 - lv, 1.0) AS separation, 2.0 * internal_edges / size / (size - 1) AS connectivity FROM z JOIN i USING (component) LEFT JOIN x USING (component)),
mq AS (SELECT *, least(1.0, greatest(0.0, average_similarity * 0.35 + density * 0.25 + separation * 0.2 + connectivity * 0.2)) AS quality FROM mt)"""


def metrics_of(spark, d):
    """Clusters over strong edges, measured over all relationships."""
    e = materialise(edges_of(spark, d), "cluster-edges")
    return G.cluster_metrics(e, G.clusters(e.where("weight >= 0.4")))


@query("cluster_metrics", f"WITH RECURSIVE {_METRICS} SELECT component, size, internal_edges, external_edges, round(average_similarity, 6) AS average_similarity, round(density, 6) AS density, round(separation, 6) AS separation, round(connectivity, 6) AS connectivity, round(quality, 6) AS quality FROM mq")
def cluster_metrics(spark, d):
    m = metrics_of(spark, d)
    return m.select("component", "size", "internal_edges", "external_edges", *[F.round(c, 6).alias(c) for c in ("average_similarity", "density", "separation", "connectivity", "quality")])


@query("cluster_statistics", f"WITH RECURSIVE {_METRICS} SELECT count(*) AS clusters, sum(size)::BIGINT AS members, sum(internal_edges)::BIGINT AS edges, round(avg(size), 6) AS mean_size, quantile_cont(size, 0.5)::DOUBLE AS median_size, min(size) AS least_size, max(size) AS most_size, round(avg(density), 6) AS mean_density, round(avg(quality), 6) AS mean_quality FROM mq")
def cluster_statistics(spark, d):
    s = G.cluster_statistics(metrics_of(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_size", "mean_density", "mean_quality")})


@query("cluster_quality_bins", f"WITH RECURSIVE {_METRICS} SELECT printf('%.1f-%.1f', b, b + 0.1) AS bin, count(*) AS n FROM (SELECT least(floor(round(quality * 10, 9)), 9) / 10 AS b FROM mq) GROUP BY 1")
def cluster_quality_bins(spark, d):
    return G.quality_bins(metrics_of(spark, d))


@query("cluster_issues", f"""WITH RECURSIVE {_REL}, {_CC}, z AS (SELECT component, count(*) AS size FROM c GROUP BY 1), x AS (SELECT node FROM c JOIN z USING (component) WHERE node % 7 = 0)
SELECT 'MIN_SIZE_VIOLATION' AS code, 'ERROR' AS severity, component::VARCHAR AS cluster, NULL::VARCHAR AS node FROM z WHERE size < 3
UNION ALL SELECT 'MAX_SIZE_VIOLATION', 'ERROR', component::VARCHAR, NULL FROM z WHERE size > 5
UNION ALL SELECT 'MISSING_REPRESENTATIVE', 'ERROR', component::VARCHAR, NULL FROM z WHERE component % 2 = 1
UNION ALL SELECT 'ORPHAN_MEMBER_ID', 'ERROR', component::VARCHAR, node::VARCHAR FROM c WHERE node NOT IN (SELECT source_id FROM r WHERE similarity >= 0.42 UNION SELECT target_id FROM r WHERE similarity >= 0.42)
UNION ALL SELECT 'DISCONNECTED_CLUSTER', 'WARN', component::VARCHAR, NULL FROM z WHERE component NOT IN (SELECT a.component FROM r JOIN c a ON a.node = r.source_id JOIN c b ON b.node = r.target_id WHERE similarity >= 0.42 AND a.component = b.component)""")
def cluster_issues(spark, d):
    """Clusters over edges of 0.4, held against a graph of edges of 0.42, with no representative for odd ones."""
    e = materialise(edges_of(spark, d), "issue-edges")
    m = connected_components(e.where("weight >= 0.4")).select("node", F.col("component").alias("cluster"))
    reps = m.where("cluster % 2 = 0").groupBy("cluster").agg(F.min("node").alias("representative"))
    return G.cluster_issues(m, e.where("weight >= 0.42"), reps, 3, 5).withColumn("cluster", F.col("cluster").cast("string"))


@query("cluster_lookup", f"WITH RECURSIVE {_REL}, {_CC}, w AS (SELECT component FROM c WHERE node = (SELECT max(node) FROM c)) SELECT component AS cluster, node FROM c WHERE component IN (SELECT component FROM w)")
def cluster_lookup(spark, d):
    """The cluster that holds the last node."""
    m = materialise(G.communities("connected_components", strong(spark, d)), "lookup")
    return G.find_clusters(m, m.select("cluster", F.col("cluster").alias("representative")).distinct(), member=m.agg(F.max("node")).first()[0])


@query("cluster_representatives")
def cluster_representatives(spark, d):
    e = strong(spark, d)
    return G.representatives(e, G.clusters(e))


@query("cluster_ids", f"WITH RECURSIVE {_REL}, {_CC} SELECT component, sha256(string_agg(node::VARCHAR, '|' ORDER BY node::VARCHAR) || '|cc|1.0|cc') AS cluster_id FROM c GROUP BY component HAVING count(*) BETWEEN 3 AND 500")
def cluster_ids(spark, d):
    m = G.clusters(strong(spark, d))
    names = F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), "|")  # a cluster's size is bounded
    return m.groupBy("component").agg(F.sha2(F.concat(names, F.lit("|cc|1.0|cc")), 256).alias("cluster_id"))


@query("average_linkage_clusters")
def average_linkage_clusters(spark, d):
    e = strong(spark, d)
    return G.average_linkage(e, G.clusters(e, 2, 500), 0.25)


@query("post_processed_clusters")
def post_processed_clusters(spark, d):
    e = edges_of(spark, d)
    return G.post_process(connected_components(e.where("weight >= 0.4")).select("node", F.col("component").alias("cluster")), e)


@query("merged_small_clusters")
def merged_small_clusters(spark, d):
    e = strong(spark, d)
    return G.merge_small(G.average_linkage(e, G.clusters(e, 2, 500), 0.25), e, 4)


# ---- graph algorithms on customers: as many nodes as there are, up to five edges out of each

_G = "g AS (SELECT o_custkey AS src, (o_custkey * 7 + o_orderkey % 5) % (SELECT max(o_custkey) + 1 FROM orders) AS dst, count(*)::DOUBLE AS weight FROM orders GROUP BY ALL)"


def graph(spark, d):
    o = table(spark, d, "orders")
    o = o.join(F.broadcast(o.agg((F.max("o_custkey") + 1).alias("m"))))  # one row
    return o.groupBy(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % F.col("m")).alias("dst")).agg(F.count("*").cast("double").alias("weight"))


@query("graph_bfs", f"WITH RECURSIVE {_G}, b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT g.dst, b.depth + 1 FROM b JOIN g ON g.src = b.node WHERE b.depth < 3) SELECT node, min(depth)::INTEGER AS depth FROM b GROUP BY node")
def graph_bfs(spark, d):
    return G.reach(graph(spark, d), spark.createDataFrame([(1,)], "node long"), 3)


@query("graph_components", f"WITH RECURSIVE {_G}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r AS (SELECT DISTINCT a AS node, a AS least FROM u UNION SELECT u.b, r.least FROM r JOIN u ON u.a = r.node) SELECT node, min(least) AS component FROM r GROUP BY node")
def graph_components(spark, d):
    return connected_components(graph(spark, d))


@query("degree_centrality", f"WITH {_G}, v AS (SELECT src AS node FROM g UNION SELECT dst FROM g) SELECT node, round(count(*) / ((SELECT count(*) FROM v) - 1)::DOUBLE, 9) AS score FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node ORDER BY score DESC, node LIMIT 20")
def degree_centrality(spark, d):
    return G.degree_centrality(graph(spark, d), 20).withColumn("score", F.round("score", 9))


@query("degree_distribution", f"WITH {_G} SELECT degree, count(*) AS n FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node) GROUP BY degree")
def degree_distribution(spark, d):
    return G.degrees(graph(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


def _rank_sql(rounds: int) -> str:
    steps = ["v0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"v{i} AS (SELECT v.node, (1 - 0.85) / (SELECT count(*) FROM v) + 0.85 * coalesce(f.s, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / deg) AS s FROM x JOIN v{i - 1} ON node = src JOIN q USING (src) GROUP BY dst) f ON f.dst = v.node)")
    return f"WITH {_G}, x AS (SELECT DISTINCT src, dst FROM g), q AS (SELECT src, count(*) AS deg FROM x GROUP BY src), v AS (SELECT src AS node FROM g UNION SELECT dst FROM g), {', '.join(steps)} SELECT node, round(rank, 8) AS rank FROM v{rounds}"


@query("pagerank_4_rounds", _rank_sql(4))
def pagerank_4_rounds(spark, d):
    return G.pagerank(graph(spark, d), rounds=4, tolerance=0.0).select("node", F.round("rank", 8).alias("rank"))


@query("shortest_paths", f"""WITH RECURSIVE {_G}, p AS (SELECT [src, dst] AS path, dst, 1 AS n FROM g WHERE src = 1 UNION ALL SELECT list_append(path, g.dst), g.dst, n + 1 FROM p JOIN g ON g.src = p.dst WHERE n < 5 AND NOT list_contains(path, g.dst)),
m AS (SELECT min(n) AS n FROM p WHERE dst = 77) SELECT array_to_string(path, '>') AS path FROM p JOIN m USING (n) WHERE dst = 77""")
def shortest_paths(spark, d):
    return G.shortest_paths(graph(spark, d), 1, 77, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("simple_paths", f"WITH RECURSIVE {_G}, p AS (SELECT [src, dst] AS path, dst, 1 AS n FROM g WHERE src = 1 AND dst <> 1 UNION ALL SELECT list_append(path, g.dst), g.dst, n + 1 FROM p JOIN g ON g.src = p.dst WHERE n < 5 AND p.dst <> 77 AND NOT list_contains(path, g.dst)) SELECT array_to_string(path, '>') AS path FROM p WHERE dst = 77")
def simple_paths(spark, d):
    return G.simple_paths(graph(spark, d).where("src != dst"), 1, 77, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("common_neighbours", f"WITH {_G}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g) SELECT b AS node FROM u WHERE a = 7 INTERSECT SELECT b FROM u WHERE a = 8")
def common_neighbours(spark, d):
    u = G.undirected(graph(spark, d))
    return u.where("src = 7").select(F.col("dst").alias("node")).intersect(u.where("src = 8").select("dst"))


_DAG = "g AS (SELECT c_custkey + 1000 AS src, c_nationkey + 100 AS dst FROM customer UNION SELECT n_nationkey + 100, n_regionkey FROM nation)"


@query("topological_levels", f"WITH RECURSIVE {_DAG}, s AS (SELECT src AS node FROM g EXCEPT SELECT dst FROM g), p AS (SELECT node, 0 AS level FROM s UNION SELECT g.dst, level + 1 FROM p JOIN g ON g.src = p.node) SELECT node, max(level)::INTEGER AS level FROM p GROUP BY node")
def topological_levels(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return G.topological_levels(c.unionByName(n))[0]


@query("strongly_connected", f"WITH RECURSIVE {_G}, v AS (SELECT src AS n FROM g UNION SELECT dst FROM g), r AS (SELECT n AS a, n AS b FROM v UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def strongly_connected(spark, d):
    return G.strongly_connected(graph(spark, d))


@query("betweenness")
def betweenness(spark, d):
    return G.betweenness(graph(spark, d))


@query("induced_subgraph", f"WITH {_G}, k AS (SELECT c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING') SELECT src, dst, weight FROM g WHERE src IN (SELECT n FROM k) AND dst IN (SELECT n FROM k)")
def induced_subgraph(spark, d):
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("n"))
    g = graph(spark, d)
    return g.join(keep, F.col("src") == F.col("n"), "left_semi").join(keep, F.col("dst") == F.col("n"), "left_semi")


@query("without_nodes", f"WITH {_G}, k AS (SELECT c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING') SELECT src, dst, weight FROM g WHERE src NOT IN (SELECT n FROM k) AND dst NOT IN (SELECT n FROM k)")
def without_nodes(spark, d):
    return G.without_nodes(graph(spark, d), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node")))


@query("predecessors", f"WITH RECURSIVE {_G}, b AS (SELECT 77::BIGINT AS node, 0 AS depth UNION SELECT g.src, b.depth + 1 FROM b JOIN g ON g.dst = b.node WHERE b.depth < 2) SELECT node, min(depth)::INTEGER AS depth FROM b GROUP BY node HAVING min(depth) > 0")
def predecessors(spark, d):
    return G.neighbourhood(graph(spark, d), 77, 2, "in")


@query("depth_first_order")
def depth_first_order(spark, d):
    return G.depth_first(graph(spark, d).where("src < 400 and dst < 400"), 1)


_HEALTHY = "100.0 - greatest(0.0, (10000 - nodes) / 10000.0 * 20) - greatest(0.0, (20000 - edges) / 20000.0 * 20) - greatest(0.0, (0.5 - largest_ratio) / 0.5 * 20) - greatest(0.0, (8 - avg_degree) / 8.0 * 20)"


@query("graph_health", f"""WITH RECURSIVE {_G}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r AS (SELECT DISTINCT a AS node, a AS least FROM u UNION SELECT u.b, r.least FROM r JOIN u ON u.a = r.node), cc AS (SELECT node, min(least) AS component FROM r GROUP BY node),
d AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node), cs AS (SELECT component, count(*) AS n FROM cc GROUP BY 1),
m AS (SELECT (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT avg(k) FROM d) AS avg_degree, 2.0 * (SELECT count(*) FROM g) / ((SELECT count(*) FROM d) * ((SELECT count(*) FROM d) - 1)) AS density, (SELECT count(*) FROM cs) AS components, (SELECT max(n) FROM cs) / (SELECT count(*) FROM d)::DOUBLE AS largest_ratio)
SELECT nodes, edges, round(avg_degree, 6) AS avg_degree, round(density, 6) AS density, components, round(largest_ratio, 6) AS largest_ratio, round({_HEALTHY}, 2) AS score, CASE WHEN {_HEALTHY} >= 80 THEN 'healthy' WHEN {_HEALTHY} >= 50 THEN 'degraded' ELSE 'critical' END AS status FROM m""")
def graph_health(spark, d):
    m = R.health(R.graph_metadata(graph(spark, d)), {"nodes": 10000, "edges": 20000, "largest_ratio": 0.5, "avg_degree": 8})
    return m.select("nodes", "edges", *[F.round(c, 6).alias(c) for c in ("avg_degree", "density")], "components", F.round("largest_ratio", 6).alias("largest_ratio"), "score", "status")


# ---- rules

_CONF = "least(1.0, weight / 4.0)"


@query("rule_transitive", f"WITH {_G}, c AS (SELECT src, dst, {_CONF} AS conf FROM g WHERE src <> dst) SELECT a.src, b.dst, round(max(a.conf * b.conf), 6) AS confidence FROM c a JOIN c b ON a.dst = b.src WHERE a.src <> b.dst AND a.conf * b.conf >= 0.15 GROUP BY ALL")
def rule_transitive(spark, d):
    g = graph(spark, d).select("src", "dst", F.lit("relates").alias("type"), F.least(F.lit(1.0), F.col("weight") / 4.0).alias("confidence"))
    return R.transitive(g).select("src", "dst", F.round("confidence", 6).alias("confidence"))


@query("rule_convergence", f"WITH {_G}, c AS (SELECT src, dst, {_CONF} AS conf FROM g WHERE src <> dst) SELECT dst, count(DISTINCT src) AS sources, round(avg(conf), 6) AS confidence FROM c GROUP BY dst HAVING count(DISTINCT src) >= 2")
def rule_convergence(spark, d):
    g = graph(spark, d).select("src", "dst", F.lit("supports").alias("type"), F.least(F.lit(1.0), F.col("weight") / 4.0).alias("confidence"))
    return R.convergence(g).select("dst", "sources", F.round("confidence", 6).alias("confidence"))


@query("causal_chains", f"WITH {_DAG} SELECT c.src AS start, c.src || '>' || c.dst || '>' || n.dst AS chain FROM g c JOIN g n ON n.src = c.dst WHERE c.src >= 1000")
def causal_chains(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    chains = R.chains(c.unionByName(n), 8)
    return chains.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("chain"))


@query("root_causes", "SELECT root, impact, dense_rank() OVER (ORDER BY impact DESC)::INTEGER AS rank FROM (SELECT n_regionkey::BIGINT AS root, count(*) + count(DISTINCT n_nationkey) AS impact FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def root_causes(spark, d):
    """Regions as roots, with how many customers and nations lie below them."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    c = table(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    used = n.join(c.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return R.root_causes(used.unionByName(c), 4)


@query("path_confidence", f"WITH {_G}, c AS (SELECT src, dst, {_CONF} AS conf FROM g WHERE src <> dst) SELECT a.src, a.dst AS mid, b.dst, round(a.conf * b.conf, 6) AS multiplicative, round(least(a.conf, b.conf), 6) AS minimum, round(a.conf * 0.9, 6) AS decay, round((a.conf + b.conf) / 2, 6) AS mean FROM c a JOIN c b ON a.dst = b.src")
def path_confidence(spark, d):
    g = graph(spark, d).where("src != dst").select("src", "dst", F.least(F.lit(1.0), F.col("weight") / 4.0).alias("c"))
    p = g.alias("a").join(g.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("a.dst").alias("mid"), F.col("b.dst").alias("dst"), F.array("a.c", "b.c").alias("c"))
    return p.select("src", "mid", "dst", *[F.round(R.path_confidence(F.col("c"), m), 6).alias(m) for m in ("multiplicative", "minimum", "decay", "mean")])
