"""The knowledge graph: nodes and edges from the pipeline's assets, its search and its validation.

Nodes: node_id, node_type, label, properties, metadata, attributes (JSON), source_asset, source_id, confidence.
Edges: edge_id, src, dst, type, weight, confidence, metadata (JSON), source_asset. Both are hashes of what they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline.operators.components import connected_components
from loomline.operators.graph import degrees, has_cycle

# Versions that are part of every id.
PIPELINE_VERSION, SCHEMA_VERSION = "1.5.0", "1.0.0"
# Types that a graph may hold.
NODE_TYPES = (
    "document", "source", "observation", "entity", "keyword", "phrase", "pattern", "category", "product", "company", "technology", "feature", "problem_signal", "evidence", "cluster", "topic", "trend",
)
EDGE_TYPES = (
    "similar_to", "co_occurs", "next_to", "derived_from", "references", "mentions", "belongs_to", "contains", "member_of_cluster", "has_entity", "has_keyword", "has_pattern", "has_category", "causes",
    "blocks", "depends_on", "supported_by",
)
#: Of each kind of asset: its file, id columns, label columns (the first that is there), confidence columns, columns that are no property.
ASSETS = {
    "observation": ("observations.parquet", ("observation_id", "id"), ("text", "description"), ("confidence",), ("metadata",)),
    "evidence": ("evidence.parquet", ("evidence_id", "id"), ("text", "aggregated_text"), ("confidence",), ("metadata",)),
    "problem_signal": ("problem_signals.parquet", ("signal_id", "problem_signal_id", "id"), ("label", "name", "description"), ("confidence",), ("metadata",)),
    "cluster": ("semantic_clusters.parquet", ("cluster_id", "id"), ("representative_id",), ("quality_score", "confidence"), ("metadata",)),
}


def _first(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def node_id(kind: str, asset: str, source_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(kind), F.lit(asset), source_id, F.lit(PIPELINE_VERSION), F.lit(SCHEMA_VERSION)), 256)


def nodes_of(kind: str, df: DataFrame) -> DataFrame:
    """Nodes of one asset; a row without an id column has an empty id, one without a label its id as label."""
    asset, ids, labels, confidences, rest = ASSETS[kind]
    key, name, conf = _first(df, ids), _first(df, labels), _first(df, confidences)
    sid = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    label = F.coalesce(F.col(name).cast("string"), sid) if name else sid
    label = F.substring(F.concat(F.lit("Cluster: "), F.substring(label, 1, 50)), 1, 200) if kind == "cluster" else F.substring(label, 1, 200)
    own = [c for c in df.columns if c not in {key, name, conf, *rest} or c == "representative_id"]
    meta = F.to_json(F.struct(F.lit(asset).alias("source_asset"), sid.alias("source_id"), F.lit("").alias("run_id")))
    return df.select(
        node_id(kind, asset, sid).alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), (F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("properties"), meta.alias("metadata"),
        F.lit("{}").alias("attributes"), F.lit(asset).alias("source_asset"), sid.alias("source_id"), F.coalesce(F.col(conf).cast("double") if conf else F.lit(1.0), F.lit(1.0)).alias("confidence"),
    )


def build_nodes(assets: dict[str, DataFrame]) -> DataFrame:
    """Nodes of all assets that are there, one a node_id (of rows that repeat one, the last by content)."""
    out = None
    for kind, df in assets.items():
        part = nodes_of(kind, df)
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c != "node_id"]
    return out.groupBy("node_id").agg(F.max(F.struct(*rest)).alias("n")).select("node_id", "n.*")


def _edge(df: DataFrame, kind: Column, weight: Column, confidence: Column, metadata: Column, asset: str) -> DataFrame:
    key = F.concat_ws(":", kind, "src", "dst", F.lit(PIPELINE_VERSION), F.lit(SCHEMA_VERSION), F.lit("1.0"))
    return df.select(F.sha2(key, 256).alias("edge_id"), "src", "dst", kind.alias("type"), weight.cast("double").alias("weight"), confidence.cast("double").alias("confidence"), metadata.alias("metadata"), F.lit(asset).alias("source_asset"))


def _ends(nodes: DataFrame, sid: str, nid: str, kind: str | None = None) -> DataFrame:
    """source_id -> node_id; where several kinds share a source id, the greatest node id."""
    n = nodes if kind is None else nodes.where(F.col("node_type") == kind)
    return n.groupBy(F.col("source_id").alias(sid)).agg(F.max("node_id").alias(nid))


def semantic_edges(nodes: DataFrame, relationships: DataFrame, least: float = 0.1) -> DataFrame:
    """similar_to edges of relationships (source_id, target_id, similarity_score) whose ends are both nodes."""
    r = relationships.select(F.col("source_id").cast("string").alias("a"), F.col("target_id").cast("string").alias("b"), F.col("similarity_score").alias("w"), *(["confidence"] if "confidence" in relationships.columns else []))
    r = r.where(F.col("w") >= least).join(_ends(nodes, "a", "src"), "a").join(_ends(nodes, "b", "dst"), "b")
    conf = F.col("confidence") if "confidence" in relationships.columns else F.col("w")
    return _edge(r, F.lit("similar_to"), F.col("w"), conf, F.to_json(F.struct(F.lit("semantic_relationships.parquet").alias("source_asset"))), "semantic_relationships.parquet")


def hierarchical_edges(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members to their cluster: belongs_to for the representative, else member_of_cluster."""
    c = clusters.select(F.col("cluster_id").cast("string").alias("cid"), F.col("representative_id").cast("string").alias("rep"), F.explode(F.col("member_ids").cast("array<string>")).alias("m"))
    c = c.join(_ends(nodes, "cid", "dst", "cluster"), "cid").join(_ends(nodes, "m", "src"), "m").withColumn("is_rep", F.col("m") == F.col("rep"))
    meta = F.to_json(F.struct(F.col("cid").alias("cluster_id"), F.col("is_rep").cast("string").alias("representative")))
    return _edge(c, F.when(F.col("is_rep"), "belongs_to").otherwise("member_of_cluster"), F.lit(1.0), F.when(F.col("is_rep"), 1.0).otherwise(0.8), meta, "semantic_clusters.parquet")


def causal_edges(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """causes edges from each piece of evidence to its signal, as strong as the signal is sure."""
    key = _first(signals, ASSETS["problem_signal"][1])
    conf = F.coalesce(F.col("confidence"), F.lit(0.8)) if "confidence" in signals.columns else F.lit(0.8)
    s = signals.select(F.col(key).cast("string").alias("sid"), conf.alias("c"), F.explode(F.col("evidence_ids").cast("array<string>")).alias("eid"))
    s = s.join(_ends(nodes, "sid", "dst", "problem_signal"), "sid").join(_ends(nodes, "eid", "src", "evidence"), "eid")
    meta = F.to_json(F.struct(F.col("sid").alias("signal_id"), F.col("eid").alias("evidence_id")))
    return _edge(s, F.lit("causes"), F.col("c"), F.col("c"), meta, "problem_signals.parquet")


def keep_edges(nodes: DataFrame, edges: DataFrame, least_confidence: float = 0.5, least_weight: float = 0.1) -> DataFrame:
    """Edges whose ends are nodes and that are sure and strong enough."""
    e = edges.where((F.col("confidence") >= least_confidence) & (F.col("weight") >= least_weight))
    ids = nodes.select("node_id")
    return e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def build(assets: dict[str, DataFrame], relationships: DataFrame | None = None, least_confidence: float = 0.5, least_weight: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all assets that are there; repeated edge ids are one edge."""
    nodes = build_nodes(assets)
    parts = []
    if relationships is not None:
        parts.append(semantic_edges(nodes, relationships, least_weight))
    if "cluster" in assets:
        parts.append(hierarchical_edges(nodes, assets["cluster"]))
    if "problem_signal" in assets:
        parts.append(causal_edges(nodes, assets["problem_signal"]))
    edges = None
    for part in parts:
        edges = part if edges is None else edges.unionByName(part)
    if edges is None:
        edges = nodes.sparkSession.createDataFrame([], "edge_id string, src string, dst string, type string, weight double, confidence double, metadata string, source_asset string")
    return nodes, keep_edges(nodes, edges, least_confidence, least_weight).dropDuplicates(["edge_id"])


# ---- search


def by_label(nodes: DataFrame, text: str, fuzzy: bool = True) -> DataFrame:
    """Nodes whose label contains the text, case-blind, or equals it."""
    return nodes.where(F.lower("label").contains(text.lower()) if fuzzy else F.col("label") == text)


def by_property(nodes: DataFrame, key: str, value) -> DataFrame:
    return nodes.where(F.get_json_object("properties", f"$.{key}") == str(value))


def by_filters(nodes: DataFrame, node_type: str, **filters) -> DataFrame:
    """Nodes of a type; each filter looks in properties, then metadata, then attributes, and a key that is nowhere passes."""
    out = nodes.where(F.col("node_type") == node_type)
    for key, value in filters.items():
        found = F.coalesce(*[F.get_json_object(c, f"$.{key}") for c in ("properties", "metadata", "attributes")])
        out = out.where(found.isNull() | (found == str(value)))
    return out


def similar(edges: DataFrame, node, top: int = 10) -> DataFrame:
    """(node, weight) over similar_to edges either way, strongest first."""
    e = edges.where("type = 'similar_to'")
    both = e.where(F.col("src") == node).select(F.col("dst").alias("node"), "weight").unionByName(e.where(F.col("dst") == node).select(F.col("src").alias("node"), "weight"))
    return both.orderBy(F.desc("weight"), "node").limit(top)


def members(edges: DataFrame, cluster) -> DataFrame:
    return edges.where(F.col("type").isin("member_of_cluster", "belongs_to") & (F.col("dst") == cluster)).select(F.col("src").alias("node")).distinct()


def sure_nodes(nodes: DataFrame, least: float) -> DataFrame:
    return nodes.where(F.col("confidence") >= least)


def strong_edges(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new`` added, or in the place of nodes with the same id."""
    return nodes.join(new.select("node_id"), "node_id", "left_anti").select(*nodes.columns).unionByName(new)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes ``gone`` (node_id) and the edges that touch them."""
    ids = gone.select("node_id")
    left = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left.select(*edges.columns)


# ---- validation


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, severity, n) of what is wrong with a graph as stored; checks without a finding have n = 0."""
    ids = nodes.select("node_id").distinct()
    one = lambda df, code, severity: df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")
    excess = lambda df, key, code: df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(code).alias("code"), F.lit("ERROR").alias("severity"), "n")
    known = edges.select("src", "dst").join(ids.select(F.col("node_id").alias("src"), F.lit(True).alias("s")), "src", "left").join(ids.select(F.col("node_id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    wide = lambda c: ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    bare = F.coalesce(F.col("metadata"), F.lit("{}")).isin("", "{}")
    refs = nodes.select(F.get_json_object("attributes", "$.embedding_id").alias("node_id")).where(F.coalesce("node_id", F.lit("")) != "")
    lonely = ids.join(degrees(edges).select(F.col("node").alias("node_id")), "node_id", "left_anti")
    parts = [
        excess(nodes, "node_id", "duplicate_nodes"), excess(edges, "edge_id", "duplicate_edges"), one(known.where("s is null or d is null"), "orphan_edges", "ERROR"), one(edges.where("src = dst"), "self_loops", "WARN"),
        one(nodes.where(wide("confidence")).select("node_id").unionByName(edges.where(wide("confidence")).select(F.col("edge_id").alias("node_id"))), "invalid_confidence", "ERROR"),
        one(edges.where(wide("weight")), "invalid_weight", "ERROR"), one(nodes.where(bare).select("node_id").unionByName(edges.where(bare).select(F.col("edge_id").alias("node_id"))), "missing_metadata", "WARN"),
        one(refs.join(ids, "node_id", "left_anti"), "broken_references", "WARN"),
        one(nodes.where(~F.col("node_type").isin(*NODE_TYPES)).select("node_id").unionByName(edges.where(~F.col("type").isin(*EDGE_TYPES)).select(F.col("edge_id").alias("node_id"))), "unknown_types", "ERROR"),
        one(lonely, "orphan_nodes", "WARN"), one(connected_components(edges).select("component").distinct().unionByName(lonely.withColumnRenamed("node_id", "component")), "components", "INFO"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    spark = nodes.sparkSession
    flags = [("empty_nodes", "WARN", int(nodes.isEmpty())), ("empty_edges", "WARN", int(edges.isEmpty())), ("cycles", "WARN", int(has_cycle(edges)))]
    return out.unionByName(spark.createDataFrame(flags, "code string, severity string, n long"))
