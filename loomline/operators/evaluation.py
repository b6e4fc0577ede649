"""Evaluation: a score for each stage's output, the overall health, cluster and pipeline figures, integrity of assets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomline.sources.sinks import StaleAsset, checksum, read_asset, read_manifest

# Weights of the stages' health.
STAGE_WEIGHTS = {"documents": 0.10, "observations": 0.20, "evidence": 0.15, "signals": 0.15, "embeddings": 0.10, "relationships": 0.15, "clusters": 0.125, "reasoning": 0.125}
# What a stage's measures are held against.
LIMITS = {
    "compression": 1.0, "evidence_confidence": 0.5, "signal_documents": 3, "zero_vectors": 0.05, "duplicate_vectors": 0.10, "similarity": 0.0,
    "low_quality_clusters": 0.30, "cluster_quality": 0.3, "singletons": 0.50,
}


def penalised(measures: DataFrame, empty: Column, penalties: list[tuple[Column, Column | float]]) -> DataFrame:
    """Adds score: 100 less the penalty of every condition that holds, within 0 and 100; 0 for an empty stage."""
    lost = reduce(lambda a, p: a + F.when(F.coalesce(p[0], F.lit(False)), p[1]).otherwise(0.0), penalties, F.lit(0.0))
    return measures.withColumn("score", F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 100.0 - lost), 1)))


def capped(rate: Column, scale: float, most: float) -> Column:
    return F.least(F.lit(most), rate * scale)


def _known(c: str) -> Column:
    return F.count(F.nullif(F.col(c).cast("string"), F.lit("")))


def document_health(docs: DataFrame, id_col: str, text: str, meta: list[str]) -> DataFrame:
    """Rates and score of the documents stage, one row."""
    empty = F.col(text).isNull() | (F.trim(F.col(text)) == "")
    filled = reduce(lambda a, b: a + b, [F.avg(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1.0).otherwise(0.0)) for c in meta]) / len(meta)
    m = docs.agg(F.count("*").alias("documents"), (1 - F.count_distinct(id_col) / F.count("*")).alias("duplicate_rate"), F.avg(empty.cast("double")).alias("empty_rate"), filled.alias("completeness"))
    score = F.lit(100.0) - F.when(F.col("duplicate_rate") > 0.10, F.least(F.lit(30.0), F.col("duplicate_rate") * 100)).otherwise(0.0) - F.when(F.col("empty_rate") > 0.05, F.least(F.lit(20.0), F.col("empty_rate") * 100)).otherwise(0.0)
    score = score - F.when((F.col("completeness") < 0.8) & (F.col("completeness") > 0), F.least(F.lit(20.0), (1 - F.col("completeness")) * 50)).otherwise(0.0)
    return m.withColumn("score", F.when(F.col("documents") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 1)))


def observation_health(obs: DataFrame, documents: int) -> DataFrame:
    m = obs.agg(F.count("*").alias("n"), (_known("category") / F.count("*")).alias("enriched"), (_known("canonical_value") / F.count("*")).alias("canonical"), F.count_distinct("kind").alias("extractors"))
    few = (F.lit(documents) > 0) & (F.col("n") / F.lit(float(max(documents, 1))) < 0.1)
    return penalised(m, F.col("n") == 0, [(few, 20.0), (F.col("enriched") < 0.1, 15.0), (F.col("canonical") < 0.1, 10.0), (F.col("extractors") < 2, 10.0)])


def evidence_health(ev: DataFrame, observations: int) -> DataFrame:
    m = ev.agg(F.count("*").alias("n"), (F.lit(float(observations)) / F.count("*")).alias("compression"), F.avg("observation_count").alias("per_evidence"), F.avg("confidence").alias("mean_confidence"), F.count_distinct("category").alias("categories"))
    return penalised(m, F.col("n") == 0, [(F.col("compression") < LIMITS["compression"], 20.0), (F.col("per_evidence") < 2, 15.0), (F.col("mean_confidence") < LIMITS["evidence_confidence"], 10.0), (F.col("categories") < 2, 10.0)])


def signal_health(signals: DataFrame, filtered: int) -> DataFrame:
    m = signals.agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"), F.avg("document_count").alias("support"))
    return penalised(m, F.col("n") == 0, [(F.lit(filtered) > F.col("n") * 2, 15.0), ((F.col("categories") > 0) & (F.col("categories") < 3), 10.0), (F.col("support") < LIMITS["signal_documents"], 10.0)])


def embedding_health(embeddings: DataFrame, model: str | None = None, vec: str = "embedding") -> DataFrame:
    """Dimension missing, zero and repeated vectors, and whether the model that made them is named."""
    size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    m = embeddings.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dimension"), (F.count_if(size < 1e-10) / F.count("*")).alias("zero_rate"), (1 - F.count_distinct(vec) / F.count("*")).alias("duplicate_rate"))
    zero, double = F.col("zero_rate"), F.col("duplicate_rate")
    return penalised(m, F.col("n") == 0, [(F.col("dimension") <= 0, 30.0), (zero > LIMITS["zero_vectors"], capped(zero, 100, 30.0)), (double > LIMITS["duplicate_vectors"], capped(double, 100, 20.0)), (F.lit(not model), 10.0)])


def relationship_health(edges: DataFrame, components: DataFrame, nodes: int) -> DataFrame:
    """``edges`` has similarity and confidence, ``components`` node and component, ``nodes`` counts all items that could be related."""
    m = edges.agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.avg("confidence").alias("mean_confidence"))
    sizes = components.groupBy("component").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("largest"), F.coalesce(F.sum("c"), F.lit(0)).alias("seen"))
    m = m.join(F.broadcast(sizes)).withColumn("isolated_rate", 1 - F.col("seen") / F.lit(float(max(nodes, 1)))).withColumn("largest_share", F.col("largest") / F.greatest(F.col("seen"), F.lit(1)))  # two rows of one
    lonely = F.col("isolated_rate")
    return penalised(m, F.col("n") == 0, [
        (F.col("mean") < LIMITS["similarity"], 15.0), (lonely > 0.3, capped(lonely, 50, 20.0)), ((F.col("largest_share") < 0.3) & (F.col("n") > 10), 10.0), (F.col("mean_confidence") < 0.5, 10.0),
    ])


def cluster_health(metrics: DataFrame) -> DataFrame:
    """``metrics`` has a row a cluster: size and quality."""
    low, some = F.count_if(F.col("quality") < LIMITS["cluster_quality"]), F.greatest(F.count("*"), F.lit(1))
    m = metrics.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("members"), (low / some).alias("low_rate"), (F.count_if(F.col("size") == 1) / some).alias("singleton_rate"), F.avg("quality").alias("mean_quality"))
    return penalised(m, F.col("n") == 0, [
        (F.col("low_rate") > LIMITS["low_quality_clusters"], capped(F.col("low_rate"), 100, 30.0)), (F.col("singleton_rate") > LIMITS["singletons"], capped(F.col("singleton_rate"), 50, 20.0)),
        (F.col("members") == 0, 20.0), (F.col("mean_quality") < LIMITS["cluster_quality"], 15.0),
    ])


def reasoning_health(inferences: DataFrame, root_causes: int, aggregations: int) -> DataFrame:
    m = inferences.agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    return penalised(m, F.lit(False), [(F.col("n") == 0, 40.0), (F.col("n") < 5, 20.0), ((F.col("mean_confidence") < 0.3) & (F.col("n") > 0), 15.0), ((F.lit(root_causes) == 0) & (F.col("n") > 0), 10.0), ((F.lit(aggregations) == 0) & (F.col("n") > 0), 10.0)])


def _ranked_health(rows: DataFrame, score: str, extra: list[tuple[Column, float]]) -> DataFrame:
    m = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"))
    some = F.when(F.col("n") == 0, 50.0).when(F.col("n") < 3, 20.0).when(F.col("n") < 10, 10.0).otherwise(0.0)
    return penalised(m, F.lit(False), [(F.lit(True), some), ((F.col("mean") < 0.3) & (F.col("n") > 0), 10.0), *extra])


def opportunity_health(opportunities: DataFrame, strong: int) -> DataFrame:
    return _ranked_health(opportunities, "opportunity_score", [((F.lit(strong) == 0) & (F.col("n") > 0), 10.0)])


def trend_health(trends: DataFrame, growing: int, emerging: int) -> DataFrame:
    return _ranked_health(trends, "trend_score", [((F.lit(growing) == 0) & (F.col("n") > 0), 10.0), ((F.lit(emerging) == 0) & (F.col("n") > 0), 5.0)])


def dashboard(documents: int, observations: int, evidence: int, signals: int) -> dict[str, float]:
    """Ratios of the pipeline's stages, halves rounded up: observations a document, observations an evidence row, signals a document."""
    share = lambda a, b, digits: math.floor(a / b * 10**digits + 0.5) / 10**digits if b else 0.0
    return {
        "documents": documents, "observations": observations, "evidence": evidence, "signals": signals, "extraction_rate": share(observations, documents, 2),
        "compression_ratio": share(observations, evidence, 2), "signal_rate": share(signals, documents, 4),
    }


def integrity(spark, folder: str, run_id: str, expected: dict[str, list[str]], models: tuple[DataFrame, str] | None = None) -> DataFrame:
    """(asset, check, status, detail): whether each expected asset is there, is of the run, has its columns and its checksum; and that one model made all vectors."""
    rows = []
    for name, columns in expected.items():
        try:
            df, manifest = read_asset(spark, folder, name), read_manifest(spark, folder, name)
        except StaleAsset as e:
            rows.append((name, "exists", "FAIL", str(e)))
            continue
        rows.append((name, "exists", "PASS", ""))
        rows.append((name, "run_id", "PASS" if manifest["run_id"] == run_id else "WARN", manifest["run_id"]))
        lost = [c for c in columns if c not in df.columns]
        rows.append((name, "schema", "FAIL" if lost else "PASS", ",".join(lost)))
        rows.append((name, "checksum", "PASS" if checksum(df) == (manifest["rows"], manifest["checksum"]) else "FAIL", ""))
    if models:
        n = models[0].select(models[1]).distinct().count()
        rows.append(("embeddings", "one_model", "PASS" if n <= 1 else "FAIL", str(n)))
    return spark.createDataFrame(rows, "asset string, check string, status string, detail string")


def overall(scores: DataFrame, weights: dict[str, float] = STAGE_WEIGHTS) -> DataFrame:
    """Weighted mean of stage scores (stage, score) and the worst stage."""
    weight = F.coalesce(*[F.when(F.col("stage") == k, w) for k, w in weights.items()], F.lit(0.0))
    s = scores.withColumn("w", weight)
    return s.agg(F.round(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 4).alias("health"), F.min_by("stage", F.struct("score", "stage")).alias("worst_stage"))
