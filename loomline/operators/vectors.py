"""Vectors: metrics, exact top-k neighbours, relationships and their filters, statistics.

Neighbours are exact. Queries and index are cut into blocks of bounded rows; each pair of blocks meets in
one task, which multiplies them and keeps the k best per query. Nothing passes through the driver; a row
is sent as often as the other side has blocks, and k rows per query and index block are ranked last.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.session import materialise, ship

BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    return F.when(norm(a) < 1e-10, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """1 - distance / sqrt(4 dim)."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    return 1 - d / F.sqrt(F.lit(4.0) * F.size(a))


def top_k(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, target_id, score): the k best rows of ``index`` for each query, itself included, ties by target id.

    Zero vectors score 0. Null or empty vectors are ignored. A stated query set meets all of the index, in blocks.
    """
    spark = index.sparkSession
    ship(spark)
    q = queries.where(F.size(vec) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    x = index.where(F.size(vec) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    nq, nx = max(1, -(-q.count() // block)), max(1, -(-x.count() // block))
    spread = lambda df, own, n, other, m: df.withColumn(own, F.monotonically_increasing_id() % n).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left, right = spread(q, "qb", nq, "xb", nx).groupBy("qb", "xb"), spread(x, "xb", nx, "qb", nq).groupBy("qb", "xb")
    found = left.cogroup(right).applyInPandas(lambda a, b: _best(a, b, k, metric), "query_id long, target_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "target_id")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def _best(queries: pd.DataFrame, targets: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    if queries.empty or targets.empty:
        return pd.DataFrame({"query_id": [], "target_id": [], "score": []}).astype({"query_id": "int64", "target_id": "int64", "score": "float64"})
    targets = targets.sort_values("id", kind="stable")
    qids, ids = queries["id"].to_numpy(), targets["id"].to_numpy()
    q, x = np.stack(queries["v"].to_numpy()), np.stack(targets["v"].to_numpy())
    if metric == "cosine":
        q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (q, x))
    parts = []
    for at in range(0, len(q), 512):  # bounds the scores held at once
        s = q[at : at + 512] @ x.T
        if metric == "euclidean":
            d2 = (q[at : at + 512] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * s
            s = 1 - np.sqrt(np.maximum(d2, 0)) / np.sqrt(4.0 * q.shape[1])
        best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(s)), best.shape[1])
        parts.append(pd.DataFrame({"query_id": qids[at + rows], "target_id": ids[best.ravel()], "score": s[rows, best.ravel()]}))
    return pd.concat(parts)


def relationships(neighbours: DataFrame, threshold: float, kinds: Column | None = None, k: int | None = None) -> DataFrame:
    """Neighbours -> undirected edges: no self pairs, one row a pair (the first by query), score at or over the
    threshold, allowed kinds only, at most k a source. The order of these steps is part of the result."""
    e = neighbours.where("query_id <> target_id").withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    pair = Window.partitionBy(F.least("query_id", "target_id"), F.greatest("query_id", "target_id")).orderBy("query_id", "target_id")
    e = e.withColumn("rn", F.row_number().over(pair)).where("rn = 1").drop("rn").where(F.col("score") >= threshold)
    e = e.where(kinds) if kinds is not None else e
    if k:
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "target_id")
        e = e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
    return e.withColumnsRenamed({"query_id": "source_id", "target_id": "target_id", "score": "similarity"})


def relationship_id(a: Column, b: Column, metric: str, version: str = "1.0") -> Column:
    a, b = a.cast("string"), b.cast("string")
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.lit(metric), F.lit(version)), 256)


def frequency_factor(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log(1 + n.cast("double")) / F.log(F.lit(100.0)))


def confidence(factors: list[tuple[Column, float]]) -> Column:
    """Weighted geometric mean of factors clipped to [1e-9, 1]."""
    total = sum(w for _, w in factors)
    logs = None
    for f, w in factors:
        part = F.log(F.least(F.greatest(f, F.lit(1e-9)), F.lit(1.0))) * w
        logs = part if logs is None else logs + part
    return F.exp(logs / total)


def statistics(edges: DataFrame) -> DataFrame:
    """rows, distinct sources, targets and pairs, mean and population deviation of similarity, density over the nodes seen."""
    a = edges.agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"), F.count_distinct(F.struct(F.least("source_id", "target_id"), F.greatest("source_id", "target_id"))).alias("pairs"), F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("std"))
    nodes = edges.select(F.col("source_id").alias("x")).union(edges.select("target_id")).agg(F.count_distinct("x").alias("nodes"))
    return a.join(F.broadcast(nodes)).withColumn("density", F.when(F.col("nodes") > 1, F.col("pairs") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(0.0))


def thresholds(edges: DataFrame, candidates: list[float]) -> DataFrame:
    """Percentiles of similarity and how many edges each candidate threshold would keep; p50 to p95 is the recommended range."""
    p = F.percentile("similarity", F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95, 0.99)]))
    return edges.agg(p.alias("p"), *[F.count_if(F.col("similarity") >= c).alias(f"at_{int(c * 100)}") for c in candidates])


def threshold_warning(recommended: tuple[float, float], configured: float) -> str | None:
    """What to say of a configured threshold outside the recommended range [p50, p95]."""
    low, high = recommended
    if configured < low:
        return f"threshold {configured:.2f} is under the recommended {low:.2f}: weak relationships will be kept"
    if configured > high:
        return f"threshold {configured:.2f} is over the recommended {high:.2f}: most relationships will be lost"
    return None


def confident(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("confidence") >= least)


def filter_pipeline(edges: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(what all stages leave, (ordinal, stage, removed, left) rows); each stage's result is written once, so no stage runs again for the counts."""
    spark, rows = edges.sparkSession, []
    edges = materialise(edges, "filter-input")
    before = edges.count()
    for i, (name, stage) in enumerate(stages):
        edges = materialise(stage(edges), f"filter-{i}")
        left = edges.count()
        rows.append((i, name, before - left, left))
        before = left
    return edges, spark.createDataFrame(rows, "ordinal int, stage string, removed long, left long")


def lookup(edges: DataFrame, source=None, target=None, either=None, top: int | None = None) -> DataFrame:
    """Relationships of a source, a target, a pair (both), or any that touch ``either``; best first."""
    out = edges if source is None else edges.where(F.col("source_id") == source)
    out = out if target is None else out.where(F.col("target_id") == target)
    out = out if either is None else out.where((F.col("source_id") == either) | (F.col("target_id") == either))
    out = out.orderBy(F.desc("similarity"), "source_id", "target_id")
    return out.limit(top) if top else out


def verify(embeddings: DataFrame, id_col: str, vec: str, run: str | None = None, tolerance: float = 1e-4) -> DataFrame:
    """One row: vectors, those not of unit length, repeated ids, distinct runs, and valid."""
    runs = F.count_distinct(run) if run else F.lit(1).cast("long")
    one = embeddings.agg(F.count("*").alias("n"), F.count_if(F.abs(norm(F.col(vec)) - 1) > tolerance).alias("not_unit"), (F.count("*") - F.count_distinct(id_col)).alias("repeated_ids"), runs.alias("runs"))
    return one.withColumn("valid", (F.col("not_unit") == 0) & (F.col("repeated_ids") == 0) & (F.col("runs") <= 1))


class LinearIndex:
    """Exact index over a frame of vectors: add, search, and a Parquet form that save and load share."""

    def __init__(self, vectors: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding"):
        self.vectors, self.metric, self.id_col, self.vec = vectors, metric, id_col, vec

    def add(self, more: DataFrame) -> LinearIndex:
        return LinearIndex(self.vectors.unionByName(more), self.metric, self.id_col, self.vec)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return top_k(self.vectors, queries, k, self.metric, self.id_col, self.vec)

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, **options) -> LinearIndex:
        return cls(spark.read.parquet(path), **options)


class HashedWords:
    """Embeds without a model: words hashed into ``dimension`` signed counts, of unit length; a blank text has no vector."""

    name, dimension = "hashed", 64

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % self.dimension] += 1 if h >> 16 & 1 else -1
            size = float(np.linalg.norm(v))
            out.append((v / size).tolist() if size else None)
        return out


class Declared:
    """A provider that is known by name only."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        raise NotImplementedError(f"{self.name} is declared but not implemented")


#: Embedding providers by name: callables from a batch of texts to vectors (None for a failure).
EMBEDDERS: dict[str, Callable[[list[str]], list[list[float] | None]]] = {"hashed": HashedWords(), "ollama": Declared("ollama"), "openai": Declared("openai")}


def embed(texts: DataFrame, known: DataFrame | None, provider: str, id_col: str = "id", text: str = "text", batch: int = 64) -> DataFrame:
    """(id, embedding, error) of texts whose id isn't ``known`` yet, by a registered provider, ``batch`` texts a call.

    A blank or null text is an error and has no vector. Arrow batches, one provider call a slice.
    """
    if provider not in EMBEDDERS:
        raise ValueError(f"no embedding provider {provider}")
    ship(texts.sparkSession)
    call = EMBEDDERS[provider]
    new = texts.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    new = new if known is None else new.join(known.select(F.col(id_col).cast("string").alias("id")), "id", "left_anti")

    def run(frames):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                full = part["text"].str.strip() != ""
                vectors = iter(call(part["text"][full].tolist()) if full.any() else [])
                got = [next(vectors) if ok else None for ok in full]
                yield pd.DataFrame({"id": part["id"].tolist(), "embedding": got, "error": [None if v is not None else "blank" if not ok else "failed" for v, ok in zip(got, full)]})

    return new.mapInPandas(run, "id string, embedding array<double>, error string")
