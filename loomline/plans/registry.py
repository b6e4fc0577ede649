"""Name -> (DataFrame query, oracle SQL) for the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.session import spread

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "document_intake"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is what DuckDB runs on the same tables."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name in TEXTS else read


def load_all() -> None:
    """Import the modules that register queries."""
    from loomline.plans import extract, graph, intake, knowledge, trend  # noqa: F401


