"""Joins in which single keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_hot(rows: DataFrame, small: DataFrame, key: str, weight: str, how: str = "left", share: float = 1e-3) -> DataFrame:
    """Join many ``rows`` to one ``small`` row per key where single keys may hold most rows.

    ``small`` has ``key``, ``weight`` (how many rows carry the key) and value columns, and
    must be cheap to read twice. Keys that hold over ``share`` of all weight are at most
    1/share keys, whatever the input: that bounded part is broadcast. The rest is joined
    by a shuffle in which no key is larger than ``share``.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    cut = max(1000, int(total * share))
    values = [c for c in small.columns if c not in (key, weight)]
    hot = small.where(F.col(weight) > cut).select(key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    cold = small.where(F.col(weight) <= cut).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    wide = rows.join(F.broadcast(hot), key, "left")
    is_hot = wide.where(F.col("_hot")).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in values])
    rest = wide.where(F.col("_hot").isNull()).join(cold, F.col(key) == F.col("_cold_key"), how)
    return is_hot.unionByName(rest.select(*rows.columns, *[F.col(f"_cold_{c}").alias(c) for c in values]))
