"""Sinks: partitioned writes, assets with a manifest, upserts, snapshots, reports."""

from __future__ import annotations

import hashlib
import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F


def write_documents(df: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "csv")) -> dict[str, str]:
    paths = {}
    for f in formats:
        paths[f] = f"{folder}/documents_{f}"
        w = df.write.mode("overwrite")
        w.option("header", True).csv(paths[f]) if f == "csv" else w.format(f).save(paths[f])
    return paths


def append_raw(df: DataFrame, folder: str) -> None:
    """Raw rows as JSON lines by source and day."""
    df.withColumn("day", F.current_date()).write.mode("append").partitionBy("source", "day").json(folder)


def split_invalid(df: DataFrame, good: str, bad: str) -> None:
    """Valid rows to Parquet, the others to a dead-letter JSON folder."""
    df.where("valid").drop("valid", "reasons").write.mode("append").parquet(good)
    df.where("not valid").write.mode("append").json(bad)


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free checksum of all columns)."""
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("checksum")).first()
    return row["rows"], str(row["checksum"])


def _write_json(spark, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_asset(df: DataFrame, folder: str, name: str, run_id: str, upstream: tuple[str, ...] = ()) -> dict:
    """Overwrites an asset and its manifest (run id, rows, order-free checksum, upstream names)."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    back = spark.read.schema(df.schema).parquet(path)
    rows, total = checksum(back)
    manifest = {"name": name, "run_id": run_id, "rows": rows, "checksum": total, "columns": back.columns, "upstream": list(upstream), "written_at": datetime.now(timezone.utc).isoformat()}
    _write_json(spark, manifest, f"{path}.manifest")
    return manifest


class StaleAsset(Exception):
    """An asset of another run, or one that isn't there."""


def read_manifest(spark, folder: str, name: str) -> dict:
    try:
        return _read_json(spark, f"{folder}/{name}.manifest")
    except Exception as e:
        raise StaleAsset(f"{name} is missing") from e


def read_asset(spark, folder: str, name: str, run_id: str | None = None) -> DataFrame:
    manifest = read_manifest(spark, folder, name)
    try:
        df = spark.read.parquet(f"{folder}/{name}")
    except Exception as e:
        raise StaleAsset(f"{name} is missing") from e
    if run_id and manifest["run_id"] != run_id:
        raise StaleAsset(f"{name} is of run {manifest['run_id']}, not {run_id}")
    return df


def collect_assets(spark, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The assets that are there; those that are missing are left out."""
    found = {}
    for name in names:
        try:
            found[name] = read_asset(spark, folder, name)
        except StaleAsset:
            continue
    return found


def append_asset(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{name}")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What an upsert leaves: the last row of each key, by an aggregate that is combined before the shuffle."""
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def write_snapshot(df: DataFrame, folder: str, asset: str, snapshot_id: str) -> None:
    df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(f"{folder}/{asset}")


def read_snapshot(spark, folder: str, asset: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{asset}").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def snapshot_run(spark, assets_folder: str, names: list[str], folder: str, snapshot_id: str) -> DataFrame:
    """Copies the run's assets into a snapshot and adds it to the index; gives the index rows (snapshot_id, asset, rows, sha256)."""
    rows = []
    for name, df in collect_assets(spark, assets_folder, names).items():
        write_snapshot(df, folder, name, snapshot_id)
        n, total = checksum(df)
        rows.append((snapshot_id, name, n, hashlib.sha256(f"{name}:{n}:{total}".encode()).hexdigest(), datetime.now(timezone.utc)))
    index = spark.createDataFrame(rows, "snapshot_id string, asset string, rows long, sha256 string, made_at timestamp")
    index.write.mode("append").parquet(f"{folder}/_snapshots")
    return index


def scan_snapshots(spark, folder: str) -> DataFrame:
    """The index of all snapshots, oldest first."""
    return spark.read.parquet(f"{folder}/_snapshots").orderBy("made_at", "snapshot_id", "asset")


def audit(df: DataFrame, folder: str, table: str, action: str) -> None:
    """Notes an action on a table and how many rows it touched."""
    df.sparkSession.createDataFrame([(table, action, df.count(), datetime.now(timezone.utc))], "table string, action string, rows long, at timestamp").write.mode("append").parquet(f"{folder}/_audit")


def ask(sql: str, **tables: DataFrame) -> DataFrame:
    """Runs SQL over named frames, each written as {name} in the text."""
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)


def read_raw(spark, folder: str, source: str, day: str) -> DataFrame:
    """Raw rows of a source and day (yyyy-mm-dd); none if nothing was stored then."""
    try:
        return spark.read.json(folder).where((F.col("source") == source) & (F.col("day").cast("string") == day))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "source string, day string")
        raise


# Columns of normalised documents, in their order.
NORMALISED = (
    "document_id", "source", "source_type", "external_id", "title", "content", "author", "created_at", "updated_at", "language", "url", "tags", "categories", "metadata", "raw_json", "checksum",
    "collector_version",
)


def write_normalised(df: DataFrame, folder: str) -> None:
    """Normalised documents with their columns in the fixed order; missing ones are null."""
    df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in NORMALISED]).write.mode("append").parquet(folder)


def write_rejected(rejected: DataFrame, folder: str) -> None:
    rejected.write.mode("overwrite").parquet(folder)


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{folder}/{name}_json")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")


def gexf(nodes: list[tuple[str, str]], edges: list[tuple[str, str, float]]) -> str:
    """A small graph as GEXF."""
    n = "".join(f'<node id="{html.escape(i)}" label="{html.escape(t)}"/>' for i, t in nodes)
    e = "".join(f'<edge id="{i}" source="{html.escape(a)}" target="{html.escape(b)}" weight="{w}"/>' for i, (a, b, w) in enumerate(edges))
    return f'<?xml version="1.0" encoding="UTF-8"?><gexf version="1.3"><graph defaultedgetype="directed"><nodes>{n}</nodes><edges>{e}</edges></graph></gexf>'


def _small(df: DataFrame, rows: int, name: str) -> list[tuple]:
    got = [tuple(r) for r in df.limit(rows + 1).collect()]
    if len(got) > rows:
        raise ValueError(f"{name} has over {rows} rows: aggregate it or raise the limit")
    return got


def render(title: str, sections: list[tuple[str, DataFrame]], kind: str, rows: int = 100) -> str:
    """A report of small aggregates as json, markdown, html or csv; a table of over ``rows`` rows is refused, not cut."""
    data = [(name, df.columns, _small(df, rows, name)) for name, df in sections]
    if kind == "json":
        return json.dumps({"title": title, "sections": [{"name": n, "columns": c, "rows": r} for n, c, r in data]}, default=str)
    if kind == "markdown":
        parts = [f"# {title}"]
        for n, c, rs in data:
            parts += [f"\n## {n}\n", "| " + " | ".join(c) + " |", "|" + " --- |" * len(c), *["| " + " | ".join(map(str, r)) + " |" for r in rs]]
        return "\n".join(parts)
    if kind == "html":
        cell = lambda t, v: f"<{t}>{html.escape(str(v))}</{t}>"
        body = "".join(f"<h2>{html.escape(n)}</h2><table><tr>{''.join(cell('th', x) for x in c)}</tr>{''.join('<tr>' + ''.join(cell('td', v) for v in r) + '</tr>' for r in rs)}</table>" for n, c, rs in data)
        return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"
    if kind == "csv":
        quote = lambda v: '"' + str(v).replace('"', '""') + '"'
        return "\n".join(",".join(map(quote, r)) for n, c, rs in data for r in [["section", *c], *[[n, *x] for x in rs]])
    raise ValueError(f"no renderer for {kind}")
