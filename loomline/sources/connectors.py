"""Connectors replay stored API pages as a Python data source, then map payloads to raw documents.

A source's folder holds its pages as JSON files (items, and the name of the next page), in the order they
were fetched. Partitions are files, so replays run in parallel; there is no network in the engine. A
fetcher for live use plugs in at ``fetch`` with the retry and rate rules below.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomline.session import ship


class Pages(DataSource):
    """format("loomline_pages"), option path."""

    @classmethod
    def name(cls) -> str:
        return "loomline_pages"

    def schema(self) -> str:
        return "page string, ordinal int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options["path"])


class _PagesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, folder = _file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = _file_system(self.path)
        with fs.open_input_stream(partition.value) as page:
            items = json.loads(page.read()).get("items", [])
        for i, item in enumerate(items):
            yield (partition.value.rpartition("/")[2], i, json.dumps(item))


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The shared file system that driver and executors see under this path; Spark's names for object stores are known too."""
    scheme, mark, rest = path.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


def replay(spark: SparkSession, source: str, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Pages)
    return spark.read.format("loomline_pages").option("path", path).load().withColumn("source", F.lit(source))


def _j(*paths: str) -> Column:
    return F.coalesce(*[F.get_json_object("payload", f"$.{p}") for p in paths])


#: Payload paths of each source: external id, title, content, author, created, url, score.
ADAPTERS = {
    "issues": (("id",), ("title",), ("body",), ("user.login",), ("created_at",), ("html_url",), ("comments",)),
    "stories": (("id",), ("title",), ("text",), ("by",), ("time",), ("url",), ("score",)),
    "launches": (("id",), ("name",), ("description", "tagline"), ("makers[0].name",), ("createdAt",), ("url",), ("votesCount",)),
    "videos": (("id",), ("snippet.title",), ("snippet.description",), ("snippet.channelTitle",), ("snippet.publishedAt",), ("url",), ("statistics.viewCount",)),
    "app_reviews": (("reviewId",), ("title",), ("content",), ("userName",), ("at",), ("url",), ("score",)),
}
#: The same for what is said about an item, where a source has comments.
COMMENTS = {
    "issues": (("id",), (), ("body",), ("user.login",), ("created_at",), ("html_url",), ("reactions.total_count",)),
    "stories": (("id",), (), ("text",), ("by",), ("time",), ("url",), ("score",)),
    "launches": (("id",), (), ("commentBody", "body"), ("author.name", "author.username"), ("createdAt",), ("url",), ("votesCount",)),
    "videos": (
        ("snippet.topLevelComment.id", "id"), (), ("snippet.topLevelComment.snippet.textDisplay", "snippet.topLevelComment.snippet.textOriginal"), ("snippet.topLevelComment.snippet.authorDisplayName",),
        ("snippet.topLevelComment.snippet.publishedAt",), ("url",), ("snippet.topLevelComment.snippet.likeCount",),
    ),
}


def normalise(source: str, raw: DataFrame, comments: bool = False) -> DataFrame:
    """Raw documents: id (hash of source and external id), texts, author, created, url, score; deleted and dead items go.

    Comments have no title and ids of their own space.
    """
    paths = (COMMENTS if comments else ADAPTERS)[source]
    ext, title, content, author, created, url, score = (_j(*p) if p else F.lit(None).cast("string") for p in paths)
    live = raw.where(F.coalesce(_j("deleted"), F.lit("false")) != "true").where(F.coalesce(_j("dead"), F.lit("false")) != "true")
    blank = lambda c: F.coalesce(c, F.lit(""))
    space = f"{source}_comment" if comments else source
    return live.select(
        F.sha2(F.concat_ws(":", F.lit(space), ext), 256).alias("id"), ext.alias("external_id"), F.lit(source).alias("source"), F.lit("comment" if comments else "post").alias("source_type"), blank(title).alias("title"),
        blank(content).alias("content"), blank(author).alias("author"), blank(created).alias("created_at"), blank(url).alias("url"), score.try_cast("double").alias("score"), F.col("payload").alias("metadata"),
    )


def with_retry(call: Callable[[], object], attempts: int = 5, first_wait: float = 0.5, retry_on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep=time.sleep) -> object:
    """Exponential backoff on the errors named; the last one is raised."""
    for i in range(attempts):
        try:
            return call()
        except retry_on:
            if i == attempts - 1:
                raise
            sleep(first_wait * 2**i)
    raise AssertionError


class MinInterval:
    """At least ``seconds`` between calls."""

    def __init__(self, seconds: float, clock=time.monotonic, sleep=time.sleep):
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            self.sleep(self.seconds - (now - self.last))
        self.last = self.clock()
