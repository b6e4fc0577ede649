"""Readers: format dispatch, loader detection, the unified document schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomline.functions import text as T

UNIFIED = (
    "id", "platform", "source_dataset", "title", "text", "clean_text", "author", "rating", "country", "location", "language", "created_at", "metadata", "raw_record", "document_length",
)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reads by suffix: csv, parquet, json (an array), jsonl or ndjson; anything else is an error."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, mode="PERMISSIVE", multiLine=True, escape='"', samplingRatio=1.0)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "json":
        return spark.read.json(path, multiLine=True)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    raise ValueError(f"no reader for .{suffix}")


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The header alone."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True).columns
    return read_any(spark, path).columns


def first_json(c: str, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(c, f"$.{n}") for n in names])


def to_unified(df: DataFrame, mapping: dict[str, str | Column], dataset: str) -> DataFrame:
    """The unified document schema; fields without a source are empty strings, rating is null."""
    col = {k: F.col(v) if isinstance(v, str) else v for k, v in mapping.items()}
    text = F.coalesce(col["text"].cast("string"), F.lit(""))
    made = {"source_dataset": F.lit(dataset), "raw_record": F.to_json(F.struct("*")), "metadata": F.lit("{}"), "document_length": F.length(text)}
    out = []
    for name in UNIFIED:
        if name == "rating":
            value = F.round(F.least(F.greatest(col[name].cast("double"), F.lit(0.0)), F.lit(5.0)), 1) if name in col else F.lit(None).cast("double")
        elif name in col:
            value = F.coalesce(col[name].cast("string"), F.lit(""))
        else:
            value = made.get(name, F.lit(""))
        out.append(value.alias(name))
    return df.select(*out)


@dataclass(frozen=True)
class Loader:
    name: str
    needs: frozenset

    def load(self, df: DataFrame) -> DataFrame:
        return _LOADERS[self.name][1](df)


def _reviews_a(df: DataFrame) -> DataFrame:
    """Ratings like "Rated 4 out of 5 stars", ISO dates."""
    made = T.to_time(F.regexp_replace("Review Date", "Z$", "+00:00"), ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd"))
    extra = F.to_json(F.struct(*[F.col(c) for c in ("Review Count", "Date of Experience", "Profile Link") if c in df.columns]))
    m = {"text": "Review Text", "title": "Review Title", "author": "Reviewer Name", "country": "Country", "rating": T.first_number(F.col("Rating").cast("string")), "created_at": made.cast("string"), "metadata": extra, "platform": F.lit("reviews_a")}
    return to_unified(df, {k: v for k, v in m.items() if not isinstance(v, str) or v in df.columns}, "reviews_a")


def _reviews_b(df: DataFrame) -> DataFrame:
    made = T.to_time(F.col("date").cast("string"), ("yyyy-MM-dd", "dd-MM-yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return to_unified(df, {"id": "review_id", "text": "text", "author": "user_id", "rating": F.col("stars").cast("double"), "created_at": made.cast("string"), "platform": F.lit("reviews_b")}, "reviews_b")


def _social(df: DataFrame) -> DataFrame:
    if "clean_text" in df.columns:
        return to_unified(df, {"text": "clean_text", "metadata": F.to_json(F.struct("category")), "platform": F.lit("social")}, "social")
    return to_unified(df, {"text": "text", "location": "Location", "metadata": F.to_json(F.struct("type")), "platform": F.lit("social")}, "social")


def _forum(df: DataFrame) -> DataFrame:
    return to_unified(df, {"text": "clean_comment", "metadata": F.to_json(F.struct("category")), "platform": F.lit("forum")}, "forum")


#: In order of registration; the first whose columns are all there wins. The column names are fixed values.
_LOADERS: dict = {}


def register_loader(name: str, needs: set[str], load) -> None:
    _LOADERS[name] = (frozenset(needs), load)


register_loader("reviews_a", {"Reviewer Name", "Rating", "Review Text"}, _reviews_a)
register_loader("reviews_b", {"review_id", "stars", "text"}, _reviews_b)
register_loader("social", {"business_id", "Location", "type", "text"}, _social)
register_loader("social_2", {"clean_text", "category"}, _social)
register_loader("forum", {"clean_comment", "category"}, _forum)


def detect(columns: list[str]) -> Loader:
    for name, (needs, _) in _LOADERS.items():
        if needs <= set(columns):
            return Loader(name, needs)
    raise ValueError(f"no loader knows the columns {sorted(columns)}")


def load_directory(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame | None, dict[str, str]]:
    """All files of a list, or all .csv files of a folder in order, that can be read, as one unified table without rows of no text; and errors by path.

    Files of the same columns are read together, each family by one scan, so the plan grows with the kinds of files only. A
    file that can't be read, or that no loader knows, is an error of its own.
    """
    if isinstance(paths, str):
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(paths).select("path").collect()  # names alone: the content isn't read
        paths = [r["path"] for r in listed]
    families: dict[tuple, list[str]] = {}
    errors: dict[str, str] = {}
    for path in sorted(paths):
        try:
            columns = columns_of(spark, path)
            detect(columns)
            families.setdefault((path.rpartition(".")[2].lower(), tuple(columns)), []).append(path)
        except Exception as e:  # one bad file doesn't stop the others; its error is returned
            errors[path] = str(e).splitlines()[0]
    out = None
    for (suffix, columns), files in families.items():
        df = read_any(spark, files[0]) if len(files) == 1 else _read_files(spark, suffix, files)
        part = detect(list(columns)).load(df).where(F.trim("text") != "")
        out = part if out is None else out.unionByName(part)
    return out, errors


def _read_files(spark: SparkSession, suffix: str, files: list[str]) -> DataFrame:
    if suffix == "csv":
        return spark.read.csv(files, header=True, inferSchema=True, mode="PERMISSIVE", multiLine=True, escape='"')
    return spark.read.parquet(*files) if suffix == "parquet" else spark.read.json(files, multiLine=suffix == "json")


def latest_per_source(files: DataFrame, source: str = "source", order: str = "day") -> DataFrame:
    """The newest file of each source, from a listing."""
    w = Window.partitionBy(source).orderBy(F.desc(order))
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
