"""Documents in: cleaning, rejecting, first-seen dedup, validation, statistics, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomline.functions import text as T
from loomline.operators.joins import join_hot
from loomline.session import materialise


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean_text and content_hash, written once; the few texts that need a Python function pass it apart from the others."""
    hashed = lambda df: df.withColumn("content_hash", T.content_hash(F.col("clean_text")))
    rare = T.is_rare(F.col(text))
    rows = materialise(hashed(docs.withColumn("clean_text", F.when(~rare, T.clean(F.col(text))))).withColumn("_rare", rare), "intake-clean")
    odd = rows.where("_rare").drop("_rare")
    plain = rows.where("not _rare").drop("_rare")
    if odd.isEmpty():
        return plain
    return plain.unionByName(materialise(hashed(odd.withColumn("clean_text", T.clean_rare(F.col(text)))), "intake-rare"))


def intake(docs: DataFrame, min_chars: int = 10, max_chars: int = 100_000, languages: tuple[str, ...] = (), id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Adds clean_text, content_hash, is_duplicate and reason (null if the row stays); the first reason wins.

    First seen is the least id of a content hash. Texts are cleaned and hashed once, and written. Copied hashes and
    their least ids come from a partial aggregate; hashes with very many copies are then joined by broadcast (join_hot).
    """
    rows = clean(docs)
    copied = rows.groupBy("content_hash").agg(F.min(id_col).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    rows = join_hot(rows, materialise(copied, "intake-copies"), "content_hash", "_copies")
    rows = rows.withColumn("is_duplicate", F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))).drop("_first")
    unsupported = ~F.coalesce(F.col(lang_col).isin(list(languages)), F.lit(False)) if languages else F.lit(False)
    reason = (
        F.when(F.col("clean_text").isNull(), "clean_error")
        .when(F.col("clean_text") == "", "empty")
        .when(F.length(F.trim("clean_text")) < min_chars, "too_short")
        .when(F.length("clean_text") > max_chars, "too_long")
        .when(F.col("is_duplicate"), "duplicate")
        .when(unsupported, "unsupported_language")
    )
    return rows.withColumn("reason", reason)


def split_rejected(marked: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept documents, rejected rows with preview and length)."""
    rejected = marked.where("reason is not null").select(id_col, "reason", F.substring("text", 1, 200).alias("text_preview"), F.length("text").alias("original_length"))
    return marked.where("reason is null").drop("reason", "is_duplicate"), rejected


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: an aggregate, combined before the shuffle, so a hot key is no hot task."""
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")


def validate(raw: DataFrame, now=None) -> DataFrame:
    """Adds reasons (all that apply, in fixed order) and valid; raw has id, external_id, source, title, content, created, updated."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    # The first of an id is that with the least ordinal; ids with very many rows (blank ones) don't meet in one task.
    many = raw.groupBy(F.coalesce("id", F.lit("")).alias("_id")).agg(F.min("ordinal").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    raw = join_hot(raw.withColumn("_id", F.coalesce("id", F.lit(""))), materialise(many, "validate-ids"), "_id", "_rows")
    repeat = F.coalesce(F.col("ordinal") > F.col("_first"), F.lit(False))
    checks = (
        (blank("id"), "missing_id"), (blank("external_id"), "missing_external_id"), (blank("source"), "missing_source"), (repeat, "duplicate_id"),
        (blank("title") & blank("content"), "empty_content"), (F.col("created") > now, "future_created"), (F.col("updated") > now, "future_updated"),
    )
    out = raw.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks])))
    return out.withColumn("valid", F.size("reasons") == 0).drop("_id", "_first")


def enrich(df: DataFrame, text: str = "content", title: str = "title") -> DataFrame:
    """language (of the first 500 characters), content_length, title_length."""
    return df.withColumns({"language": T.language_guess(F.substring(text, 1, 500)), "content_length": F.length(F.coalesce(F.col(text), F.lit(""))), "title_length": F.length(F.coalesce(F.col(title), F.lit("")))})


def field_types(df: DataFrame, json_col: str) -> DataFrame:
    """How often each field of a JSON column has each type."""
    pairs = F.explode(F.from_json(json_col, "map<string,string>")).alias("field", "value")
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?\d+$"), "int").when(F.col("value").rlike(r"^-?\d*\.\d+$"), "float").when(F.col("value").isin("true", "false"), "bool").otherwise("string")
    return df.select(pairs).select("field", kind.alias("kind")).groupBy("field", "kind").agg(F.count("*").alias("n"))


def search(docs: DataFrame, query: str = "", platform: str | None = None, country: str | None = None, rating: tuple[float, float] | None = None, text: str = "text", limit: int | None = None, order: str = "doc_id", cols: dict | None = None) -> DataFrame:
    """Literal substring, equality and closed-range filters; nulls never match."""
    name = {"platform": "platform", "country": "country", "rating": "rating"} | (cols or {})
    out = docs.where(F.col(text).contains(query)) if query else docs
    out = out.where(F.col(name["platform"]) == platform) if platform else out
    out = out.where(F.col(name["country"]) == country) if country else out
    out = out.where(F.col(name["rating"]).between(*rating)) if rating else out
    return out.orderBy(order).limit(limit) if limit else out


def statistics(docs: DataFrame, cols: list[str]) -> DataFrame:
    """One row a column: rows, missing (null or blank) and their percentage, distinct values."""
    parts = [F.count("*").alias("n")]
    for c in cols:
        missing = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        parts += [F.sum(missing.cast("long")).alias(f"m_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    one = docs.agg(*parts)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("n"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct_values")) for c in cols]))
    return one.select(rows.alias("r")).select("r.*").withColumn("missing_pct", F.round(F.col("missing") * 100.0 / F.col("n"), 4))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    """n, distinct values, their ratio, nulls, and entropy in bits of one column."""
    c = df.groupBy(col).agg(F.count("*").alias("c"))
    known = F.col(col).isNotNull()
    total = F.sum(F.when(known, F.col("c")))
    # H = log2(N) - sum(c log2 c) / N needs no join with the total.
    bits = F.log2(total) - F.sum(F.when(known, F.col("c") * F.log2("c"))) / total
    return c.agg(F.sum("c").alias("n"), F.sum(known.cast("long")).alias("distinct_values"), F.round(F.sum(known.cast("long")) / total, 6).alias("distinct_ratio"), F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("nulls"), F.round(bits, 6).alias("entropy"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """min, max, mean, population deviation, and index quantiles: the values at n div 2 and int(p (n - 1)).

    Quantiles come from the running total of counts of distinct values: within range partitions, from what the
    partitions before hold. Only one row a partition meets in one task.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
    c = materialise(c.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "distribution")
    held = c.groupBy("p").agg(F.sum("c").alias("held"))
    before = F.sum("held").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    held = held.select("p", before.alias("before"), F.sum("held").over(Window.partitionBy()).alias("n"))
    inside = F.sum("c").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = c.withColumn("inside", inside).join(F.broadcast(held), "p").withColumn("upto", F.col("before") + F.col("inside"))  # one row a partition
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    n = F.col("n")
    return run.agg(
        F.max("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(F.floor(n / 2)).alias("median"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("c")) / F.sum("c") - F.pow(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 2))), 4).alias("std"),
        at(F.floor(F.lit(0.25) * (n - 1))).alias("p25"), at(F.floor(F.lit(0.75) * (n - 1))).alias("p75"),
    )


def histogram(df: DataFrame, col: str, bins: int = 10, closed: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; ``closed`` puts max into the last bin, else the last edge is max + 1e-4."""
    v = F.col(col).cast("double")
    edge = df.agg(F.min(v).alias("lo"), (F.max(v) + F.lit(0.0 if closed else 1e-4)).alias("hi")) if low is None else df.sparkSession.createDataFrame([(float(low), float(high))], "lo double, hi double")
    rows = df.where(v.isNotNull()).select(v.alias("v")).join(F.broadcast(edge))  # one row
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    return rows.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, stratum: str, most: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``most // strata`` rows of each stratum, by hash order; the same rows on every run."""
    strata = df.select(stratum).distinct().count()
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most // max(1, strata)).drop("_rn")


def simple_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def choose_text(docs: DataFrame, preferred: tuple[str, ...] = ("clean_text", "text", "content", "title"), out: str = "chosen_text") -> DataFrame:
    """Adds the text to read: the preferred text columns that are there, else all string columns, joined by spaces without blanks."""
    names = [c for c in preferred if c in docs.columns] or [c for c, t in docs.dtypes if t == "string"]
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return docs.withColumn(out, F.concat_ws(" ", *[blank(c) for c in names]) if names else F.lit(""))


def distinct_values(docs: DataFrame, col: str) -> DataFrame:
    """Known values of a column, sorted."""
    return docs.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)
