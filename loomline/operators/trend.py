"""Trends: snapshots of counts over time, growth, momentum, detection, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions.text import any_contains
from loomline.session import materialise


def snapshots(events: DataFrame, subject: str, ts: str = "ts", value: str = "value", period: str = "week") -> DataFrame:
    """(snapshot, subject, observations, total): one partial aggregate."""
    return events.groupBy(F.date_trunc(period, ts).alias("snapshot"), F.col(subject).alias("subject")).agg(F.count("*").alias("observations"), F.sum(value).alias("total"))


def growth_pct(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise((now - before) / before * 100.0)


def growth(series: DataFrame, value: str = "observations", back: int = 1) -> DataFrame:
    """Adds prior, growth_pct, velocity (per day), acceleration, points; windows are by subject."""
    w = Window.partitionBy("subject").orderBy("snapshot")
    v, prior = F.col(value).cast("double"), F.coalesce(F.lag(value, back).over(w), F.lit(0)).cast("double")
    days = F.coalesce((F.unix_micros("snapshot") - F.unix_micros(F.lag("snapshot", back).over(w))) / F.lit(86400e6), F.lit(1.0))
    s = series.withColumn("prior", prior).withColumn("growth_pct", growth_pct(v, F.col("prior"))).withColumn("velocity", (v - F.col("prior")) / days)
    s = s.withColumn("acceleration", F.col("velocity") - F.coalesce(F.lag("velocity").over(w), F.lit(0.0)))
    return s.withColumn("points", F.row_number().over(w))


def momentum(g: Column, v: Column, a: Column, n: Column) -> Column:
    part = lambda c, of: F.least(F.abs(c) / of, F.lit(1.0))
    return part(g, 200.0) * 0.4 + part(v, 1000.0) * 0.3 + part(a, 100.0) * 0.2 + F.least(n / 10.0, F.lit(1.0)) * 0.1


def weighted_velocity(series: DataFrame, value: str = "observations") -> DataFrame:
    """(subject, velocity): consecutive velocities weighted by recency i / n."""
    w = Window.partitionBy("subject").orderBy("snapshot")
    n = F.count("*").over(Window.partitionBy("subject"))
    days = (F.unix_micros("snapshot") - F.unix_micros(F.lag("snapshot").over(w))) / F.lit(86400e6)
    s = series.withColumn("v", (F.col(value) - F.lag(value).over(w)) / days).withColumn("w", (F.row_number().over(w) - 1) / n).where("v is not null")
    return s.groupBy("subject").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("velocity"))


def last_points(series: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("subject").orderBy(F.desc("snapshot"))
    return series.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def compare(before: DataFrame, now: DataFrame, key: str = "subject", value: str = "observations") -> DataFrame:
    """Full outer comparison of two snapshots; a missing side counts 0."""
    a, b = before.select(F.col(key).alias("k1"), F.col(value).alias("prior")), now.select(F.col(key).alias("k2"), F.col(value).alias("current"))
    j = a.join(b, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), F.coalesce("prior", F.lit(0)).alias("prior"), F.coalesce("current", F.lit(0)).alias("current"))
    return j.withColumn("growth_pct", growth_pct(F.col("current").cast("double"), F.col("prior").cast("double")))


def classify(prior: Column, g: Column, least: float = 5.0) -> Column:
    """A subject without a past is emerging, whatever its growth."""
    return F.when(prior == 0, "emerging").when(g >= least, "growing").when(g <= -least, "declining").otherwise("stable")


def detect(series: DataFrame, least: float = 5.0) -> DataFrame:
    g = growth(series).withColumn("momentum", momentum(F.col("growth_pct"), F.col("velocity"), F.col("acceleration"), F.col("points")))
    g = g.withColumn("trend_type", classify(F.col("prior"), F.col("growth_pct"), least)).where(F.abs("growth_pct") >= least)
    conf = F.least(F.lit(1.0), F.col("points") / 10.0) * 0.5 + F.least(F.lit(1.0), F.col("observations") / 1000.0) * 0.5
    scores = F.least(F.abs("growth_pct") / 100.0, F.lit(1.0)) * 0.30 + F.least(F.abs("velocity") / 1000.0, F.lit(1.0)) * 0.20 + F.col("momentum") * 0.15 + conf * 0.10
    return g.withColumn("trend_score", F.least(scores, F.lit(1.0))).withColumn("trend_id", F.substring(F.sha2(F.concat_ws(":", "subject", F.date_format("snapshot", "yyyy-MM-dd")), 256), 1, 32))


def correlate(items: DataFrame, key: str, platforms: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """Pairs of items that share at least ``least`` platforms and ``share`` of the smaller list.

    The smaller list of a pair must share one of its rarest platforms (an exact prefix: with n platforms and r needed,
    the n - r + 1 rarest), so a platform that nearly all items have pairs only those that have little else.
    """
    p = items.select(F.col(key).alias("k"), F.explode(F.array_distinct(platforms)).alias("p"))
    often = p.groupBy("p").agg(F.count("*").alias("df"))
    p = p.join(often, "p")
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("k"))).withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("df", "p")))
    p = materialise(p.select("k", "p", "n", "place"), "correlate")
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * share))
    a, b = p.where(F.col("place") <= F.col("n") - need + 1).alias("a"), p.alias("b")
    once = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.k") < F.col("b.k")))
    pairs = a.join(b, (F.col("a.p") == F.col("b.p")) & once).select(F.col("a.k").alias("a"), F.col("a.n").alias("n"), F.col("b.k").alias("b")).distinct()
    lists = p.groupBy("k").agg(F.collect_list("p").alias("ps"))  # an item's own platforms
    both = pairs.join(lists.withColumnsRenamed({"k": "a", "ps": "pa"}), "a").join(lists.withColumnsRenamed({"k": "b", "ps": "pb"}), "b")
    shared = F.size(F.array_intersect("pa", "pb")).cast("long")
    return both.withColumn("shared", shared).where((F.col("shared") >= least) & (F.col("shared") >= F.col("n") * share)).select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "shared")


def row_pairs(items: DataFrame, key: str, products: str, companies: str, technologies: str) -> DataFrame:
    """(key, related, kind): product with company and technology with product of the same row."""
    pair = lambda left, right, kind: items.select(key, F.explode(F.array_distinct(left)).alias("a"), right).select(key, "a", F.explode(F.array_distinct(right)).alias("b")).select(key, F.concat_ws(":", "a", "b").alias("related"), F.lit(kind).alias("kind"))
    return pair(products, companies, "company_trend").unionByName(pair(technologies, products, "problem_technology"))


def entity_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(subject, n): how often each value occurs in the named columns together."""
    values = F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("subject")
    return df.select(values).where(F.coalesce("subject", F.lit("")) != "").groupBy("subject").agg(F.count("*").alias("n"))


# What in a subject's name tells its kind; the first that occurs wins.
KINDS = (
    ("product", ("product", "app")), ("company", ("company", "corp", "inc")), ("technology", ("tech", "framework", "language", "library")),
    ("category", ("category",)), ("feature", ("feature",)),
)


def subject_kind(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for kind, words in KINDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("problem")


def candidates(entities: DataFrame, totals: DataFrame, least: float = 5.0) -> DataFrame:
    """Trend candidates from (subject, prior, current) of entities and of totals (opportunities, observations, evidence, signals).

    An entity or a volume stays out if nothing changed, or both counts are 0; the opportunities' total stays in while there are any.
    """
    grown = lambda df: df.withColumn("growth_pct", growth_pct(F.col("current").cast("double"), F.col("prior").cast("double")))
    changed = (F.abs("growth_pct") >= least) | (F.col("prior") != F.col("current"))
    some = (F.col("prior") > 0) | (F.col("current") > 0)
    e = grown(entities).where(some & changed).withColumn("kind", subject_kind(F.col("subject")))
    t = grown(totals).where(some & ((F.col("subject") == "opportunities") | changed))
    name = F.when(F.col("subject") == "opportunities", F.col("subject")).otherwise(F.concat(F.lit("volume_"), "subject"))
    t = t.withColumn("kind", F.when(F.col("subject") == "opportunities", "opportunity").otherwise("signal")).withColumn("subject", name)
    cols = ["subject", "kind", "prior", "current", "growth_pct"]
    return e.select(*cols).unionByName(t.select(*cols)).withColumn("velocity", (F.col("current") - F.col("prior")).cast("double")).withColumn("trend_type", classify(F.col("prior"), F.col("growth_pct"), least))


def merge_scores(df: DataFrame, providers: list[dict[str, Column]]) -> DataFrame:
    """Scores by several providers in order; a later provider's score replaces an earlier one where it isn't 0."""
    merged: dict[str, Column] = {}
    for scores in providers:
        for name, value in scores.items():
            new = F.nullif(F.round(value, 4), F.lit(0.0))
            merged[name] = F.coalesce(new, merged.get(name, F.lit(0.0)))
    return df.withColumns(merged)


def confidence_score(confidence: Column, snapshots_: Column, observations: Column) -> Column:
    return confidence * 0.4 + F.least(snapshots_ / 10.0, F.lit(1.0)) * 0.3 + F.least(observations / 1000.0, F.lit(1.0)) * 0.3


# Weights of a trend's composite score.
SCORE_WEIGHTS = {"growth": 0.30, "velocity": 0.20, "momentum": 0.15, "confidence": 0.10, "seasonality": 0.05, "anomaly": 0.10, "cross_platform": 0.10}


def composite_score(weights: dict[str, float] = SCORE_WEIGHTS) -> Column:
    """Of columns ``growth_score``, ``velocity_score``, ... (those that are missing must be 0 columns)."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(f"{name}_score") * w
    return F.least(total, F.lit(1.0))


def search(trends: DataFrame, kind: str | None = None, least_score: float | None = None, most_score: float | None = None, least_growth: float | None = None, subject: str | None = None, subject_kind_: str | None = None, contains: dict[str, str] | None = None, cross_platform: str | None = None) -> DataFrame:
    """Filters over trends: type, score and growth bounds, subject, case-blind substrings of list columns, and at least two platforms."""
    out = trends if kind is None else trends.where(F.col("trend_type") == kind)
    out = out if least_score is None else out.where(F.col("trend_score") >= least_score)
    out = out if most_score is None else out.where(F.col("trend_score") <= most_score)
    out = out if least_growth is None else out.where(F.col("growth_pct") >= least_growth)
    out = out if subject is None else out.where(F.col("subject") == subject)
    out = out if subject_kind_ is None else out.where(F.col("kind") == subject_kind_)
    for col, part in (contains or {}).items():
        out = out.where(any_contains(col, part))
    return out if cross_platform is None else out.where(F.size(F.array_distinct(cross_platform)) >= 2)


def issues(trends: DataFrame, snapshots_: DataFrame | None = None) -> DataFrame:
    """(code, n): repeated ids, growth over 50,000 %, direction against growth, snapshots that aren't known."""
    one = lambda df, code: df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    wrong = ((F.col("trend_type").isin("growing", "emerging")) & (F.col("growth_pct") < 0)) | ((F.col("trend_type") == "declining") & (F.col("growth_pct") > 0))
    repeats = trends.groupBy("trend_id").count().where("count > 1").select((F.col("count") - 1).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).select(F.lit("duplicate_id").alias("code"), "n")
    out = repeats.unionByName(one(trends.where("growth_pct > 50000"), "excess_growth")).unionByName(one(trends.where(wrong), "inconsistent_direction"))
    if snapshots_ is not None:
        out = out.unionByName(one(trends.join(snapshots_.select("snapshot").distinct(), "snapshot", "left_anti"), "unknown_snapshot"))
    return out


def summary(trends: DataFrame) -> DataFrame:
    """trend_type, n, and mean, least and largest score of each."""
    return trends.groupBy("trend_type").agg(F.count("*").alias("n"), F.avg("trend_score").alias("mean"), F.min("trend_score").alias("least"), F.max("trend_score").alias("most"))
