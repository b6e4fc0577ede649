"""Evidence and problem signals: grouped observations, confidence formulas, exclusion reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import seeds


def signal_key(category: Column, canonical: Column, entity: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    joined = F.lower(F.concat_ws(":", blank(category), F.substring(blank(canonical), 1, 60), blank(entity)))
    return F.regexp_replace(joined, "^:+|:+$", "")


def keyed(obs: DataFrame) -> DataFrame:
    """Observations with signal_key and signal_text: the canonical value, or the first 60 characters of the value without one; rows without a key go."""
    text = F.coalesce(F.nullif(F.col("canonical_value"), F.lit("")), F.col("value"))
    o = obs.withColumn("signal_key", signal_key(F.col("category"), text, F.col("entity")))
    own = F.coalesce(F.nullif(F.col("canonical_value"), F.lit("")), F.substring("value", 1, 60))
    return o.withColumn("signal_text", own).where("signal_key != ''")


def evidence_confidence(docs: Column, diversity: Column, std: Column, avg_conf: Column, n: Column, base: float = 0.70) -> Column:
    part = lambda c, of: F.least(F.lit(1.0), c / of)
    c = base * 0.25 + part(docs, 100.0) * 0.20 + part(diversity, 8.0) * 0.15 + (1 - part(std, 2.5)) * 0.10 + F.least(F.lit(1.0), avg_conf) * 0.15 + part(n, 500.0) * 0.15
    return F.when(docs == 0, 0.0).otherwise(F.least(F.lit(1.0), c))


def evidence(obs: DataFrame, least: int = 3) -> DataFrame:
    """Observations (observation_id, document_id, platform, country, rating, confidence, category,
    canonical_value, value, entity, text_snippet) grouped by signal key; groups under ``least`` are dropped.

    Lists are bounded: the 100 least ids and the 5 longest snippets of a group come from ranked
    windows over ids and lengths, not from collecting the group.
    """
    o = keyed(obs)
    g = o.groupBy("signal_key").agg(
        F.min("category").alias("category"), F.min("entity").alias("entity"), F.count("*").alias("observation_count"), F.count_distinct("document_id").alias("document_count"),
        F.avg("rating").alias("avg_rating"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_std"), F.avg("confidence").alias("avg_confidence"),
        F.count_distinct("platform").alias("platforms"), F.count_distinct("country").alias("countries"), F.min("signal_text").alias("signal_text"),
    ).where(F.col("observation_count") >= least)
    conf = evidence_confidence(F.col("document_count"), F.col("platforms") + F.col("countries"), F.col("rating_std"), F.col("avg_confidence"), F.col("observation_count"))
    eid = F.substring(F.sha2(F.concat_ws(":", F.lit("ev"), "signal_key", F.coalesce("entity", F.lit(""))), 256), 1, 16)
    return g.withColumn("confidence", F.round(F.round(conf, 9), 4)).withColumn("evidence_id", eid)  # the order of a sum decides no half


def evidence_members(obs: DataFrame, ids: int = 100, snippets: int = 5, salts: int = 64) -> DataFrame:
    """signal_key, observation_ids (least first), top_snippets (longest first).

    Ranks are taken first within salted parts of a key and then among what those leave, so a key of any size meets in
    one task with at most ``salts * (ids + snippets)`` rows.
    """
    o = keyed(obs)
    o = o.select("signal_key", "observation_id", "text_snippet", F.pmod(F.xxhash64("observation_id"), F.lit(salts)).alias("salt"))
    for part in (["signal_key", "salt"], ["signal_key"]):
        by_id = F.row_number().over(Window.partitionBy(*part).orderBy("observation_id"))
        by_length = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(F.length("text_snippet")), "text_snippet", "observation_id"))
        o = o.withColumn("i", by_id).withColumn("l", by_length).where((F.col("i") <= ids) | (F.col("l") <= snippets))
    return o.groupBy("signal_key").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= ids, F.struct("i", "observation_id")))), lambda x: x["observation_id"]).alias("observation_ids"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("l") <= snippets, F.struct("l", "text_snippet")))), lambda x: x["text_snippet"]).alias("top_snippets"),
    )


def platform_distribution(obs: DataFrame, col: str = "platform") -> DataFrame:
    """Counts per key and platform, as a map; the keys of a map are the few platforms."""
    o = keyed(obs)
    c = o.where(F.col(col).isNotNull()).groupBy("signal_key", col).agg(F.count("*").alias("n"))
    return c.groupBy("signal_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))).alias("distribution"))


def adaptive_minimum(n: int, configured: int = 0) -> int:
    """max(3, int(log10(n))), lifted by the configured minimum."""
    return max(3, len(str(max(int(n), 1))) - 1, configured)


def exclusion_reason(least_docs: int, high_rating: float = 4.0) -> Column:
    """Why an evidence row is no signal; the first reason in this order wins, null means it is one."""
    text = F.lower(F.trim(F.coalesce("signal_text", F.lit(""))))
    entity = F.lower(F.coalesce("entity", F.lit("")))
    return (
        F.when(F.col("document_count") < least_docs, "low_documents")
        .when(F.col("avg_rating") > high_rating, "high_rating")
        .when(((text == entity) & (entity != "")) | text.isin([name.lower() for name, _, _ in seeds.ENTITIES]), "entity_only")
        .when(text.isin(list(seeds.GENERIC_PHRASES)), "generic_phrase")
        .when(F.coalesce("category", F.lit("")) == "", "no_category")
    )


def signals(ev: DataFrame, least_docs: int, min_confidence: float = 0.0) -> DataFrame:
    """Evidence merged by category and signal text: sums, weighted rating, the entity of most observations."""
    ok = ev.where(exclusion_reason(least_docs).isNull())
    rated = F.col("avg_rating").isNotNull()
    g = ok.groupBy("category", "signal_text").agg(
        F.count("*").alias("evidence_count"), F.sum("document_count").alias("document_count"), F.sum("observation_count").alias("observation_count"),
        (F.sum(F.col("avg_rating") * F.col("observation_count")) / F.sum(F.when(rated, F.col("observation_count")))).alias("avg_rating"), F.avg("avg_rating").alias("mean_rating"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),  # one of each entity
        F.avg("confidence").alias("evidence_confidence"), F.max(F.struct("observation_count", F.coalesce("entity", F.lit("")).alias("entity")))["entity"].alias("entity"),
    )
    rating = F.when(F.col("mean_rating").isNull(), 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("mean_rating") / 5.0))
    conf = F.col("evidence_confidence") * 0.35 + F.least(F.lit(1.0), F.col("evidence_count") / 5.0) * 0.20 + F.least(F.lit(1.0), F.col("document_count") / 500.0) * 0.25 + rating * 0.20
    return g.withColumn("confidence", F.round(F.round(F.least(F.lit(1.0), conf), 9), 4)).where(F.col("confidence") >= min_confidence)


def unresolved(obs: DataFrame, least: int = 2) -> DataFrame:
    """(value, n): values that nothing resolved, seen at least ``least`` times."""
    return obs.where(F.col("canonical_value").isNull() & F.col("entity").isNull()).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def discarded(ev: DataFrame, least_docs: int, most: int = 200) -> DataFrame:
    """A report of evidence that is no signal: the ``most`` rows of most documents, with the reason."""
    return ev.withColumn("reason", exclusion_reason(least_docs)).where("reason is not null").orderBy(F.desc("document_count"), "evidence_id").limit(most)
