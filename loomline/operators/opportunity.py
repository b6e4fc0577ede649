"""Opportunities: candidates, neighbourhoods, scores, rank, greedy dedup, recommendations, search, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import seeds, text as T
from loomline.session import materialise

# Weights of the composite score.
WEIGHTS = {
    "pain_severity": 0.20, "frequency": 0.15, "trend": 0.10, "evidence_count": 0.10, "reasoning_confidence": 0.10, "cluster_density": 0.08,
    "cross_platform": 0.07, "market_coverage": 0.05, "competition": 0.05, "feasibility": 0.05, "novelty": 0.05,
}
# Least score of each recommendation.
RECOMMENDATIONS = ((0.75, "strong_pursue"), (0.50, "worth_exploring"), (0.30, "niche_potential"), (0.10, "monitor"))


def candidates(root_causes: DataFrame, evidence: DataFrame, clusters: DataFrame) -> DataFrame:
    """Root causes, then evidence no root cause covers, then clusters neither covers (key, title, reasoning_confidence, evidence_count each)."""
    rest = evidence.join(root_causes.select("key"), "key", "left_anti")
    last = clusters.join(root_causes.select("key"), "key", "left_anti").join(evidence.select("key"), "key", "left_anti")
    all_ = root_causes.withColumn("origin", F.lit("root_cause")).unionByName(rest.withColumn("origin", F.lit("evidence"))).unionByName(last.withColumn("origin", F.lit("cluster")))
    return all_.where((F.col("reasoning_confidence") >= 0.20) | (F.col("evidence_count") >= 2))


def linked(roots: DataFrame, evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates (key, path) with evidence_count and evidence_ids (conclusions on the key or its path), cluster_ids, and cluster_density (0.5 without).

    ``members`` has node, cluster and density. A path is short, so a candidate's lists are too.
    """
    at = roots.select("key", F.explode(F.array_union("path", F.array("key"))).alias("node"))
    ids = at.join(evidence.select(F.col("conclusion").alias("node")).distinct(), "node").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("evidence_ids"))
    held = at.join(members, "node").groupBy("key").agg(F.array_sort(F.collect_set("cluster")).alias("cluster_ids"), F.avg("density").alias("d"))
    out = roots.select("key").join(ids, "key", "left").join(held, "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "key", F.size(F.coalesce("evidence_ids", none)).alias("evidence_count"), F.coalesce("evidence_ids", none).alias("evidence_ids"), F.coalesce(F.col("cluster_ids").cast("array<string>"), none).alias("cluster_ids"),
        F.coalesce("d", F.lit(0.5)).alias("cluster_density"),
    )


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def market_scores(platforms: Column) -> dict[str, Column]:
    combined = F.col("product_count") + F.col("company_count")
    market = F.least(F.lit(1.0), combined / F.greatest(combined, F.lit(5)) + F.col("platform_count") / F.greatest(platforms, F.lit(1))) * 0.5
    feasible = F.least(F.lit(1.0), F.col("evidence_n") / F.greatest(F.col("evidence_n"), F.lit(10)) + 0.3)
    return {"market_coverage": F.round(market, 4), "feasibility": F.round(feasible, 4)}


def trend_scores(recent: Column, rise: Column) -> dict[str, Column]:
    """By the share of recent evidence, its count and its growth."""
    return {"trend": F.round(clamp(recent * 0.4 + F.least(F.lit(1.0), F.col("evidence_n") / 20.0) * 0.3 + clamp(rise) * 0.3), 4)}


def competition_scores(entities: Column) -> dict[str, Column]:
    """By the share of all known products and companies that an opportunity touches: dense ones compete more and are less new."""
    density = (F.col("product_count") + F.col("company_count")) / F.greatest(entities, F.lit(1))
    novelty = 1.0 - F.least(F.lit(1.0), density * 2)
    return {"competition": F.round(1.0 - novelty, 4), "novelty": F.round(novelty, 4)}


def breakdown(c: DataFrame, most_evidence: Column, platforms: Column, entities: Column, recent: Column | None = None, rise: Column | None = None) -> DataFrame:
    """The eleven factors from candidate columns (severity, frequency_score, trend_score, evidence_n, ...).

    The weighted provider comes first; market, trend (where recent share and growth are given) and competition follow, and a
    later provider's factor replaces an earlier one where it isn't 0.
    """
    spread = F.least(F.lit(1.0), F.col("platform_count") / F.greatest(platforms, F.lit(1)))
    factors = {
        "pain_severity": F.col("severity"), "frequency": F.col("frequency_score"), "trend": F.col("trend_score"), "evidence_count": F.least(F.lit(1.0), F.col("evidence_n") / F.greatest(most_evidence, F.lit(1))),
        "reasoning_confidence": F.col("confidence"), "cluster_density": F.col("density"), "cross_platform": spread,
        "market_coverage": F.lit(0.0), "competition": F.lit(0.5), "feasibility": F.lit(0.5), "novelty": F.lit(0.5),
    }
    later = market_scores(platforms) | (trend_scores(recent, rise) if recent is not None else {}) | competition_scores(entities)
    factors |= {name: F.coalesce(F.nullif(value, F.lit(0.0)), factors[name]) for name, value in later.items()}
    return c.withColumns({name: clamp(value) for name, value in factors.items()})


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(weights.values()) or 1.0
    return reduce(lambda a, b: a + b, [F.col(k) * (w / total) for k, w in weights.items()])


def final_confidence() -> Column:
    return clamp(F.col("reasoning_confidence") * 0.40 + F.col("evidence_count") * 0.30 + F.col("cluster_density") * 0.15 + F.col("market_coverage") * 0.15)


def market_size(n: Column) -> Column:
    return F.when(n >= 50, "large").when(n >= 20, "medium").when(n >= 5, "small").otherwise("unknown")


def recommendation(score: Column) -> Column:
    return reduce(lambda c, r: c.when(score >= r[0], r[1]), RECOMMENDATIONS[1:], F.when(score >= RECOMMENDATIONS[0][0], RECOMMENDATIONS[0][1])).otherwise("insufficient_data")


def business_model(text: Column) -> Column:
    """The model with the largest share of its keywords in the text, the first of equals; saas without any."""
    shares = [T.keyword_share(text, words) for _, words in seeds.BUSINESS_MODELS]
    best = F.greatest(*shares)
    pick = reduce(lambda c, x: c.when(x[1] == best, x[0]), [(m[0], s) for m, s in zip(seeds.BUSINESS_MODELS[1:], shares[1:])], F.when(shares[0] == best, seeds.BUSINESS_MODELS[0][0]))
    return F.when(best <= 0, "saas").otherwise(pick)


def solution(model: Column, problem: Column, evidence: Column, platforms: Column, confidence: Column) -> Column:
    text = F.format_string("A %s that addresses '%s', validated by %d evidence sources across %d platforms with a confidence score of %s%%.", T.title_case(model), problem, evidence, platforms, F.round(confidence * 100).cast("int").cast("string"))
    return F.substring(text, 1, 500)


#: Orders of the ranking strategies.
STRATEGIES = {"composite": "opportunity_score", "severity": "pain_severity", "market": "market_coverage", "feasibility": "feasibility", "confidence": "final_confidence"}


def rank(df: DataFrame, strategy: str, top: int, key: str = "key") -> DataFrame:
    """The ``top`` rows of a strategy with their rank and the status ranked, ties by key."""
    order = [F.desc(STRATEGIES[strategy]), F.col(key)]
    return df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("status", F.lit("ranked"))  # a top-k report


def suppress_duplicates(rows: DataFrame, score: str, key: str = "key", evidence: str = "evidence", overlap: float = 0.85, rounds: int = 100) -> DataFrame:
    """``rows`` less those whose evidence overlaps that of a kept, better row by Jaccard ``overlap``; better is a higher score, then a lower key.

    Rows of equal evidence are one class, kept by its best row. Overlapping classes meet by the rarest items of the smaller
    set, as many as it must share (an exact prefix). Then, round by round, a class without a better undecided neighbour is
    kept and its neighbours go, which is what going through the rows in order would keep. Rows without evidence all stay.
    """
    listed = rows.withColumn("_set", F.array_sort(F.array_distinct(evidence)))
    full = listed.where(F.size("_set") > 0)
    named = full.withColumn("_class", F.sha2(F.to_json(F.struct("_set")), 256))
    place = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    classes = materialise(named.groupBy("_class").agg(F.min(place).alias("at"), F.first("_set").alias("items")).withColumn("n", F.size("items")), "dedup-classes")
    items = classes.select("_class", "n", F.explode("items").alias("item"))
    items = items.join(items.groupBy("item").agg(F.count("*").alias("df")), "item")
    place = F.row_number().over(Window.partitionBy("_class").orderBy("df", "item"))
    items = materialise(items.select("_class", "n", "item", place.alias("place")), "dedup-items")
    # A partner of at least the same size: so many items of the smaller set are common.
    a, b = items.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * overlap / (1 + overlap))) + 1).alias("a"), items.alias("b")
    sized = (F.col("a.n") >= F.col("b.n") * overlap) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a._class") < F.col("b._class"))))
    pairs = a.join(b, (F.col("a.item") == F.col("b.item")) & sized).select(F.col("a._class").alias("x"), F.col("b._class").alias("y")).distinct()
    side = lambda c: classes.select(F.col("_class").alias(c), F.col("items").alias(f"{c}_items"), F.col("at").alias(f"{c}_at"))
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    common = F.size(F.array_intersect("x_items", "y_items"))
    met = met.where(common >= (F.size("x_items") + F.size("y_items") - common) * overlap)
    better = F.col("x_at") < F.col("y_at")
    edges = materialise(met.select(F.when(better, F.col("x")).otherwise(F.col("y")).alias("better"), F.when(better, F.col("y")).otherwise(F.col("x")).alias("worse")), "dedup-edges")
    left = edges
    gone = edges.select(F.col("worse").alias("_class")).where(F.lit(False))
    for _ in range(rounds):
        if left.isEmpty():
            break
        stays = left.select(F.col("better").alias("_class")).distinct().join(left.select(F.col("worse").alias("_class")), "_class", "left_anti")
        out = materialise(left.join(stays.withColumnRenamed("_class", "better"), "better", "left_semi").select(F.col("worse").alias("_class")).distinct(), "dedup-gone")
        gone = gone.unionByName(out)
        left = materialise(left.join(out.withColumnRenamed("_class", "worse"), "worse", "left_anti").join(out.withColumnRenamed("_class", "better"), "better", "left_anti"), "dedup-left")
    else:
        raise RuntimeError(f"duplicates remain undecided after {rounds} rounds")
    kept = classes.join(gone.distinct(), "_class", "left_anti").select(F.col("at.k").alias("k"))
    return full.join(kept, F.col(key) == F.col("k"), "left_semi").unionByName(listed.where("_set is null or size(_set) = 0")).drop("_set")


def text_search(df: DataFrame, words: str, title: str, summary: str, label: str, lists: list[str], top: int, key: str) -> DataFrame:
    """title 3 + summary 2 + label 2 + any list 1, case-blind; only hits."""
    q = words.lower()
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    in_lists = reduce(lambda a, b: a | b, [F.exists(c, lambda x: F.lower(x).contains(q)) for c in lists]) if lists else F.lit(False)
    score = F.when(has(title), 3).otherwise(0) + F.when(has(summary), 2).otherwise(0) + F.when(has(label), 2).otherwise(0) + F.when(F.coalesce(in_lists, F.lit(False)), 1).otherwise(0)
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def neighbourhoods(edges: DataFrame, problems: DataFrame, most: int = 50, rounds: int = 8) -> DataFrame:
    """(problem, node, depth): what lies around each problem (one column, problem), both ways, nearest first, ``most`` nodes each.

    The problem itself is its first node. Frontiers are cut to what still has a place, so a hub costs ``most`` rows a problem.
    """
    hops = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct(), "hood-hops")
    # Of a hub's neighbours no more than ``most`` and those already seen can be needed.
    near = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    hops = materialise(hops.withColumn("i", near).where(F.col("i") <= 2 * most).drop("i"), "hood-near")
    seen = front = materialise(problems.select("problem", F.col("problem").alias("node"), F.lit(0).alias("depth")).distinct(), "hood")
    order = F.row_number().over(Window.partitionBy("problem").orderBy("depth", "node"))
    for depth in range(1, rounds + 1):
        new = front.join(hops, F.col("node") == F.col("src")).select("problem", F.col("dst").alias("node")).distinct().join(seen.select("problem", "node"), ["problem", "node"], "left_anti")
        held = seen.groupBy("problem").agg(F.count("*").alias("held"))
        new = new.withColumn("depth", F.lit(depth)).withColumn("i", order).join(held, "problem").where(F.col("i") + F.col("held") <= most)
        front = materialise(new.select("problem", "node", "depth"), "hood-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def around(hoods: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("product", "company", "technology")) -> DataFrame:
    """problem, a sorted list of labels per kind (``affected_products``, ...) and ``platform_count``: distinct source assets next to the neighbourhood, at least 1."""
    plural = {"product": "products", "company": "companies", "technology": "technologies"}
    at = hoods.join(nodes.select(F.col("node_id").alias("node"), "node_type", "label"), "node")
    named = at.groupBy("problem").agg(*[F.array_sort(F.collect_set(F.when((F.col("node_type") == k) & (F.col("label") != ""), F.col("label")))).alias(f"affected_{plural[k]}") for k in kinds])  # a bounded neighbourhood
    hops = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    assets = hops.join(nodes.select(F.col("node_id").alias("dst"), "source_asset"), "dst").select(F.col("src").alias("node"), "source_asset").distinct()
    spread = hoods.join(assets, "node").groupBy("problem").agg(F.count_distinct("source_asset").alias("spread"))
    out = hoods.select("problem").distinct().join(named, "problem", "left").join(spread, "problem", "left")
    return out.withColumn("platform_count", F.greatest(F.coalesce("spread", F.lit(0)), F.lit(1)).cast("long")).drop("spread")


def with_lists(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose list columns hold a value that contains the wanted text, case-blind; all must."""
    for col, part in wanted.items():
        df = df.where(T.any_contains(col, part))
    return df


def in_cluster(df: DataFrame, cluster, col: str = "cluster_ids") -> DataFrame:
    return df.where(F.array_contains(col, cluster))


def issues(opportunities: DataFrame, key: str = "key", score: str = "opportunity_score", evidence: str = "evidence", chains: str | None = None, known_chains: DataFrame | None = None) -> DataFrame:
    """(code, severity, n): repeated ids, missing evidence, scores out of range, zero confidence beside a score, unknown chains."""
    bad = {
        "invalid_score": ("ERROR", ~F.col(score).between(0.0, 1.0)), "missing_evidence": ("WARN", F.coalesce(F.size(evidence), F.lit(0)) <= 0),
        "missing_confidence": ("WARN", (F.col("final_confidence") == 0) & (F.col(score) > 0)),
    }
    one = opportunities.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, (_, c) in bad.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.lit(sev).alias("severity"), F.col(k).alias("n")) for k, (sev, _) in bad.items()]))
    out = one.select(rows.alias("r")).select("r.*")
    repeated = opportunities.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("code"), F.lit("ERROR").alias("severity"), "n")
    out = out.unionByName(repeated)
    if chains:
        unknown = opportunities.select(F.explode(chains).alias("chain")).join(known_chains.select("chain"), "chain", "left_anti")
        out = out.unionByName(unknown.agg(F.count("*").alias("n")).select(F.lit("broken_reference").alias("code"), F.lit("WARN").alias("severity"), "n"))
    return out


def summary(opportunities: DataFrame, score: str = "opportunity_score") -> DataFrame:
    """recommendation, n and mean, least and largest score of each."""
    return opportunities.withColumn("recommendation", recommendation(F.col(score))).groupBy("recommendation").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))
