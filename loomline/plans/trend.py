"""Queries: trends, opportunities, evaluation, relational checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import evaluation as H, evidence as V, opportunity as O, trend as N
from loomline.plans.extract import _REASON, SIGNALS_SQL, observations
from loomline.plans.registry import query, table
from loomline.session import materialise

_S = "s AS (SELECT date_trunc('week', ts)::TIMESTAMP AS snapshot, event_type AS subject, count(*) AS observations, sum(value) AS total FROM events GROUP BY ALL)"


def series(spark, d):
    return N.snapshots(table(spark, d, "events"), "event_type")


@query("snapshots", f"WITH {_S} SELECT strftime(snapshot, '%Y-%m-%d') AS week, subject, observations, round(total, 4) AS total FROM s")
def snapshots(spark, d):
    return series(spark, d).select(F.date_format("snapshot", "yyyy-MM-dd").alias("week"), "subject", "observations", F.round("total", 4).alias("total"))


_GROW = f"""{_S}, l AS (SELECT *, coalesce(lag(observations) OVER w, 0)::DOUBLE AS prior, coalesce(epoch(snapshot - lag(snapshot) OVER w) / 86400.0, 1.0) AS days, row_number() OVER w AS points FROM s WINDOW w AS (PARTITION BY subject ORDER BY snapshot)),
v AS (SELECT *, CASE WHEN prior = 0 THEN CASE WHEN observations = 0 THEN 0.0 ELSE 100.0 END ELSE (observations - prior) / prior * 100.0 END AS growth_pct, (observations - prior) / days AS velocity FROM l),
a AS (SELECT *, velocity - coalesce(lag(velocity) OVER (PARTITION BY subject ORDER BY snapshot), 0.0) AS acceleration FROM v),
m AS (SELECT *, least(abs(growth_pct) / 200.0, 1.0) * 0.4 + least(abs(velocity) / 1000.0, 1.0) * 0.3 + least(abs(acceleration) / 100.0, 1.0) * 0.2 + least(points / 10.0, 1.0) * 0.1 AS momentum FROM a)"""


@query("growth_and_momentum", f"WITH {_GROW} SELECT subject, strftime(snapshot, '%Y-%m-%d') AS week, round(growth_pct, 6) AS growth_pct, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(momentum, 6) AS momentum FROM m")
def growth_and_momentum(spark, d):
    g = N.growth(series(spark, d))
    m = N.momentum(F.col("growth_pct"), F.col("velocity"), F.col("acceleration"), F.col("points"))
    return g.select("subject", F.date_format("snapshot", "yyyy-MM-dd").alias("week"), *[F.round(c, 6).alias(c) for c in ("growth_pct", "velocity", "acceleration")], F.round(m, 6).alias("momentum"))


@query("trend_detection", f"WITH {_GROW} SELECT subject, strftime(snapshot, '%Y-%m-%d') AS week, CASE WHEN prior = 0 THEN 'emerging' WHEN growth_pct >= 5 THEN 'growing' WHEN growth_pct <= -5 THEN 'declining' ELSE 'stable' END AS trend_type, substr(sha256(subject || ':' || strftime(snapshot, '%Y-%m-%d')), 1, 32) AS trend_id, round(least(1.0, least(abs(growth_pct) / 100.0, 1.0) * 0.30 + least(abs(velocity) / 1000.0, 1.0) * 0.20 + momentum * 0.15 + (least(1.0, points / 10.0) * 0.5 + least(1.0, observations / 1000.0) * 0.5) * 0.10), 6) AS trend_score FROM m WHERE abs(growth_pct) >= 5")
def trend_detection(spark, d):
    t = N.detect(series(spark, d))
    return t.select("subject", F.date_format("snapshot", "yyyy-MM-dd").alias("week"), "trend_type", "trend_id", F.round("trend_score", 6).alias("trend_score"))


@query("weighted_velocity", f"WITH {_S}, v AS (SELECT subject, (observations - lag(observations) OVER w) / (epoch(snapshot - lag(snapshot) OVER w) / 86400.0) AS v, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY subject)::DOUBLE AS w FROM s WINDOW w AS (PARTITION BY subject ORDER BY snapshot)) SELECT subject, round(sum(v * w) / sum(w), 6) AS velocity FROM v WHERE v IS NOT NULL GROUP BY subject")
def weighted_velocity(spark, d):
    return N.weighted_velocity(series(spark, d)).select("subject", F.round("velocity", 6).alias("velocity"))


@query("timeline_window", f"WITH {_S} SELECT subject, strftime(snapshot, '%Y-%m-%d') AS week FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY snapshot DESC) AS rn FROM s) WHERE rn <= 3")
def timeline_window(spark, d):
    return N.last_points(series(spark, d), 3).select("subject", F.date_format("snapshot", "yyyy-MM-dd").alias("week"))


_HALF = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query("snapshot_comparison", f"WITH a AS (SELECT user_id AS subject, count(*) AS n FROM events WHERE ts < {_HALF} GROUP BY 1), b AS (SELECT user_id AS subject, count(*) AS n FROM events WHERE ts >= {_HALF} GROUP BY 1) SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.n, 0) AS prior, coalesce(b.n, 0) AS current, round(CASE WHEN coalesce(a.n, 0) = 0 THEN 100.0 ELSE (coalesce(b.n, 0) - a.n) / a.n::DOUBLE * 100.0 END, 6) AS growth_pct FROM a FULL JOIN b ON a.subject = b.subject")
def snapshot_comparison(spark, d):
    e = table(spark, d, "events")
    half = e.agg((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.floor((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 2)).alias("half"))
    rows = e.join(F.broadcast(half)).withColumn("late", F.unix_micros(F.col("ts").cast("timestamp")) >= F.col("half"))
    side = lambda late: rows.where(F.col("late") == late).groupBy(F.col("user_id").alias("subject")).agg(F.count("*").alias("observations"))
    return N.compare(side(False), side(True)).withColumn("growth_pct", F.round("growth_pct", 6))


@query("cross_platform_correlation", "WITH p AS (SELECT DISTINCT p_type || p_size AS k, s_nationkey AS p FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), z AS (SELECT k, count(*) AS n FROM p GROUP BY k), j AS (SELECT a.k AS first, b.k AS second, count(*) AS shared FROM p a JOIN p b ON a.p = b.p AND a.k < b.k GROUP BY ALL HAVING count(*) >= 2) SELECT first, second, shared FROM j JOIN z x ON x.k = first JOIN z y ON y.k = second WHERE shared >= least(x.n, y.n) * 0.5")
def cross_platform_correlation(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    items = rows.groupBy(F.concat("p_type", "p_size").alias("item")).agg(F.collect_set("s_nationkey").alias("places"))  # at most 25 nations an item
    return N.correlate(items, "item", "places")


# ---- opportunities: brands as problems, their sales as evidence

_CAND = """b AS (SELECT p_brand AS key, count(*) AS evidence_n, count(DISTINCT l_suppkey % 25) AS platform_count, count(DISTINCT p_partkey) AS product_count, count(DISTINCT p_type) AS company_count,
 avg(l_discount) * 10 AS severity, avg(l_tax) * 10 AS frequency_score, avg(l_quantity) / 50 AS trend_score, avg(l_quantity) / 60 AS confidence, avg(p_size) / 50.0 AS density FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
x AS (SELECT *, (SELECT max(evidence_n) FROM b) AS me, 25 AS tp, (SELECT count(DISTINCT p_partkey) + count(DISTINCT p_type) FROM part) AS te FROM b),
f AS (SELECT *, least(greatest(severity, 0.0), 1.0) AS f1, least(greatest(frequency_score, 0.0), 1.0) AS f2, least(greatest(trend_score, 0.0), 1.0) AS f3, least(1.0, evidence_n / me::DOUBLE) AS f4, least(greatest(confidence, 0.0), 1.0) AS f5, least(greatest(density, 0.0), 1.0) AS f6,
 least(1.0, platform_count / tp::DOUBLE) AS f7, round(least(1.0, (product_count + company_count) / greatest(product_count + company_count, 5)::DOUBLE + platform_count / tp::DOUBLE) * 0.5, 4) AS f8, round(least(1.0, evidence_n / greatest(evidence_n, 10)::DOUBLE + 0.3), 4) AS f10,
 round(1 - (1 - least(1.0, (product_count + company_count) / greatest(te, 1)::DOUBLE * 2)), 4) AS f9, round(1 - least(1.0, (product_count + company_count) / greatest(te, 1)::DOUBLE * 2), 4) AS f11 FROM x),
o AS (SELECT *, f1 * 0.2 + f2 * 0.15 + f3 * 0.1 + f4 * 0.1 + f5 * 0.1 + f6 * 0.08 + f7 * 0.07 + f8 * 0.05 + CASE WHEN f9 = 0 THEN 0.5 ELSE f9 END * 0.05 + f10 * 0.05 + CASE WHEN f11 = 0 THEN 0.5 ELSE f11 END * 0.05 AS opportunity_score, least(1.0, f5 * 0.4 + f4 * 0.3 + f6 * 0.15 + f8 * 0.15) AS final_confidence FROM f)"""


def scored(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b = li.groupBy(F.col("p_brand").alias("key")).agg(
        F.count("*").alias("evidence_n"), F.count_distinct(F.col("l_suppkey") % 25).alias("platform_count"), F.count_distinct("p_partkey").alias("product_count"), F.count_distinct("p_type").alias("company_count"),
        (F.avg("l_discount") * 10).alias("severity"), (F.avg("l_tax") * 10).alias("frequency_score"), (F.avg("l_quantity") / 50).alias("trend_score"), (F.avg("l_quantity") / 60).alias("confidence"), (F.avg("p_size") / 50).alias("density"),
    )
    most = b.agg(F.max("evidence_n").alias("most"))
    known = table(spark, d, "part").agg((F.count_distinct("p_partkey") + F.count_distinct("p_type")).alias("known"))
    s = O.breakdown(b.join(F.broadcast(most)).join(F.broadcast(known)), F.col("most"), F.lit(25), F.col("known"))  # one row each
    return s.withColumn("opportunity_score", O.composite()).withColumn("final_confidence", O.final_confidence())


@query("opportunity_scores", f"WITH {_CAND} SELECT key, round(opportunity_score, 6) AS score, round(final_confidence, 6) AS confidence, CASE WHEN product_count + company_count + platform_count + evidence_n >= 50 THEN 'large' WHEN product_count + company_count + platform_count + evidence_n >= 20 THEN 'medium' WHEN product_count + company_count + platform_count + evidence_n >= 5 THEN 'small' ELSE 'unknown' END AS market_size, CASE WHEN opportunity_score >= 0.75 THEN 'strong_pursue' WHEN opportunity_score >= 0.5 THEN 'worth_exploring' WHEN opportunity_score >= 0.3 THEN 'niche_potential' WHEN opportunity_score >= 0.1 THEN 'monitor' ELSE 'insufficient_data' END AS recommendation FROM o")
def opportunity_scores(spark, d):
    s = scored(spark, d)
    size = O.market_size(F.col("product_count") + F.col("company_count") + F.col("platform_count") + F.col("evidence_n"))
    return s.select("key", F.round("opportunity_score", 6).alias("score"), F.round("final_confidence", 6).alias("confidence"), size.alias("market_size"), O.recommendation(F.col("opportunity_score")).alias("recommendation"))


for _name, _sql in {"composite": "opportunity_score", "severity": "f1", "market": "f8", "feasibility": "f10", "confidence": "final_confidence"}.items():

    def _ranked(spark, d, name=_name):
        return O.rank(scored(spark, d).withColumn(O.STRATEGIES[name], F.round(O.STRATEGIES[name], 9)), name, 10).select("rank", "key")

    query(f"opportunity_rank_{_name}", f"WITH {_CAND} SELECT row_number() OVER (ORDER BY round({_sql}, 9) DESC, key)::INTEGER AS rank, key FROM o ORDER BY round({_sql}, 9) DESC, key LIMIT 10")(_ranked)


@query("opportunity_dedup")
def opportunity_dedup(spark, d):
    """Customers by what they spend, less those whose orders have nearly the same set of priorities and states as those of a better one; the best 100."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("e"), "o_totalprice")
    rows = e.groupBy("key").agg(F.collect_set("e").alias("evidence"), F.sum("o_totalprice").alias("opportunity_score"))  # at most 8 marks a customer
    return O.rank(O.suppress_duplicates(rows, "opportunity_score"), "composite", 100).select("rank", "key", "status", F.size("evidence").alias("n"))


def _models_sql(text: str) -> str:
    from loomline.functions import seeds

    shares = [(m, "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in ws) + f") / {float(len(ws))}::DOUBLE") for m, ws in seeds.BUSINESS_MODELS]
    best = f"greatest({', '.join(s for _, s in shares)})"
    return f"CASE WHEN {best} <= 0 THEN 'saas' " + " ".join(f"WHEN {s} = {best} THEN '{m}'" for m, s in shares) + " END"


@query("business_models", f"SELECT doc_id, {_models_sql('lower(text)')} AS model FROM documents")
def business_models(spark, d):
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", O.business_model(F.col("low")).alias("model"))


@query("uncovered_candidates", """WITH t AS (SELECT o_custkey AS key, least(1.0, min(o_totalprice) / 500000) AS c, count(*) AS n, max(o_totalprice) AS top, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1),
a AS (SELECT key, c, n FROM t WHERE top > 400000), b AS (SELECT key, c, n FROM t WHERE f), x AS (SELECT c_custkey AS key, c_acctbal / 20000 AS c, 1 AS n FROM customer)
SELECT origin, count(*) AS n, min(key) AS first_key FROM (SELECT 'root_cause' AS origin, * FROM a UNION ALL SELECT 'evidence', * FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT 'cluster', * FROM x WHERE key NOT IN (SELECT key FROM a) AND key NOT IN (SELECT key FROM b)) WHERE c >= 0.20 OR n >= 2 GROUP BY origin""")
def uncovered_candidates(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.least(F.lit(1.0), F.min("o_totalprice") / 500000).alias("reasoning_confidence"), F.count("*").alias("evidence_count"), F.max("o_totalprice").alias("top"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 20000).alias("reasoning_confidence"), F.lit(1).cast("long").alias("evidence_count"))
    cols = ["key", "reasoning_confidence", "evidence_count"]
    found = O.candidates(o.where("top > 400000").select(*cols), o.where("f = 1").select(*cols), c)
    return found.groupBy("origin").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query("weighted_text_search", "SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'e') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'e') THEN 2 ELSE 0 END AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50".replace("'steel'", "'e'"))
def weighted_text_search(spark, d):
    return O.text_search(table(spark, d, "part"), "e", "p_name", "p_type", "p_brand", [], 50, "p_partkey").select("p_partkey", "score")


@query("opportunity_issues", f"WITH {_CAND} SELECT 'invalid_score' AS code, count(*) FILTER (WHERE opportunity_score NOT BETWEEN 0 AND 1) AS n FROM o UNION ALL SELECT 'missing_evidence', count(*) FILTER (WHERE evidence_n <= 900) FROM o UNION ALL SELECT 'missing_confidence', 0 UNION ALL SELECT 'duplicate_id', 0")
def opportunity_issues(spark, d):
    """Brands of 900 sales or fewer stand for opportunities without evidence."""
    s = scored(spark, d).withColumn("evidence", F.when(F.col("evidence_n") > 900, F.array("evidence_n")))
    return O.issues(s).select("code", "n")


@query("opportunity_summary", f"WITH {_CAND} SELECT CASE WHEN opportunity_score >= 0.75 THEN 'strong_pursue' WHEN opportunity_score >= 0.5 THEN 'worth_exploring' WHEN opportunity_score >= 0.3 THEN 'niche_potential' WHEN opportunity_score >= 0.1 THEN 'monitor' ELSE 'insufficient_data' END AS recommendation, count(*) AS n, round(avg(opportunity_score), 6) AS mean, round(min(opportunity_score), 6) AS least, round(max(opportunity_score), 6) AS most FROM o GROUP BY 1")
def opportunity_summary(spark, d):
    return O.summary(scored(spark, d)).select("recommendation", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")])


_TYPES = "l AS (SELECT p_brand AS key, list(DISTINCT p_type) AS types, list(DISTINCT p_size) AS sizes FROM part GROUP BY 1)"


@query("opportunity_list_filters", f"WITH {_TYPES} SELECT key FROM l WHERE len(list_filter(types, lambda x: contains(lower(x), 'steel') OR contains(lower(x), 'e'))) > 0 AND list_contains(sizes, 7)")
def opportunity_list_filters(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.collect_set("p_type").alias("types"), F.collect_set("p_size").alias("sizes"))  # the few types and sizes
    return O.in_cluster(O.with_lists(rows, types="E"), 7, "sizes").select("key")


@query("text_search_in_lists", f"WITH {_TYPES} SELECT key, CASE WHEN contains(lower(key), '1') THEN 3 ELSE 0 END + CASE WHEN len(list_filter(types, lambda x: contains(lower(x), '1'))) > 0 THEN 1 ELSE 0 END AS score FROM l WHERE score > 0 ORDER BY score DESC, key LIMIT 20")
def text_search_in_lists(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.collect_set("p_type").alias("types")).withColumns({"summary": F.lit(""), "label": F.lit("")})  # the few types
    return O.text_search(rows, "1", "key", "summary", "label", ["types"], 20, "key").select("key", "score")


# ---- trends of entities and totals


_TOTALS = f"""h AS (SELECT *, ts >= {_HALF} AS late FROM events),
v AS (SELECT late, event_type AS subject FROM h UNION ALL SELECT late, 'app ' || (user_id % 40)::VARCHAR FROM h UNION ALL SELECT late, CASE WHEN user_id % 3 = 0 THEN 'tech ' || (user_id % 7)::VARCHAR END FROM h),
en AS (SELECT subject, count(*) FILTER (WHERE NOT late) AS prior, count(*) FILTER (WHERE late) AS current FROM v WHERE coalesce(subject, '') <> '' GROUP BY 1),
tt AS (SELECT 'opportunities' AS subject, count(*) FILTER (WHERE NOT late AND value > 150) AS prior, count(*) FILTER (WHERE late AND value > 150) AS current FROM h UNION ALL SELECT 'observations', count(*) FILTER (WHERE NOT late), count(*) FILTER (WHERE late) FROM h),
a0 AS (SELECT subject, prior, current, CASE WHEN prior = 0 THEN CASE WHEN current = 0 THEN 0.0 ELSE 100.0 END ELSE (current - prior) / prior::DOUBLE * 100.0 END AS g FROM en),
t0 AS (SELECT subject, prior, current, CASE WHEN prior = 0 THEN CASE WHEN current = 0 THEN 0.0 ELSE 100.0 END ELSE (current - prior) / prior::DOUBLE * 100.0 END AS g FROM tt),
tc AS (SELECT subject, CASE WHEN contains(lower(subject), 'product') OR contains(lower(subject), 'app') THEN 'product' WHEN contains(lower(subject), 'company') OR contains(lower(subject), 'corp') OR contains(lower(subject), 'inc') THEN 'company'
  WHEN contains(lower(subject), 'tech') OR contains(lower(subject), 'framework') OR contains(lower(subject), 'language') OR contains(lower(subject), 'library') THEN 'technology' WHEN contains(lower(subject), 'category') THEN 'category' WHEN contains(lower(subject), 'feature') THEN 'feature' ELSE 'problem' END AS kind, prior, current, g
  FROM a0 WHERE (prior > 0 OR current > 0) AND (abs(g) >= 5 OR prior <> current)
  UNION ALL SELECT CASE WHEN subject = 'opportunities' THEN subject ELSE 'volume_' || subject END, CASE WHEN subject = 'opportunities' THEN 'opportunity' ELSE 'signal' END, prior, current, g FROM t0 WHERE (prior > 0 OR current > 0) AND (subject = 'opportunities' OR abs(g) >= 5 OR prior <> current)),
tn AS (SELECT *, (current - prior)::DOUBLE AS velocity, CASE WHEN prior = 0 THEN 'emerging' WHEN g >= 5 THEN 'growing' WHEN g <= -5 THEN 'declining' ELSE 'stable' END AS trend_type FROM tc)"""


def trend_candidates_of(spark, d):
    """Entities from three columns of events, in two halves of time, and two totals."""
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    half = e.agg((F.min(us) + F.floor((F.max(us) - F.min(us)) / 2)).alias("half"))
    rows = e.join(F.broadcast(half)).withColumn("late", us >= F.col("half"))  # one row
    rows = rows.withColumns({"app": F.concat(F.lit("app "), (F.col("user_id") % 40).cast("string")), "tech": F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("tech "), (F.col("user_id") % 7).cast("string")))})
    counts = lambda late: N.entity_counts(rows.where(F.col("late") == late), ["event_type", "app", "tech"]).withColumnRenamed("n", "observations")
    entities = N.compare(counts(False), counts(True)).select("subject", "prior", "current")
    kinds = F.explode(F.array(F.when(F.col("value") > 150, "opportunities"), F.lit("observations"))).alias("subject")
    totals = rows.select(kinds, "late").where("subject is not null").groupBy("subject").agg(F.count_if(~F.col("late")).alias("prior"), F.count_if("late").alias("current"))
    return N.candidates(entities, totals)


@query("trend_candidates", f"WITH {_TOTALS} SELECT subject, kind, prior, current, round(g, 6) AS growth_pct, velocity, trend_type FROM tn")
def trend_candidates(spark, d):
    return trend_candidates_of(spark, d).withColumn("growth_pct", F.round("growth_pct", 6))


@query("trend_search", f"WITH {_TOTALS} SELECT subject FROM tn WHERE trend_type = 'growing' AND g >= 10 AND kind = 'product'")
def trend_search(spark, d):
    return N.search(trend_candidates_of(spark, d), kind="growing", least_growth=10.0, subject_kind_="product").select("subject")


@query("trend_scores_merged", f"""WITH {_GROW}, x AS (SELECT subject, snapshot, least(abs(growth_pct) / 100.0, 1.0) AS gs, least(abs(velocity) / 1000.0, 1.0) AS vs, momentum AS ms, 0.5 * 0.4 + least(points / 10.0, 1.0) * 0.3 + least(observations / 1000.0, 1.0) * 0.3 AS cs FROM m)
SELECT subject, strftime(snapshot, '%Y-%m-%d') AS week, round(least(1.0, round(gs, 4) * 0.30 + round(vs, 4) * 0.20 + round(ms, 4) * 0.15 + round(cs, 4) * 0.10), 4) AS trend_score FROM x""")
def trend_scores_merged(spark, d):
    """Growth, velocity, momentum and confidence providers, merged, then the composite."""
    g = N.growth(series(spark, d))
    m = N.momentum(F.col("growth_pct"), F.col("velocity"), F.col("acceleration"), F.col("points"))
    part = lambda c, of: F.least(F.abs(c) / of, F.lit(1.0))
    providers = [{"growth_score": part(F.col("growth_pct"), 100.0)}, {"velocity_score": part(F.col("velocity"), 1000.0)}, {"momentum_score": m}, {"confidence_score": N.confidence_score(F.lit(0.5), F.col("points"), F.col("observations"))}]
    s = N.merge_scores(g, providers).withColumns({f"{k}_score": F.lit(0.0) for k in ("seasonality", "anomaly", "cross_platform")})
    return s.select("subject", F.date_format("snapshot", "yyyy-MM-dd").alias("week"), F.round(N.composite_score(), 4).alias("trend_score"))


@query("trend_summary", f"WITH {_GROW}, t AS (SELECT CASE WHEN prior = 0 THEN 'emerging' WHEN growth_pct >= 5 THEN 'growing' WHEN growth_pct <= -5 THEN 'declining' ELSE 'stable' END AS trend_type, least(1.0, least(abs(growth_pct) / 100.0, 1.0) * 0.30 + least(abs(velocity) / 1000.0, 1.0) * 0.20 + momentum * 0.15 + (least(1.0, points / 10.0) * 0.5 + least(1.0, observations / 1000.0) * 0.5) * 0.10) AS s FROM m WHERE abs(growth_pct) >= 5) SELECT trend_type, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most FROM t GROUP BY 1")
def trend_summary(spark, d):
    return N.summary(N.detect(series(spark, d))).select("trend_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")])


@query("trend_issues", f"WITH {_GROW} SELECT 'duplicate_id' AS code, 0 AS n UNION ALL SELECT 'excess_growth', count(*) FROM m WHERE abs(growth_pct) >= 5 AND growth_pct > 50000 UNION ALL SELECT 'inconsistent_direction', 0 UNION ALL SELECT 'unknown_snapshot', count(*) FROM m WHERE abs(growth_pct) >= 5 AND snapshot = (SELECT max(snapshot) FROM s)")
def trend_issues(spark, d):
    """Against the index of all weeks but the last."""
    s = series(spark, d)
    known = s.select("snapshot").distinct().join(F.broadcast(s.agg(F.max("snapshot").alias("last")))).where("snapshot < last")  # one row
    return N.issues(N.detect(s), known)


@query("row_pairs", "WITH l AS (SELECT p_brand AS key, list(DISTINCT p_size) AS a, list(DISTINCT p_type) AS b FROM part WHERE p_size <= 5 GROUP BY 1), x AS (SELECT key, unnest(a) AS v, b FROM l), y AS (SELECT key, v, unnest(b) AS w FROM x) SELECT key, v || ':' || w AS related, 'company_trend' AS kind FROM y UNION ALL SELECT key, w || ':' || v, 'problem_technology' FROM y")
def row_pairs(spark, d):
    p = table(spark, d, "part").where("p_size <= 5")
    rows = p.groupBy(F.col("p_brand").alias("key")).agg(F.collect_set(F.col("p_size").cast("string")).alias("products"), F.collect_set("p_type").alias("companies"))  # the few sizes and types
    return N.row_pairs(rows.withColumn("technologies", F.col("companies")), "key", "products", "companies", "technologies")


# ---- evaluation


@query("document_health", "SELECT count(*) AS documents, round(1 - count(DISTINCT doc_id) / count(*)::DOUBLE, 6) AS duplicate_rate, round(avg(CASE WHEN text IS NULL OR trim(text) = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, round((avg(CASE WHEN lang <> '' THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN source <> '' THEN 1.0 ELSE 0.0 END)) / 2, 6) AS completeness, 100.0::DOUBLE AS score FROM documents")
def document_health(spark, d):
    h = H.document_health(table(spark, d, "documents"), "doc_id", "text", ["lang", "source"])
    return h.select("documents", F.round("duplicate_rate", 6).alias("duplicate_rate"), F.round("empty_rate", 6).alias("empty_rate"), F.round("completeness", 6).alias("completeness"), "score")


_HEALTH = f"""{SIGNALS_SQL}, nd AS (SELECT count(*) AS n FROM documents), no AS (SELECT count(*) AS n FROM o), ne AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_REASON} IS NOT NULL) AS out FROM e),
hs AS (SELECT 'observations' AS stage, 100.0 - CASE WHEN count(*) / (SELECT n FROM nd)::DOUBLE < 0.1 THEN 20 ELSE 0 END - CASE WHEN count(category) / count(*)::DOUBLE < 0.1 THEN 15 ELSE 0 END - CASE WHEN count(canonical_value) / count(*)::DOUBLE < 0.1 THEN 10 ELSE 0 END - CASE WHEN count(DISTINCT kind) < 2 THEN 10 ELSE 0 END AS score FROM o
 UNION ALL SELECT 'evidence', 100.0 - CASE WHEN (SELECT n FROM no) / count(*)::DOUBLE < 1 THEN 20 ELSE 0 END - CASE WHEN avg(observation_count) < 2 THEN 15 ELSE 0 END - CASE WHEN avg(confidence) < 0.5 THEN 10 ELSE 0 END - CASE WHEN count(DISTINCT category) < 2 THEN 10 ELSE 0 END FROM e
 UNION ALL SELECT 'signals', CASE WHEN count(*) = 0 THEN 0 ELSE 100.0 - CASE WHEN (SELECT out FROM ne) > count(*) * 2 THEN 15 ELSE 0 END - CASE WHEN count(DISTINCT category) BETWEEN 1 AND 2 THEN 10 ELSE 0 END - CASE WHEN avg(document_count) < 3 THEN 10 ELSE 0 END END FROM sg
 UNION ALL SELECT 'embeddings', 100.0 - CASE WHEN z > 0.05 THEN least(30, z * 100) ELSE 0 END - CASE WHEN u > 0.1 THEN least(20, u * 100) ELSE 0 END - 10 FROM (SELECT count(*) FILTER (WHERE sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) < 1e-10) / count(*)::DOUBLE AS z, 1 - count(DISTINCT embedding) / count(*)::DOUBLE AS u FROM embeddings)
)"""


def stage_scores(spark, d):
    docs, obs = table(spark, d, "documents"), materialise(observations(spark, d), "health-observations")
    ev = materialise(V.evidence(obs), "health-evidence")
    least = V.adaptive_minimum(docs.count())
    sig = V.signals(ev, least)
    out = ev.where(V.exclusion_reason(least).isNotNull()).count()
    t, opp = N.detect(series(spark, d)), scored(spark, d)
    kinds = {r["trend_type"]: r["n"] for r in t.groupBy("trend_type").agg(F.count("*").alias("n")).collect()}  # four kinds
    frames = {
        "observations": H.observation_health(obs, docs.count()), "evidence": H.evidence_health(ev, obs.count()), "signals": H.signal_health(sig, out),
        "embeddings": H.embedding_health(table(spark, d, "embeddings")), "opportunities": H.opportunity_health(opp, opp.where("opportunity_score >= 0.75").count()),
        "trends": H.trend_health(t, kinds.get("growing", 0), kinds.get("emerging", 0)),
    }
    rows = None
    for name, df in frames.items():
        row = df.select(F.lit(name).alias("stage"), F.col("score").cast("double").alias("score"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


_OPP_HEALTH = f"""x0 AS (WITH {_CAND} SELECT 'opportunities' AS stage, 100.0 - CASE WHEN count(*) = 0 THEN 50 WHEN count(*) < 3 THEN 20 WHEN count(*) < 10 THEN 10 ELSE 0 END - CASE WHEN avg(opportunity_score) < 0.3 THEN 10 ELSE 0 END - CASE WHEN count(*) FILTER (WHERE opportunity_score >= 0.75) = 0 THEN 10 ELSE 0 END AS score FROM o)"""
_TREND_HEALTH = f"""x1 AS (WITH {_GROW}, t AS (SELECT CASE WHEN prior = 0 THEN 'emerging' WHEN growth_pct >= 5 THEN 'growing' WHEN growth_pct <= -5 THEN 'declining' ELSE 'stable' END AS k, least(1.0, least(abs(growth_pct) / 100.0, 1.0) * 0.30 + least(abs(velocity) / 1000.0, 1.0) * 0.20 + momentum * 0.15 + (least(1.0, points / 10.0) * 0.5 + least(1.0, observations / 1000.0) * 0.5) * 0.10) AS sc FROM m WHERE abs(growth_pct) >= 5)
 SELECT 'trends' AS stage, 100.0 - CASE WHEN count(*) = 0 THEN 50 WHEN count(*) < 3 THEN 20 WHEN count(*) < 10 THEN 10 ELSE 0 END - CASE WHEN avg(sc) < 0.3 THEN 10 ELSE 0 END - CASE WHEN count(*) FILTER (WHERE k = 'growing') = 0 THEN 10 ELSE 0 END - CASE WHEN count(*) FILTER (WHERE k = 'emerging') = 0 THEN 5 ELSE 0 END AS score FROM t)"""
STAGES_SQL = f"hh AS (WITH {_HEALTH} SELECT * FROM hs), {_OPP_HEALTH}, {_TREND_HEALTH}, st AS (SELECT stage, round(score::DOUBLE, 1) AS score FROM hh UNION ALL SELECT stage, round(score::DOUBLE, 1) FROM x0 UNION ALL SELECT stage, round(score::DOUBLE, 1) FROM x1)"


@query("stage_health", f"WITH {STAGES_SQL} SELECT stage, score FROM st")
def stage_health(spark, d):
    return stage_scores(spark, d)


_W = "CASE stage " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in H.STAGE_WEIGHTS.items()) + " ELSE 0 END"


@query("overall_health", f"WITH {STAGES_SQL} SELECT round(sum(score * {_W}) / sum({_W}), 4) AS health, (SELECT stage FROM st ORDER BY score, stage LIMIT 1) AS worst_stage FROM st")
def overall_health(spark, d):
    return H.overall(stage_scores(spark, d))


@query("pipeline_dashboard", f"WITH {SIGNALS_SQL}, c AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM o) AS observations, (SELECT count(*) FROM e) AS evidence, (SELECT count(*) FROM sg) AS signals) SELECT *, round(observations / documents::DOUBLE, 2) AS extraction_rate, round(observations / evidence::DOUBLE, 2) AS compression_ratio, round(signals / documents::DOUBLE, 4) AS signal_rate FROM c")
def pipeline_dashboard(spark, d):
    n, obs = table(spark, d, "documents").count(), materialise(observations(spark, d), "dashboard-observations")
    ev = materialise(V.evidence(obs), "dashboard-evidence")
    board = H.dashboard(n, obs.count(), ev.count(), V.signals(ev, V.adaptive_minimum(n)).count())
    return spark.createDataFrame([tuple(board.values())], "documents long, observations long, evidence long, signals long, extraction_rate double, compression_ratio double, signal_rate double")


@query("set_difference", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")).exceptAll(table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey").distinct())


@query("upsert_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def upsert_latest(spark, d):
    from loomline.sources.sinks import latest

    return latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
