"""Queries: extraction, enrichment, evidence, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import seeds, text as T
from loomline.operators import evidence as V, extract as X
from loomline.plans.registry import query, table


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DICTIONARY = seeds.ENTITIES + seeds.FIXTURE_ENTITIES
PATTERNS = seeds.FIXTURE_PATTERNS

_TERMS = ", ".join(f"({q(n)}, {q(k)}, {q(t.lower())}, {str(t == n).lower()})" for n, k, al in DICTIONARY for t in (n, *al))
_ENTITIES = f"(SELECT d.doc_id, d.source, d.lang, d.text, t.entity, t.entity_type, t.term, t.exact FROM documents d JOIN (VALUES {_TERMS}) t(entity, entity_type, term, exact) ON contains(lower(d.text), t.term))"


@query("entity_dictionary", f"SELECT doc_id, entity, entity_type, term, exact, round((CASE WHEN exact THEN 0.95 ELSE 0.665 END)::DOUBLE, 6) AS confidence FROM {_ENTITIES}")
def entity_dictionary(spark, d):
    found = X.entities(table(spark, d, "documents"), DICTIONARY)
    return found.select("doc_id", "entity", "entity_type", "term", "exact", F.round("confidence", 6).alias("confidence"))


@query("entity_snippets", f"""SELECT doc_id, term, CASE WHEN a > 0 THEN (CASE WHEN s > 1 THEN '...' ELSE '' END) || substr(text, s, e - s + 1) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) ELSE substr(text, 1, 80) END AS snippet
FROM (SELECT *, greatest(a - 40, 1) AS s, least(a + length(term) + 39, length(text)) AS e FROM (SELECT *, instr(lower(text), term) AS a FROM {_ENTITIES})) WHERE term IN ('ness', 'osra', 'hewh')""")
def entity_snippets(spark, d):
    found = X.entities(table(spark, d, "documents"), DICTIONARY).where(F.col("term").isin("ness", "osra", "hewh"))
    return found.select("doc_id", "term", T.snippet(F.col("text"), F.col("term")).alias("snippet"))


@query("entity_word_bounded", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'licensed') AND (instr(lower(text), 'licensed') = 1 OR NOT regexp_matches(substr(lower(text), instr(lower(text), 'licensed') - 1, 1), '^[\\p{L}\\p{N}]$')) AND NOT regexp_matches(substr(lower(text), instr(lower(text), 'licensed') + 8, 1), '^[\\p{L}\\p{N}]$')")
def entity_word_bounded(spark, d):
    return table(spark, d, "documents").where(T.word_bounded(F.lower("text"), "licensed")).select("doc_id")


@query("capitalised_names")
def capitalised_names(spark, d):
    return X.capitalised_names(table(spark, d, "documents"))


def _first_sql(phrases) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(low, {q(T.phrase_regex(p))}) THEN regexp_extract(low, {q(T.phrase_regex(p))}) END" for p in phrases) + ")"


_PATTERNS_SQL = " UNION ALL ".join(f"SELECT doc_id, source, lang, text, {q(lb)} AS label, {_first_sql(ps)} AS phrase, {c * 0.85!r}::DOUBLE AS confidence FROM (SELECT *, lower(text) AS low FROM documents)" for lb, c, ps in PATTERNS)
_MATCHES = f"(SELECT * FROM ({_PATTERNS_SQL}) WHERE phrase IS NOT NULL)"


@query("pattern_matches", f"SELECT doc_id, label, phrase, round(confidence, 6) AS confidence FROM {_MATCHES}")
def pattern_matches(spark, d):
    return X.patterns(table(spark, d, "documents"), PATTERNS).select("doc_id", "label", "phrase", F.round("confidence", 6).alias("confidence"))


@query("seed_pattern_matches", "SELECT doc_id, 'poor_quality' AS label FROM documents WHERE regexp_matches(lower(text), 'poor quality|bad quality|very bad|terrible|horrible|awful|pathetic|useless|waste of money')")
def seed_pattern_matches(spark, d):
    return X.patterns(table(spark, d, "documents").select("doc_id", "text")).where("label = 'poor_quality'").select("doc_id", "label")


_STOP = ", ".join(q(w) for w in seeds.STOP_WORDS)
_TOK = f"list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"


def _ngram_sql(n: int) -> str:
    return f"SELECT gram, count(*) AS n FROM (SELECT array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {_TOK} AS w FROM documents))) GROUP BY gram HAVING count(*) >= 5 ORDER BY n DESC, gram LIMIT 100"


for _n in (2, 3, 4):

    def _ngrams(spark, d, n=_n):
        return X.ngram_counts(table(spark, d, "documents"), n)

    query(f"ngrams_{_n}", _ngram_sql(_n))(_ngrams)


@query("tfidf_keywords", f"""WITH c AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS rn FROM c),
t AS (SELECT token, sum(tf) AS tf, count(*) AS df FROM r WHERE rn <= 20 GROUP BY token HAVING count(*) >= 2)
SELECT token, df, round(tf::DOUBLE * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0), 4) AS score FROM t ORDER BY score DESC, token LIMIT 100""")
def tfidf_keywords(spark, d):
    return X.tfidf(table(spark, d, "documents"))


@query("top_tokens_per_document", f"SELECT doc_id, token, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS rn FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY ALL)) WHERE rn <= 20")
def top_tokens_per_document(spark, d):
    return X.term_frequencies(table(spark, d, "documents"), "doc_id")


_ALPHA = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))"
_MARKED = f"array_to_string(list_transform({_ALPHA}, lambda w: CASE WHEN w IN ({_STOP}) THEN '|' ELSE w END), ' ')"


@query("rake_keyphrases", f"""WITH r AS (SELECT trim(unnest(string_split({_MARKED}, '|'))) AS phrase FROM conversations),
p AS (SELECT phrase, count(*) AS n, string_split(phrase, ' ') AS ws FROM r WHERE phrase <> '' GROUP BY phrase),
w AS (SELECT phrase, n, len(ws) AS l, unnest(ws) AS word FROM p), x AS (SELECT word, sum(n * l) / sum(n) AS s FROM w GROUP BY word)
SELECT phrase, n, round(sum(s) * n, 4) AS score FROM w JOIN x USING (word) GROUP BY phrase, n ORDER BY score DESC, phrase LIMIT 100""")
def rake_keyphrases(spark, d):
    return X.rake(table(spark, d, "conversations").withColumn("doc_id", F.col("conv_id")))


@query("rake_runs", f"WITH m AS (SELECT {_MARKED} AS s FROM conversations) SELECT phrase, count(*) AS n FROM (SELECT trim(unnest(string_split(s, '|'))) AS phrase FROM m) WHERE phrase <> '' GROUP BY phrase")
def rake_runs(spark, d):
    runs = X.rake_phrases(table(spark, d, "conversations"), "conv_id")
    return runs.groupBy("phrase").agg(F.count("*").alias("n"))


def _ends(suffixes) -> str:
    return " OR ".join(f"word LIKE '%{s}'" for s in suffixes)


_POS = f"CASE WHEN {_ends(seeds.VERB_SUFFIXES)} THEN 'verb' WHEN {_ends(seeds.NOUN_SUFFIXES)} OR (word LIKE '%s' AND length(word) > 3) THEN 'noun' WHEN {_ends(seeds.ADJECTIVE_SUFFIXES)} THEN 'adj' ELSE 'other' END"

for _tag in ("verb", "noun"):

    def _pos(spark, d, tag=_tag):
        return X.pos_counts(table(spark, d, "documents"), tag)

    query(f"suffix_{_tag}s", f"SELECT word, count(*) AS n FROM (SELECT unnest({_ALPHA}) AS word FROM documents) WHERE {_POS} = '{_tag}' GROUP BY word ORDER BY n DESC, word LIMIT 100")(_pos)


@query("adjective_noun_pairs", f"SELECT a || ' ' || b AS pair, count(*) AS n FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_ALPHA} AS w FROM documents))) WHERE ({_POS.replace('word', 'a')}) = 'adj' AND ({_POS.replace('word', 'b')}) = 'noun' GROUP BY 1 ORDER BY n DESC, pair LIMIT 100")
def adjective_noun_pairs(spark, d):
    return X.adjective_noun(table(spark, d, "documents"))


def observations(spark, d):
    """Pattern and entity observations of the documents, enriched, with labels' quality as a rating."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", (F.col("quality") * 3.0 + 1.0).alias("rating")), "doc_id", "left")
    p = X.patterns(docs, PATTERNS).select("doc_id", "source", "lang", "rating", "label", F.lit(None).cast("string").alias("entity"), F.col("phrase").alias("value"), F.col("confidence"), F.lit("pattern").alias("kind"))
    e = X.entities(docs, seeds.FIXTURE_ENTITIES).select("doc_id", "source", "lang", "rating", F.lit(None).cast("string").alias("label"), "entity", F.col("term").alias("value"), F.col("confidence"), F.lit("entity").alias("kind"))
    o = X.enrich(p.unionByName(e))
    oid = X.observation_id(F.col("kind"), F.col("value"), F.col("doc_id").cast("string"))
    return o.withColumn("observation_id", oid).withColumns({"document_id": F.col("doc_id").cast("string"), "platform": F.col("source"), "country": F.col("lang"), "text_snippet": F.col("value")})


_FIX_TERMS = ", ".join(f"({q(n)}, {q(t.lower())}, {str(t == n).lower()})" for n, k, al in seeds.FIXTURE_ENTITIES for t in (n, *al))
_CONCEPT = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in seeds.PATTERN_CONCEPTS.items()) + " END"
_CATEGORY = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v[1])}" for k, v in seeds.PATTERN_CONCEPTS.items() if v[1]) + " END"


def _bounded_sql(k: str) -> str:
    v = "lower(value)"
    return f"(instr({v}, {q(k)}) > 0 AND (instr({v}, {q(k)}) = 1 OR NOT regexp_matches(substr({v}, instr({v}, {q(k)}) - 1, 1), '^[\\p{{L}}\\p{{N}}]$')) AND NOT regexp_matches(substr({v}, instr({v}, {q(k)}) + {len(k)}, 1), '^[\\p{{L}}\\p{{N}}]$'))"


_TAXONOMY = "coalesce(" + ", ".join(f"CASE WHEN {' OR '.join(_bounded_sql(k) for k in ks)} THEN {q(c)} END" for c, ks in seeds.TAXONOMY) + ")"
_GENERIC = ", ".join(map(q, seeds.GENERIC_PHRASES))
_BY_CATEGORY = "CASE category " + " ".join(f"WHEN {q(c)} THEN {q(v)}" for c, v in seeds.CATEGORY_CONCEPTS) + " END"
OBSERVATIONS_SQL = f"""
l AS (SELECT doc_id, quality * 3.0 + 1.0 AS rating FROM labels),
o0 AS (SELECT doc_id, source, lang, label, NULL::VARCHAR AS entity, phrase AS value, confidence, 'pattern' AS kind FROM {_MATCHES}
  UNION ALL SELECT doc_id, source, lang, NULL, t.entity, t.term, CASE WHEN t.exact THEN 0.95 ELSE 0.95 * 0.7 END, 'entity' FROM documents d JOIN (VALUES {_FIX_TERMS}) t(entity, term, exact) ON contains(lower(d.text), t.term)),
o1 AS (SELECT o0.*, l.rating, coalesce({_CATEGORY}, {_TAXONOMY}) AS category FROM o0 LEFT JOIN l USING (doc_id)),
o2 AS (SELECT *, CASE WHEN lower(value) IN ({_GENERIC}) AND label IS NULL THEN NULL ELSE coalesce({_CONCEPT}, {_BY_CATEGORY}, category) END AS canonical_value FROM o1),
o AS (SELECT *, CASE WHEN canonical_value IS NULL THEN NULL WHEN {_CONCEPT} IS NOT NULL THEN 'pattern' WHEN {_BY_CATEGORY} IS NOT NULL THEN 'problem_signals' WHEN category IS NOT NULL THEN 'taxonomy' END AS canonical_source,
  substr(sha256('obs:' || kind || ':' || value || ':' || doc_id::VARCHAR), 1, 16) AS observation_id FROM o2)"""


@query("enriched_observations", f"WITH {OBSERVATIONS_SQL} SELECT observation_id, doc_id, kind, value, category, canonical_value, canonical_source FROM o")
def enriched_observations(spark, d):
    return observations(spark, d).select("observation_id", "doc_id", "kind", "value", "category", "canonical_value", "canonical_source")


_EVIDENCE = f"""{OBSERVATIONS_SQL},
k AS (SELECT *, regexp_replace(lower(coalesce(category, '') || ':' || substr(coalesce(canonical_value, value), 1, 60) || ':' || coalesce(entity, '')), '^:+|:+$', '', 'g') AS signal_key FROM o),
g AS (SELECT signal_key, min(category) AS category, min(entity) AS entity, count(*) AS observation_count, count(DISTINCT doc_id) AS document_count, avg(rating) AS avg_rating, coalesce(stddev_samp(rating), 0) AS rating_std,
  avg(confidence) AS avg_confidence, count(DISTINCT source) + count(DISTINCT lang) AS diversity, min(coalesce(canonical_value, substr(value, 1, 60))) AS signal_text FROM k GROUP BY signal_key HAVING count(*) >= 3),
e AS (SELECT *, round(CAST(least(1.0, 0.7 * 0.25 + least(1.0, document_count / 100.0) * 0.20 + least(1.0, diversity / 8.0) * 0.15 + (1 - least(1.0, rating_std / 2.5)) * 0.10 + least(1.0, avg_confidence) * 0.15 + least(1.0, observation_count / 500.0) * 0.15) AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence,
  substr(sha256('ev:' || signal_key || ':' || coalesce(entity, '')), 1, 16) AS evidence_id FROM g)"""


@query("evidence_groups", f"WITH {_EVIDENCE} SELECT evidence_id, signal_key, category, entity, observation_count, document_count, round(avg_rating, 6) AS avg_rating, round(rating_std, 6) AS rating_std, confidence FROM e")
def evidence_groups(spark, d):
    e = V.evidence(observations(spark, d))
    return e.select("evidence_id", "signal_key", "category", "entity", "observation_count", "document_count", F.round("avg_rating", 6).alias("avg_rating"), F.round("rating_std", 6).alias("rating_std"), "confidence")


@query("evidence_members", f"WITH {_EVIDENCE}, i AS (SELECT signal_key, observation_id, row_number() OVER (PARTITION BY signal_key ORDER BY observation_id) AS rn FROM k) SELECT signal_key, sha256(string_agg(observation_id, ',' ORDER BY observation_id)) AS ids FROM i WHERE rn <= 100 GROUP BY signal_key")
def evidence_members(spark, d):
    return V.evidence_members(observations(spark, d)).select("signal_key", F.sha2(F.array_join("observation_ids", ","), 256).alias("ids"))


@query("platform_distribution", f"WITH {_EVIDENCE} SELECT signal_key, string_agg(source || '=' || n, ',' ORDER BY source) AS distribution FROM (SELECT signal_key, source, count(*) AS n FROM k GROUP BY ALL) GROUP BY signal_key")
def platform_distribution(spark, d):
    m = V.platform_distribution(observations(spark, d))
    pairs = F.transform(F.map_entries("distribution"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return m.select("signal_key", F.array_join(pairs, ",").alias("distribution"))


_NAMES = ", ".join(q(n.lower()) for n, _, _ in seeds.ENTITIES)
_REASON = f"CASE WHEN document_count < 3 THEN 'low_documents' WHEN avg_rating > 4.0 THEN 'high_rating' WHEN lower(trim(coalesce(signal_text, ''))) = lower(coalesce(entity, '')) AND coalesce(entity, '') <> '' OR lower(trim(coalesce(signal_text, ''))) IN ({_NAMES}) THEN 'entity_only' WHEN lower(trim(coalesce(signal_text, ''))) IN ({', '.join(map(q, seeds.GENERIC_PHRASES))}) THEN 'generic_phrase' WHEN coalesce(category, '') = '' THEN 'no_category' END"


@query("evidence_exclusions", f"WITH {_EVIDENCE} SELECT coalesce({_REASON}, 'signal') AS reason, count(*) AS n FROM e GROUP BY 1")
def evidence_exclusions(spark, d):
    least = V.adaptive_minimum(table(spark, d, "documents").count())
    return V.evidence(observations(spark, d)).groupBy(F.coalesce(V.exclusion_reason(least), F.lit("signal")).alias("reason")).agg(F.count("*").alias("n"))


SIGNALS_SQL = f"""{_EVIDENCE}, s AS (SELECT category, signal_text, count(*) AS evidence_count, sum(document_count)::BIGINT AS document_count, sum(observation_count)::BIGINT AS observation_count, list_sort(list(DISTINCT evidence_id)) AS evidence_ids,
 sum(avg_rating * observation_count) / sum(CASE WHEN avg_rating IS NOT NULL THEN observation_count END) AS avg_rating, avg(avg_rating) AS mean_rating, avg(confidence) AS ec FROM e WHERE {_REASON} IS NULL GROUP BY category, signal_text),
sg AS (SELECT *, round(CAST(least(1.0, ec * 0.35 + least(1.0, evidence_count / 5.0) * 0.20 + least(1.0, document_count / 500.0) * 0.25 + CASE WHEN mean_rating IS NULL THEN 1.0 ELSE 1 - least(1.0, mean_rating / 5.0) END * 0.20) AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence FROM s)"""


@query("problem_signals", f"WITH {SIGNALS_SQL} SELECT category, signal_text, evidence_count, document_count, observation_count, round(avg_rating, 6) AS avg_rating, confidence FROM sg")
def problem_signals(spark, d):
    least = V.adaptive_minimum(table(spark, d, "documents").count())
    s = V.signals(V.evidence(observations(spark, d)), least)
    return s.select("category", "signal_text", "evidence_count", "document_count", "observation_count", F.round("avg_rating", 6).alias("avg_rating"), "confidence")


@query("observation_report", f"WITH {OBSERVATIONS_SQL} SELECT kind, canonical_source, count(*) AS n, count(DISTINCT doc_id) AS docs, round(count(category) * 100.0 / count(*), 4) AS category_pct FROM o GROUP BY kind, canonical_source")
def observation_report(spark, d):
    o = observations(spark, d)
    return o.groupBy("kind", "canonical_source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.round(F.count("category") * 100.0 / F.count("*"), 4).alias("category_pct"))


@query("extraction_confidence", "SELECT event_type, n, u, round(least(1.0, 0.95 + least(0.1, n / 1000.0 * 0.05) + least(0.05, u / 100.0 * 0.03)), 6) AS confidence FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id % 50) AS u FROM events GROUP BY 1)")
def extraction_confidence(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.col("user_id") % 50).alias("u"))
    return g.withColumn("confidence", F.round(X.boosted(F.lit(0.95), F.col("n"), F.col("u")), 6))


@query("unresolved_values", f"WITH {OBSERVATIONS_SQL} SELECT value, count(*) AS n FROM o WHERE canonical_value IS NULL AND entity IS NULL GROUP BY value HAVING count(*) >= 2")
def unresolved_values(spark, d):
    return V.unresolved(observations(spark, d))


@query("evidence_report", f"WITH {_EVIDENCE} SELECT category, count(*) AS n, sum(observation_count)::BIGINT AS observations, round(avg(confidence), 6) AS mean_confidence, count(entity) AS with_entity FROM e GROUP BY category")
def evidence_report(spark, d):
    e = V.evidence(observations(spark, d))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.sum("observation_count").alias("observations"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("entity").alias("with_entity"))


@query("discarded_evidence", f"WITH {_EVIDENCE} SELECT evidence_id, {_REASON} AS reason FROM e WHERE {_REASON} IS NOT NULL ORDER BY document_count DESC, evidence_id LIMIT 200")
def discarded_evidence(spark, d):
    least = V.adaptive_minimum(table(spark, d, "documents").count())
    return V.discarded(V.evidence(observations(spark, d)), least).select("evidence_id", "reason")


@query("title_case_labels", "SELECT DISTINCT event_type, array_to_string(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM events")
def title_case_labels(spark, d):
    return table(spark, d, "events").select("event_type", T.title_case(F.col("event_type")).alias("title")).distinct()
