"""Queries: cleaning, rejecting, statistics, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import seeds, text as T
from loomline.operators import intake as I
from loomline.plans.registry import query, table

# ---- the cleaners as SQL, in the order of functions.text.clean


def _sql_replace(expr: str, pairs) -> str:
    for a, b in pairs:
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        expr = f"replace({expr}, {quote(a)}, {quote(b)})"
    return expr


def mojibake_sql(c: str) -> str:
    return _sql_replace(c, seeds.MOJIBAKE)


def html_sql(c: str) -> str:
    return f"trim(regexp_replace({_sql_replace(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')", T.ENTITIES)}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def url_sql(c: str) -> str:
    pattern = T.URL.replace("'", "''")
    return f"trim(regexp_replace({c}, '{pattern}', ' [URL] ', 'g'))"


def emoji_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{T.EMOJI}', '', 'g'))"


def space_sql(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '(?m)[ \\t]+$', '', 'g')"
    return f"regexp_replace(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def clean_sql(c: str) -> str:
    return space_sql(emoji_sql(url_sql(f"nfc_normalize({html_sql(mojibake_sql(c))})")))


def hash_sql(c: str) -> str:
    return f"sha256(regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"


_MARKED_SQL = f"""
c AS (SELECT doc_id, lang, source, text, {clean_sql('text')} AS clean_text FROM documents),
h AS (SELECT *, {hash_sql('clean_text')} AS content_hash FROM c),
d AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY content_hash) AS is_duplicate FROM h),
m AS (SELECT *, CASE WHEN clean_text IS NULL THEN 'clean_error' WHEN clean_text = '' THEN 'empty' WHEN length(trim(clean_text)) < 10 THEN 'too_short'
  WHEN length(clean_text) > 20000 THEN 'too_long' WHEN is_duplicate THEN 'duplicate' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported_language' END AS reason FROM d)"""


def marked(spark, d):
    return I.intake(table(spark, d, "documents"), max_chars=20_000, languages=("en", "de", "fr"))


@query(
    "document_intake",
    f"WITH {_MARKED_SQL} SELECT source, lang, count(*) AS docs, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE is_duplicate) AS duplicates, round(avg(length(clean_text)), 4) AS avg_chars FROM m GROUP BY source, lang",
)
def document_intake(spark, d):
    """Clean, hash, dedup, reject, then count by source and language."""
    return marked(spark, d).groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if("is_duplicate").alias("duplicates"), F.round(F.avg(F.length("clean_text")), 4).alias("avg_chars"))


@query("reject_reasons", f"WITH {_MARKED_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM m GROUP BY 1")
def reject_reasons(spark, d):
    return marked(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("rejected_documents", f"WITH {_MARKED_SQL} SELECT doc_id, reason, substr(text, 1, 200) AS text_preview, length(text) AS original_length FROM m WHERE reason IS NOT NULL")
def rejected_documents(spark, d):
    return I.split_rejected(marked(spark, d))[1].withColumn("original_length", F.col("original_length").cast("long"))


@query("content_hashes", f"WITH {_MARKED_SQL} SELECT doc_id, content_hash FROM m")
def content_hashes(spark, d):
    return marked(spark, d).select("doc_id", "content_hash")


@query("html_cleaning", f"SELECT page_id, {html_sql('html')} AS clean FROM pages")
def html_cleaning(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("clean"))


@query("html_unescape_nfc")
def html_unescape_nfc(spark, d):
    """Every entity and NFC: the two steps without a built-in, in one Arrow hop."""
    stripped = F.regexp_replace("html", r"<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(T.unescape_and_nfc(stripped), r"\s+", " ")).alias("clean"))


@query("url_masking", f"SELECT page_id, {url_sql("'see ' || url || ' or www.a.org, mail x@b.com ok'")} AS masked FROM pages")
def url_masking(spark, d):
    return table(spark, d, "pages").select("page_id", T.mask_urls(F.concat(F.lit("see "), "url", F.lit(" or www.a.org, mail x@b.com ok"))).alias("masked"))


_ODD = "'a😀b ' || text || ' ✂ 日本 ok'"


@query("emoji_removal", f"SELECT doc_id, {emoji_sql(_ODD)} AS plain FROM documents")
def emoji_removal(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_emoji(F.concat(F.lit("a😀b "), "text", F.lit(" ✂ 日本 ok"))).alias("plain"))


@query("mojibake_repair", f"SELECT doc_id, {mojibake_sql("'cafÃ© â\u0080\u0093 ' || text")} AS fixed FROM documents")
def mojibake_repair(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fix_mojibake(F.concat(F.lit("cafÃ© â\u0080\u0093 "), "text")).alias("fixed"))


@query("text_normalise", "SELECT doc_id, regexp_replace(lower(text), '[^a-zA-Z0-9\\s.,?''-]', '', 'g') AS plain FROM documents")
def text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.correct_spelling(T.normalise(F.col("text"), lower=True, drop_special=True)).alias("plain"))


@query("text_lengths", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
def text_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("language_agreement")
def language_agreement(spark, d):
    """The stop-word language guess against the lang column."""
    docs = table(spark, d, "documents")
    return docs.groupBy("lang", T.language_guess(F.substring("text", 1, 500)).alias("guess")).agg(F.count("*").alias("n"))


@query(
    "validate_raw",
    """WITH r AS (SELECT o_orderkey AS ordinal, (o_orderkey % 5000)::VARCHAR AS id, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE o_custkey::VARCHAR END AS external_id,
      CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderpriority END AS source, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus END AS title,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'x' END AS content, o_orderdate AS created, o_orderdate + INTERVAL 1 DAY AS updated FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn, TIMESTAMP '1998-01-01 00:00:00' AS t FROM r),
    x AS (SELECT ordinal, concat_ws(',', CASE WHEN coalesce(trim(id), '') = '' THEN 'missing_id' END, CASE WHEN coalesce(trim(external_id), '') = '' THEN 'missing_external_id' END,
      CASE WHEN coalesce(trim(source), '') = '' THEN 'missing_source' END, CASE WHEN rn > 1 THEN 'duplicate_id' END,
      CASE WHEN coalesce(trim(title), '') = '' AND coalesce(trim(content), '') = '' THEN 'empty_content' END, CASE WHEN created > t THEN 'future_created' END, CASE WHEN updated > t THEN 'future_updated' END) AS reasons FROM n)
    SELECT ordinal, reasons, reasons = '' AS valid FROM x""",
)
def validate_raw(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    raw = o.select(
        key.alias("ordinal"), (key % 5000).cast("string").alias("id"), F.when(key % 97 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("external_id"),
        F.when(key % 89 != 0, F.col("o_orderpriority")).alias("source"), F.when(key % 11 == 0, " ").otherwise(F.col("o_orderstatus")).alias("title"), F.when(key % 7 != 0, "x").alias("content"),
        F.col("o_orderdate").alias("created"), F.expr("o_orderdate + interval 1 day").alias("updated"),
    )
    return I.validate(raw, "1998-01-01 00:00:00").select("ordinal", F.concat_ws(",", "reasons").alias("reasons"), "valid")


@query("field_type_audit", "SELECT k AS field, CASE WHEN v ~ '^-?[0-9]+$' THEN 'int' ELSE 'string' END AS kind, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events) GROUP BY 1, 2")
def field_type_audit(spark, d):
    return I.field_types(table(spark, d, "events"), "props")


@query("enriched_lengths", "SELECT doc_id, length(text) AS content_length, length(source) AS title_length FROM documents")
def enriched_lengths(spark, d):
    return I.enrich(table(spark, d, "documents"), "text", "source").select("doc_id", F.col("content_length").cast("long").alias("content_length"), F.col("title_length").cast("long").alias("title_length"))


@query("document_search", "SELECT d.doc_id, source, lang FROM documents d JOIN labels USING (doc_id) WHERE contains(text, 'the') AND source = 'src1' AND lang = 'en' AND quality * 5.0 BETWEEN 4 AND 5 ORDER BY d.doc_id LIMIT 50")
def document_search(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", (F.col("quality") * 5.0).alias("rating")), "doc_id")
    found = I.search(docs, "the", "src1", "en", (4.0, 5.0), limit=50, cols={"platform": "source", "country": "lang"})
    return found.select("doc_id", "source", "lang")


@query("distinct_platforms", "SELECT DISTINCT source AS platform FROM documents WHERE source IS NOT NULL")
def distinct_platforms(spark, d):
    return table(spark, d, "documents").where("source is not null").select(F.col("source").alias("platform")).distinct().orderBy("platform")


@query("rating_range", "SELECT min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL")
def rating_range(spark, d):
    return table(spark, d, "customer").where("c_acctbal is not null").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count("*").alias("n"))


def _stat_sql(cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL OR trim({c}::VARCHAR) = '') AS missing, count(DISTINCT {c}) AS distinct_values, round(count(*) FILTER (WHERE {c} IS NULL OR trim({c}::VARCHAR) = '') * 100.0 / count(*), 4) AS missing_pct FROM documents" for c in cols)


@query("dataset_statistics", _stat_sql(["text", "lang", "source", "n_chars"]))
def dataset_statistics(spark, d):
    return I.statistics(table(spark, d, "documents"), ["text", "lang", "source", "n_chars"])


@query("value_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, d):
    return I.value_counts(table(spark, d, "part"), "p_brand")


@query("column_entropy", "SELECT sum(c)::BIGINT AS n, count(*) AS distinct_values, round(count(*) / sum(c), 6) AS distinct_ratio, 0::BIGINT AS nulls, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)")
def column_entropy(spark, d):
    return I.entropy(table(spark, d, "events"), "event_type")


@query("length_distribution", """WITH s AS (SELECT list_sort(list(n_chars::DOUBLE)) AS v, count(*) AS n, min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, round(avg(n_chars), 6) AS m, round(stddev_pop(n_chars), 4) AS sd FROM documents)
SELECT n, lo AS "min", hi AS "max", m AS mean, v[n // 2 + 1] AS median, sd AS std, v[floor(0.25 * (n - 1))::BIGINT + 1] AS p25, v[floor(0.75 * (n - 1))::BIGINT + 1] AS p75 FROM s""")
def length_distribution(spark, d):
    return I.distribution(table(spark, d, "documents"), "n_chars")


@query("length_histogram", "WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE + 1e-4 AS hi FROM documents) SELECT least(floor((n_chars - lo) * 10 / (hi - lo)), 9)::BIGINT AS bin, count(*) AS n FROM documents, e GROUP BY 1")
def length_histogram(spark, d):
    return I.histogram(table(spark, d, "documents"), "n_chars")


@query("price_histogram_closed", "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT least(floor((p_retailprice - lo) * 20 / (hi - lo)), 19)::BIGINT AS bin, count(*) AS n FROM part, e GROUP BY 1")
def price_histogram_closed(spark, d):
    return I.histogram(table(spark, d, "part"), "p_retailprice", bins=20, closed=True)


@query("stratified_sample")
def stratified_sample(spark, d):
    return I.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 40, "doc_id")


@query("simple_sample")
def simple_sample(spark, d):
    return I.simple_sample(table(spark, d, "documents").select("doc_id", "lang"), 25, "doc_id")


@query("dataset_build_report", "SELECT event_type AS source, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def dataset_build_report(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("raw_document_ids", "SELECT doc_id, sha256(source || ':' || doc_id::VARCHAR) AS id FROM documents")
def raw_document_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256).alias("id"))


@query("schema_mapping", "SELECT doc_id::VARCHAR AS id, coalesce(source, '') AS platform, 'documents' AS source_dataset, '' AS title, coalesce(text, '') AS text, '' AS author, coalesce(lang, '') AS language, length(coalesce(text, '')) AS document_length FROM documents")
def schema_mapping(spark, d):
    from loomline.sources.readers import to_unified

    u = to_unified(table(spark, d, "documents"), {"id": "doc_id", "platform": "source", "text": "text", "language": "lang"}, "documents")
    return u.select("id", "platform", "source_dataset", "title", "text", "author", "language", F.col("document_length").cast("long").alias("document_length"))


@query("keep_first_by_customer", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def keep_first_by_customer(spark, d):
    return I.keep_first(table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("union_of_sources", "SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'bench', item_id, text FROM benchmark")
def union_of_sources(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("bench").alias("kind"), F.col("item_id").alias("id"), "text"))


@query("json_rating_country", "SELECT event_id, coalesce(nullif(try_cast(json_extract_string(props, '$.star_rating') AS DOUBLE), 0), nullif(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS rating, coalesce(json_extract_string(props, '$.country'), json_extract_string(props, '$.region'), 'none') AS country FROM events")
def json_rating_country(spark, d):
    from loomline.sources.readers import first_json

    rating = F.coalesce(F.nullif(F.get_json_object("props", "$.star_rating").try_cast("double"), F.lit(0.0)), F.nullif(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)))
    return table(spark, d, "events").select("event_id", rating.alias("rating"), F.coalesce(first_json("props", "country", "region"), F.lit("none")).alias("country"))


@query("date_parsing", "SELECT o_orderkey, date_diff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS days, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_parsing(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, d, "orders").select("o_orderkey", iso.alias("iso"))
    return rows.select("o_orderkey", F.datediff(T.to_time(F.col("iso")), F.lit("1992-01-01").cast("date")).cast("long").alias("days"), "iso")


@query("first_numbers", "SELECT p_partkey, try_cast(nullif(regexp_extract(p_name || ' ' || p_size, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS number, nullif(trim(p_type), '') AS kind FROM part")
def first_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", T.first_number(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("number"), T.safe_string(F.col("p_type")).alias("kind"))


@query("chosen_texts", "SELECT page_id, trim(concat_ws(' ', nullif(trim(url), ''), nullif(trim(html), ''))) AS chosen_text FROM pages")
def chosen_texts(spark, d):
    """Pages have none of the preferred text columns, so all their string columns are joined."""
    return I.choose_text(table(spark, d, "pages")).select("page_id", F.trim("chosen_text").alias("chosen_text"))


@query("ad_hoc_sql", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def ad_hoc_sql(spark, d):
    from loomline.sources.sinks import ask

    return ask("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {o} JOIN {c} ON o_custkey = c_custkey GROUP BY 1", o=table(spark, d, "orders"), c=table(spark, d, "customer"))
