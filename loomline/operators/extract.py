"""Observations: dictionary entities, phrase patterns, n-grams, TF-IDF, RAKE, suffix phrases, enrichment.

Dictionaries are small and fixed, so they are unrolled into one array expression per row
(filter, then explode): one scan and no join. All counts are partial aggregates before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import seeds, text as T


def entities(docs: DataFrame, dictionary=seeds.ENTITIES, bounded: bool = False) -> DataFrame:
    """A row per document, entity and term found (name or alias) as a case-blind substring; aliases lower confidence."""
    terms = [(name, kind, t.lower(), t == name) for name, kind, aliases in dictionary for t in (name, *aliases)]
    known = F.array(*[F.struct(F.lit(n).alias("entity"), F.lit(k).alias("entity_type"), F.lit(t).alias("term"), F.lit(x).alias("exact")) for n, k, t, x in terms])
    hit = lambda low, t: T.word_bounded(low, t["term"]) if bounded else F.contains(low, t["term"])
    found = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(known, lambda t: hit(low, t))))
    # An outer explode: no filter on the array's size is inferred, which would be evaluated apart, before the rows are dealt out.
    rows = docs.select(*docs.columns, F.explode_outer(found).alias("_e")).where("_e is not null").select(*docs.columns, "_e.*")
    return rows.withColumn("confidence", F.when(F.col("exact"), 0.95).otherwise(0.95 * 0.7))


def capitalised_names(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The heuristic for names, on the original text: runs of two or more capitalised words."""
    runs = F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"), F.lit(0))
    return docs.select(id_col, F.explode(F.array_distinct(runs)).alias("entity")).withColumn("confidence", F.lit(0.55))


def patterns(docs: DataFrame, table=seeds.PATTERNS) -> DataFrame:
    """A row per document and label with the first phrase (in table order) that occurs; case-blind regular expressions."""
    low = F.lower("text")

    def first(label: str, confidence: float, phrases) -> Column:
        phrase = F.coalesce(*[F.when(low.rlike(T.phrase_regex(p)), F.regexp_extract(low, T.phrase_regex(p), 0)) for p in phrases])
        return F.when(phrase.isNotNull(), F.struct(F.lit(label).alias("label"), phrase.alias("phrase"), F.lit(confidence * 0.85).alias("confidence")))

    rows = docs.select(*docs.columns, F.explode_outer(F.array_compact(F.array(*[first(*p) for p in table]))).alias("_p")).where("_p is not null")
    return rows.select(*docs.columns, "_p.*")


def ngram_counts(docs: DataFrame, n: int, least: int = 5, top: int = 100) -> DataFrame:
    grams = docs.select(F.explode(T.ngrams(T.tokens(F.col("text")), n)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(top)


def term_frequencies(docs: DataFrame, id_col: str, top: int = 20) -> DataFrame:
    """(id, token, tf): the ``top`` most frequent tokens of each text, ties by token.

    A text's tokens stay in its row: the window over one document is a sorted array of its own counts.
    """
    c = docs.select(id_col, F.explode(T.tokens(F.col("text"))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))
    w = Window.partitionBy(id_col).orderBy(F.desc("tf"), "token")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("rn")


def tfidf(docs: DataFrame, id_col: str = "doc_id", per_doc: int = 20, least_df: int = 2, top: int = 100) -> DataFrame:
    """token, df, score = sum(tf) * (ln((N + 1) / (df + 1)) + 1)."""
    n = docs.count()
    t = term_frequencies(docs, id_col, per_doc).groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).where(F.col("df") >= least_df)
    score = F.round(F.col("tf") * (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0), 4)
    return t.select("token", "df", score.alias("score")).orderBy(F.desc("score"), "token").limit(top)


def rake_phrases(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, phrase words): maximal runs of words that aren't stop words.

    Runs are islands between stop words: the words are joined with a mark for each stop word and split at marks.
    """
    marked = F.transform(T.alpha_words(F.col("text")), lambda w: F.when(w.isin(seeds.STOP_WORDS), "|").otherwise(w))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r))
    return docs.select(id_col, F.explode(F.filter(runs, lambda r: r != "")).alias("phrase"))


def rake(docs: DataFrame, id_col: str = "doc_id", top: int = 100) -> DataFrame:
    """phrase, n, score: a word scores degree / frequency, a phrase the sum over words, times its occurrences."""
    phrases = rake_phrases(docs, id_col).groupBy("phrase").agg(F.count("*").alias("n")).withColumn("words", F.split("phrase", " "))
    words = phrases.select("phrase", "n", F.size("words").alias("len"), F.explode("words").alias("word"))
    scores = words.groupBy("word").agg((F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("word_score"))
    total = words.join(scores, "word").groupBy("phrase", "n").agg(F.sum("word_score").alias("s"))
    return total.select("phrase", "n", F.round(F.col("s") * F.col("n"), 4).alias("score")).orderBy(F.desc("score"), "phrase").limit(top)


def pos_counts(docs: DataFrame, tag: str, top: int = 100) -> DataFrame:
    """The most frequent words that the suffix rules call ``tag``."""
    words = docs.select(F.explode(T.alpha_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(T.part_of_speech(F.col("word")) == tag).orderBy(F.desc("n"), "word").limit(top)


def adjective_noun(docs: DataFrame, top: int = 100) -> DataFrame:
    pairs = docs.select(F.explode(T.ngrams(T.alpha_words(F.col("text")), 2)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a, b = F.split("pair", " ")[0], F.split("pair", " ")[1]
    return pairs.where((T.part_of_speech(a) == "adj") & (T.part_of_speech(b) == "noun")).orderBy(F.desc("n"), "pair").limit(top)


def category_of(text: Column, taxonomy=seeds.TAXONOMY) -> Column:
    """The first category, in seed order, one of whose keywords stands alone in the text."""
    known = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("category")) for c, words in taxonomy for k in words])
    found = F.flatten(F.transform(F.array(F.lower(text)), lambda low: F.filter(known, lambda t: T.word_bounded(low, t["keyword"]))))
    return F.get(found, F.lit(0))["category"]


def enrich(observations: DataFrame, taxonomy=seeds.TAXONOMY, concepts=seeds.PATTERN_CONCEPTS) -> DataFrame:
    """Adds category, canonical_value and canonical_source to rows with label, entity and value.

    A label resolves through the label table; another row's category comes from the taxonomy's keywords and resolves
    through the concept table, or stands for itself; an unknown label is put in title case. A row with an entity alone has no
    canonical value, and a generic phrase loses its own unless a label gave it.
    """
    label, category = F.col("label"), F.col("category")
    known = F.coalesce(*[F.when(label == k, v[0]) for k, v in concepts.items()])
    own = F.coalesce(*[F.when(label == k, v[1]) for k, v in concepts.items() if v[1]])
    concept = F.coalesce(*[F.when(category == c, name) for c, name in seeds.CATEGORY_CONCEPTS])
    generic = F.lower("value").isin(list(seeds.GENERIC_PHRASES)) & label.isNull()
    out = observations.withColumn("category", F.coalesce(own, category_of(F.col("value"), taxonomy)))
    out = out.withColumn("canonical_value", F.when(~generic, F.coalesce(known, concept, category, T.title_case(label))))
    source = F.when(known.isNotNull(), "pattern").when(concept.isNotNull(), "problem_signals").when(category.isNotNull(), "taxonomy").when(label.isNotNull(), "pattern_label")
    return out.withColumn("canonical_source", F.when(F.col("canonical_value").isNotNull(), source))


def observation_id(kind: Column, value: Column, doc: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit("obs"), kind, value, doc), 256), 1, 16)


def boosted(base: Column, frequency: Column, sources: Column) -> Column:
    """Confidence with its frequency and diversity boosts."""
    return F.least(F.lit(1.0), base + F.least(F.lit(0.1), frequency / 1000.0 * 0.05) + F.least(F.lit(0.05), sources / 100.0 * 0.03))
