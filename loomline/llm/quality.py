"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the text; no user function runs. The words,
windows and lines of a text are bound once (as the variable of a one-element
``transform``), so no metric splits the text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomline.session import spread

SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "de la le et les des en un du une que est pour qui dans par sur au pas plus ne se ce il sont avec "
    "el los y del las por con no su para al lo como o pero sus ha me si sin sobre este ya entre cuando"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when numerator * scale (op) threshold * denominator; ratios stay in whole numbers."""

    name: str
    numerator: str
    op: str
    threshold: int
    denominator: str | None = None
    scale: int = 1


#: Fails the base check of the contract.
BASE_RULES = (
    Rule("too_few_words", "n_words", "<", 50),
    Rule("repeated_windows", "n_repeat_words", ">", 50, "n_words", 100),
)
#: The method's own table: length, symbol, stop-word and line ratios.
METHOD_RULES = (
    Rule("symbols_per_word", "n_symbols", ">", 10, "n_words", 100),
    Rule("shouting_marks", "n_bangs", ">", 30, "n_words", 100),
    Rule("few_stop_words", "n_stop_words", "<", 2, "n_words", 100),
    Rule("long_mean_word", "word_chars", ">", 15, "n_words"),
    Rule("short_mean_word", "word_chars", "<", 2, "n_words"),
    Rule("repeated_lines", "n_dup_lines", ">", 50, "n_lines", 100),
)


def _metrics(text: Column) -> Column:
    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def covered(s: Column) -> Column:
        """Words covered by the windows of s (sorted by hash, then place) whose hash has a neighbour of its own."""
        twin = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + (i + 3 - F.greatest(i, acc["end"]))).alias("n"), (i + 3).alias("end"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def repeats(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        pairs = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        many = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(pairs(g), covered))
        return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(hashes, many))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")
    return F.struct(
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE)), of_lines).alias("l"),
        without(SYMBOLS + "+").alias("n_symbols"),
        without("!+").alias("n_bangs"),
    )


#: Where each metric is in the struct of ``_metrics``.
_PLACES = {
    "n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines",
    "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_stop_words": "w.n_stop_words", "n_bangs": "n_bangs",
}


def _fails(rule: Rule) -> Column:
    metric = lambda name: F.col(f"_metrics.{_PLACES[name]}")
    left = metric(rule.numerator) * rule.scale
    right = F.lit(rule.threshold) * (metric(rule.denominator) if rule.denominator else F.lit(1))
    return (left < right) if rule.op == "<" else (left > right)


def quality(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """``docs`` with the metrics, ``failed_rules`` (names, in table order), ``base_failed`` and ``kept``.

    All columns of ``docs`` stay, whatever their names; columns of the names added here are replaced.
    A null or empty text has no words, so it fails the base check. Equal rows get equal results, an
    empty table gives no rows. A map-only plan: one projection, no shuffle, memory bounded by one text.
    """
    own = [c for c in docs.columns if c not in ADDED]
    m = docs.select(F.struct(*own).alias("_row"), _metrics(F.coalesce(F.col(text), F.lit(""))).alias("_metrics"))
    failed = lambda table: F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in table]))
    m = m.select("_row", "_metrics", failed(base).alias("_base"), failed(rules).alias("_rules"))
    return m.select(
        "_row.*",
        *[F.col(f"_metrics.{place}").alias(name) for name, place in _PLACES.items()],
        (F.size("_base") > 0).alias("base_failed"),
        F.concat("_base", "_rules").alias("failed_rules"),
        ((F.size("_base") == 0) & (F.size("_rules") == 0)).alias("kept"),
    )


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bangs", "base_failed", "failed_rules", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes every rule, with the columns of ``docs``, whatever their names.

    Rows with a null, empty or short text go; equal rows stay or go together; an empty table stays empty.
    """
    marked = quality(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text")))
    # A filter is not pushed below this column; pushed, it would evaluate the metrics once for each rule.
    return marked.withColumn("_place", F.monotonically_increasing_id()).where("kept and _place >= 0").select("_doc.*")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP1_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM t)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (
  SELECT t.doc_id, len(w) AS n_words, length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS word_chars,
         length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words,
         length(s) - length(replace(s, '!', '')) AS n_bangs
  FROM t LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 10 * n_words OR 100 * n_bangs > 30 * n_words OR 100 * n_stop_words < 2 * n_words
         OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM b"""
