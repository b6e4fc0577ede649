"""URL filter: rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov models of the URLs that the rules accept and
reject. A gram (context and symbol, up to ``order`` symbols) is kept when it was counted at least
``least`` times, however large the input is, so the models grow with it; they are joined by a
shuffle, and only grams that hold much of all places are broadcast. A symbol is predicted by the
longest kept gram that ends there. Each gram carries the increment of its log-likelihood ratio over that of
its longest proper suffix (kept too, as it is at least as frequent), so a URL's score is a plain
sum over its grams. The score is divided by the URL's length; the threshold is the one that
separates best the judged URLs of a fold that the models never saw.

Only DataFrame functions; counts cover all URLs of the training folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline.operators.joins import join_hot
from loomline.session import materialise

#: The rules of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
#: A gram counted this often is kept; it needs no share of all places besides.
LEAST = 2
SHARE = 0.0
#: Symbols besides a-z and 0 (for any digit); every other character counts as ~.
_MARKS = "./_?=&%#:-"
ALPHABET = 26 + 1 + len(_MARKS) + 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """What the models read: ^, the url after ``://`` in the small alphabet, $."""
    at = F.instr(url, "://")
    text = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url), F.lit(""))
    text = F.regexp_replace(F.translate(text, UPPER, LOWER), "[0-9]", "0")
    return F.concat(F.lit("^"), F.regexp_replace(text, r"[^a-z0./_?=&%#:\-]", "~"), F.lit("$"))


def _grams(rows: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """A row for each gram of ``_s``. Symbols are taken from an array, so a long URL costs in proportion to its length."""

    def of(w: Column) -> Column:
        def of_size(k: int) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
            found = F.transform(places, lambda i: F.concat(*[F.get(w, i + j) for j in range(k)]))
            return F.when(F.size(w) >= k, found).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[of_size(k) for k in range(1, order + 1)]))

    symbols_ = F.filter(F.split("_s", ""), lambda x: x != "")
    return rows.select(*keep, F.explode(F.flatten(F.transform(F.array(symbols_), of))).alias("gram"))


def train(judged: DataFrame, order: int = ORDER, least: int = LEAST, weight: float = 4.0) -> DataFrame:
    """(gram, delta): increments of the log-likelihood ratio accepted over rejected.

    ``judged`` has ``_s``, ``_n`` (how many rows the url stands for) and ``accept`` (boolean).
    """
    counted = _grams(judged, order, ["accept", "_n"])
    counts = counted.groupBy("gram").agg(F.sum(F.when(F.col("accept"), F.col("_n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accept"), 0).otherwise(F.col("_n"))).alias("r"))
    counts = materialise(counts.withColumn("k", F.length("gram")), "url-counts")
    sums = counts.where("k = 1 and gram != '^'").agg(F.sum("a"), F.sum("r")).first()
    total_a, total_r = sums[0] or 0, sums[1] or 0
    kept = materialise(counts.where(F.col("a") + F.col("r") >= least), "url-kept")
    contexts = kept.select(F.col("gram").alias("context"), F.col("a").alias("ca"), F.col("r").alias("cr"))
    flat = F.lit(1.0 / ALPHABET)
    smooth = lambda n, c, lower: (F.col(n) + weight * lower) / (c + weight)
    level = kept.where("k = 1 and gram != '^'").select("gram", smooth("a", F.lit(total_a), flat).alias("pa"), smooth("r", F.lit(total_r), flat).alias("pr"))
    level = level.withColumn("delta", F.log("pa") - F.log("pr"))
    levels = level.select("gram", "delta")
    for k in range(2, order + 1):  # a suffix or context has at most as many grams as the alphabet has symbols
        lower = level.select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        level = (
            kept.where(F.col("k") == k)
            .join(lower, F.expr("substring(gram, 2)") == F.col("suffix"))
            .join(contexts.where(F.length("context") == k - 1), F.expr(f"substring(gram, 1, {k - 1})") == F.col("context"))
            .select("gram", smooth("a", F.col("ca"), F.col("la")).alias("pa"), smooth("r", F.col("cr"), F.col("lr")).alias("pr"), "la", "lr")
        )
        level = level.select("gram", "pa", "pr", (F.log("pa") - F.log("pr") - F.log("la") + F.log("lr")).alias("delta"))
        level = materialise(level, "url-level")
        levels = levels.unionByName(level.select("gram", "delta"))
    return levels


def _scores(texts: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(_s, c, score) for each row of ``texts`` (_s, distinct, and c)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not left to their size
    texts = materialise(texts.repartition(parts, "_s").withColumn("_id", F.monotonically_increasing_id()), "url-texts")
    grams = _grams(texts.repartition(parts, "_id"), order, ["_id"])
    often = grams.groupBy("gram").agg(F.count("*").alias("weight"))
    deltas = materialise(often.join(model, "gram", "left").select("gram", "weight", F.coalesce("delta", F.lit(0.0)).alias("delta")), "url-deltas")
    totals = join_hot(grams, deltas, "gram", "weight", "inner").groupBy("_id").agg(F.sum("delta").alias("total"))
    return materialise(texts.join(totals, "_id").select("_s", "c", (F.col("total") / (F.length("_s") - 1)).alias("score")), "url-text-scores")


def _threshold(scores: DataFrame, width: float = 0.01) -> float:
    """The cut with the best balanced accuracy on judged rows, from a histogram of at most 2001 bins."""
    bins = F.least(F.greatest(F.floor(F.col("score") / width), F.lit(-1000)), F.lit(1000)).alias("bin")
    rows = scores.groupBy(bins).agg(F.sum(F.when(F.col("accept"), F.col("_n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accept"), 0).otherwise(F.col("_n"))).alias("r")).orderBy("bin").collect()
    a, r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not a or not r:
        return 0.0
    best, cut, below_a, below_r = -1.0, 0.0, 0, 0
    for x in rows:
        accuracy = (a - below_a) / a + below_r / r
        if accuracy > best or accuracy == best and abs(x["bin"] * width) < abs(cut):
            best, cut = accuracy, x["bin"] * width
        below_a, below_r = below_a + x["a"], below_r + x["r"]
    return cut


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER, least: int = LEAST, folds: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-likelihood ratio a symbol) for each row of ``pages``.

    ``pages`` needs page_id and url. A null url, or one without ``://``, has an empty host and
    path, no rule, and a score from what text it has. Rows that repeat a page_id and url are
    scored once and come back as often as they were given. Where the rules accept no URL, or
    reject none, the models are equal but for smoothing and the threshold is 0. An empty table
    gives no rows. Long URLs cost in proportion to their length.
    """
    rows = pages.groupBy("page_id", "url").agg(F.count("*").alias("_n"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", "_n", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(folds))
    rows = materialise(rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), symbols(F.col("url")).alias("_s"), fold.alias("fold")), "url-rows")
    judged = rows.where("by_rule is not null").withColumn("accept", F.col("by_rule") == "allow")
    model = train(judged.where("fold != 0").groupBy("_s", "accept").agg(F.sum("_n").alias("_n")), order, least)

    # What a URL scores depends on its symbols alone, and URLs that differ in digits share them.
    scores = _scores(rows.groupBy("_s").agg(F.count("*").alias("c")), model, order)
    keys = ["page_id", "url", "_n", "host", "path", "rule", "by_rule", "fold"]
    scored = materialise(join_hot(rows, scores, "_s", "c", "inner").select(*keys, "score"), "url-scores")
    cut = _threshold(scored.where("by_rule is not null and fold = 0").withColumn("accept", F.col("by_rule") == "allow"))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    out = scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score", "_n")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).drop("_n", "_i")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
