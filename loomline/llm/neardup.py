"""Near duplicates by fast similarity sketching, banding and exact verification.

A text's set is its distinct 5-word shingles. Equal sets collapse to one class before
anything else, so thousands of exact copies cost one row. A class is sketched by rounds
of hashed bin placement (Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching", 2017):
in round i < t every element is thrown into one of t bins, from round t on bin i - t gets
every element, and a bin keeps the least (round, hash); so every bin fills and agreement
between two sketches concentrates around their Jaccard similarity. Bands of the sketch
give candidates, and only pairs whose full sets reach the threshold become links.

Links between classes of one bucket are decided in two rounds, without all pairs of a
bucket. Round one compares each class with the most central class it shares a bucket with.
Round two looks only at buckets whose classes are still in several components, and there
compares classes outside the bucket's largest component with classes of other components,
as far as an exact prefix filter lets them be linked; pairs inside one component can't
change the result. Together the rounds decide every candidate pair that matters, so
components equal those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.llm.common import WordHashes, free_name, map_arrow, mix64, shingle_set, text_bytes
from loomline.operators.components import connected_components
from loomline.operators.joins import join_hot
from loomline.session import materialise, spread

BANDS, ROWS = 24, 4
#: At 0.85 a pair shares no band with probability (1 - 0.85**4)**24 < 3e-8.
THRESHOLD = 85
#: Bands of set size between a size and the largest that may be linked with it.
BANDS_A_STEP = 4


def sketch(values: np.ndarray, t: int) -> np.ndarray:
    """t bins (uint64: round in the top byte, then hash bits) of a non-empty set of 64-bit hashes."""
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, done, empty = len(values), 0, None
    block = max(1, min(t, int(t * np.log(t) * 1.5) // n + 1))
    with np.errstate(over="ignore"):
        while done < t:
            rounds = np.arange(done, min(t, done + block), dtype=np.uint64)
            h = mix64(values[None, :] + mix64((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None])
            placed = (rounds << np.uint64(56))[:, None] | (h >> np.uint64(8))
            np.minimum.at(bins, ((h & np.uint64(0xFFFFFF)) % np.uint64(t)).astype(np.int64).ravel(), placed.ravel())
            done += block
            empty = np.flatnonzero(bins == np.iinfo(np.uint64).max)
            if not len(empty):
                return bins
        for at in range(0, len(empty), max(1, 4096 // n)):
            some = empty[at : at + max(1, 4096 // n)].astype(np.uint64)
            rounds = some + np.uint64(t)
            h = mix64(values[None, :] + mix64((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None])
            bins[some.astype(np.int64)] = (rounds << np.uint64(56)) | (h.min(axis=1) >> np.uint64(8))
    return bins


def band_keys(bins: np.ndarray, bands: int) -> np.ndarray:
    rows = bins.reshape(bands, -1)
    with np.errstate(over="ignore"):
        h = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        for i in range(rows.shape[1]):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def _sketched(batches: Iterable[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ns, keys, bks = [], [], []
        for raw in batch["text"]:
            s = shingle_set(raw.as_py().lower().split(), hashes, k)
            ns.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bks.append(band_keys(sketch(s, bands * rows), bands) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["mark"], pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(bks, pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "key", "bands"]
        )


def _sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(raw.as_py().lower().split(), hashes, k) for raw in batch["text"]]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "set"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of class keys whose full sets reach the threshold.

    Both joins are plain sort-merge joins between two shuffles, so a class that many
    others are compared with is split at run time (AQE skew join).
    """
    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")).hint("merge"), "a")
    two = one.join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
    both = two.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * threshold).select("a", "b")


def _undecided_pairs(classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of ``classes`` (key, n, component, outside) that may be linked and lie in different components.

    Prefix filter: with shingles in one order, rare ones first, a pair's first common shingle stands so early in
    both sets that enough of either is left after it. Shingles that only the edits of a copy have come first,
    so an outsider of a large group of near copies meets few others. Of a pair, the smaller set needs the shorter
    prefix: enough must be left for a partner of its own size. A place in the larger set leaves enough for
    partners up to some size only, so pairs also meet by bands of the smaller set's size: pages that share a
    frame but differ in more than the threshold allows share no key. Nothing that can be linked is lost.
    """
    shingles = sets.join(classes, "key").select("key", "n", "component", "outside", F.explode("set").alias("s"))
    often = materialise(shingles.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "nd-often")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("key"))  # shingles of one class come first and have no partner
    place = F.row_number().over(Window.partitionBy("key").orderBy("df", "s")) - 1
    early = shingles.join(often.hint("merge"), "s").withColumn("left", F.col("n") - (alone + place))
    early = materialise(early.where(F.col("left") * 100 >= F.col("n") * threshold).drop("df"), "nd-early")

    width = math.log(100 / min(threshold, 99)) / BANDS_A_STEP
    band = lambda n: F.floor(F.log(n.cast("double")) / width).cast("int")
    least = F.expr(f"({threshold} * n + 99) div 100")  # sizes that may be linked with n from below
    most = F.least(F.col("n"), F.expr(f"(left * {100 + threshold} - {threshold} * n) div {threshold}"))
    small = early.where(F.col("left") * (100 + threshold) >= F.col("n") * (2 * threshold)).withColumn("band", band(F.col("n")))
    large = early.withColumn("least", least).withColumn("most", most).where("least <= most")
    large = large.withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.col("most"))))).drop("least", "most")

    near = F.least("x.left", "y.left") * (100 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key")))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        met = (F.col("x.s") == F.col("y.s")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & once & near
        return x.alias("x").join(y.alias("y"), met).select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b"))

    return meet(small.where("outside"), large).unionByName(meet(small.where("not outside"), large.where("outside"))).distinct()


def row_mark() -> Column:
    """128 bits, in hex, that rows share if their doc_id and text are equal (a null text is empty); copies no text."""
    text = F.coalesce("text", F.lit(""))
    return F.concat(F.hex(F.xxhash64("doc_id", text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text, "doc_id")))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key (class of equal sets), copies (documents in the class), component and mark.

    ``docs`` needs doc_id and text; other columns are not read. Texts with fewer than k
    words have their whole word sequence as one shingle. A null text, or one without
    words, has the empty set and is linked with nothing: component_id is its doc_id. Rows
    may repeat a doc_id; each row is judged by its own text. A null doc_id never
    becomes a component_id unless all of a component's are null. ``component`` (a class key, null for
    the empty set) tells components apart where ids don't; ``mark`` is that of ``row_mark``.
    """
    src = docs.select("doc_id", text_bytes().alias("text"), row_mark().alias("mark"))
    marked = materialise(map_arrow(src, lambda b: _sketched(b, k, bands, rows), "doc_id long, mark string, n_shingles long, key binary, bands array<long>"), "nd-marked")
    classes = materialise(
        marked.where("key is not null").groupBy("key").agg(F.min(F.struct("bands", "n_shingles")).alias("s"), F.count("*").alias("copies"), F.min("doc_id").alias("least_doc"), F.min("mark").alias("mark")).select(
            "key", "copies", "least_doc", "mark", F.col("s.bands").alias("bands"), F.col("s.n_shingles").alias("n")
        ),
        "nd-classes",
    )
    placed = classes.select(F.explode("bands").alias("bucket"), "key", "n")
    buckets = materialise(placed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "nd-buckets")
    shared = materialise(placed.join(buckets.hint("merge"), "bucket").select("bucket", "key", "n"), "nd-shared")

    # The full sets of classes that share a bucket, from one text of each class.
    involved = shared.select("key").distinct().join(classes.select("key", "mark"), "key").select("mark")
    texts = src.join(involved.hint("shuffle_hash"), "mark", "left_semi").select("text")
    sets = materialise(map_arrow(texts, lambda b: _sets(b, k), "key binary, set array<long>").dropDuplicates(["key"]), "nd-sets")

    # A shingle that occurs in one class only is in no intersection: a class with too many of them has no link.
    alone = sets.select("key", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1")
    alone = alone.groupBy("key").agg(F.count("*").alias("alone"))
    common = sets.select("key", F.size("set").alias("n")).join(alone, "key", "left").select("key", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"), "n")
    live = materialise(common.where(F.col("common") * 100 >= F.col("n") * threshold).select("key"), "nd-live")
    placed = shared.join(live, "key").select("bucket", "key", "n")
    buckets = materialise(placed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "nd-live-buckets")
    placed = materialise(placed.join(buckets.hint("merge"), "bucket"), "nd-live-shared")
    # A class that shares much with many lies in large buckets: the most central class of a bucket is its pivot.
    central = placed.groupBy("key").agg(F.sum("c").alias("weight"))
    placed = materialise(placed.join(central, "key").select("bucket", "key", "n", "weight"), "nd-placed")
    pivots = materialise(placed.groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("pivot")), "nd-pivots")

    met = placed.select("bucket", "key").join(pivots.hint("merge"), "bucket").where(F.col("key") != F.col("pivot.key"))
    stars = met.groupBy("key").agg(F.max("pivot").alias("p"))
    stars = materialise(stars.select(F.greatest("key", "p.key").alias("a"), F.least("key", "p.key").alias("b")).distinct(), "nd-stars")
    links = materialise(_verified(stars, sets, threshold), "nd-links")
    comp = connected_components(links, "a", "b")

    inside = placed.select("bucket", "key", "n").join(comp.select(F.col("node").alias("key"), "component"), "key", "left")
    inside = materialise(inside.select("bucket", "key", "n", F.coalesce("component", "key").alias("component")), "nd-inside")
    parts = inside.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    open_buckets = materialise(parts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("m.component").alias("largest")), "nd-open")
    undecided = inside.join(open_buckets.hint("merge"), "bucket").groupBy("key", "n", "component").agg(F.max(F.col("component") != F.col("largest")).alias("outside"))
    more = _undecided_pairs(materialise(undecided, "nd-undecided"), sets, threshold).join(stars, ["a", "b"], "left_anti")
    late = materialise(_verified(more, sets, threshold), "nd-late")
    if not late.isEmpty():
        comp = connected_components(links.unionByName(late), "a", "b")

    # One row per class that needs more than its own doc_id: in a component, or copied.
    named = classes.select("key", "copies", "least_doc").join(comp.select(F.col("node").alias("key"), "component"), "key", "left")
    named = materialise(named.select("key", "copies", "least_doc", F.coalesce("component", "key").alias("component")), "nd-named")
    least = materialise(named.groupBy("component").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("c")).where("c > 1"), "nd-least")
    named = join_hot(named, least, "component", "c").select("key", "copies", "least_doc", "component", F.coalesce("component_id", "least_doc").alias("component_id"))
    other = (F.col("component") != F.col("key")) | ~F.col("component_id").eqNullSafe(F.col("least_doc"))
    many = materialise(named.where((F.col("copies") > 1) | other).select("key", "copies", "component_id", "component"), "nd-many")
    out = join_hot(marked.select("doc_id", "n_shingles", "key", "mark"), many.withColumn("weight", F.col("copies")), "key", "weight")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key", F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("component", "key").alias("component"), "mark",
    )


def keep_first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the least doc_id (null last), then class key, then mark.

    Of rows with equal doc_id and text any one stands for all. Rows without words (null and empty texts too) are
    linked with nothing and all stay. Rows with a null doc_id take part like others. An empty table stays empty.
    """
    found = near_duplicates(docs).where("key is not null")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "mark").alias("place")
    alike = found.select("component", "mark", order).groupBy("component", "mark").agg(F.min("place").alias("place"), F.count("*").alias("alike"))
    first = alike.groupBy("component").agg(F.min(F.struct("place", "alike")).alias("first"))
    mark = free_name("_mark", docs.columns)
    first = materialise(first.select(F.col("first.place.mark").alias(mark), F.col("first.alike").alias("alike")), "nd-first")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    single = first.where("alike = 1").select(mark)
    kept = docs.where(~worded).unionByName(docs.where(worded).join(single, row_mark() == F.col(mark), "left_semi"))
    repeated = first.where("alike > 1")
    if not repeated.isEmpty():  # a task passes one row of a mark on, however often it is repeated
        rows = docs.where(worded).select(F.struct(*docs.columns).alias("_doc"), row_mark().alias(mark))
        some = join_hot(rows, repeated, mark, "alike", "inner").groupBy(mark).agg(F.first("_doc").alias("_doc"))
        kept = kept.unionByName(some.select("_doc.*"))
    return kept


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, t.doc_id = k.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN k ON k.node = t.doc_id"""
