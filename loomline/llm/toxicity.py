"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a text: densities of a written lexicon and of a learned one (words, word
beginnings), lexicon words near second-person pronouns, capitals, punctuation, obfuscated
and stretched words. All is fitted on one bounded sample of labelled rows (``sample_rows``, the
rows with the least hash of doc_id): a fifth calibrates, the rest teaches lexicon and trees. The
trees see a row's densities by a lexicon learned without that row's fold, at every size of the
sample alike; calibration rows and scored texts get those of the whole lexicon, which has at most
``lexicon_size`` terms. Scoring is a map over all documents with the small model broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.llm.common import map_arrow, text_bytes
from loomline.session import materialise, spread

SAMPLE_ROWS = 30_000
LEXICON_SIZE = 5000
FOLDS = 4
THRESHOLD = 0.7

# Insults and second-person pronouns.
INSULTS = (
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown clowns dumb fool fools ugly filth vermin garbage "
    "imbecile retard freak creep pig pigs scumbag bastard bitch asshole shit fuck fucking"
).split()
PRONOUNS = "you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre vos usted ustedes vosotros tus".split()

#: All ASCII but letters, digits and the signs that hide letters become spaces; A-Z lower case.
_HIDERS = b"@$0*"
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in _HIDERS else 32 for b in range(256))
_PLAIN = bytes.maketrans(b"@$0134578", b"asoieastb")
_HIDDEN = re.compile(rb"[a-z][@$*0-9]+[a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
STEMS = (4, 5, 6, 7, 8)
FEATURES = (
    "insult_density", "insult_count", "learned_density", "learned_count", "learned_weight", "learned_most", "stem_density", "stem_count", "stem_weight", "near_second_person", "pronoun_density",
    "capital_ratio", "shout_ratio", "exclamation_ratio", "punctuation_ratio", "hidden_density", "stretched_density", "log_words",
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def stems_of(word: bytes) -> list[bytes]:
    return [word[:k] for k in STEMS if len(word) >= k]


@dataclass
class Lexicon:
    """Weights (log-odds against the base rate) of words and of word beginnings."""

    words: dict = field(default_factory=dict)
    stems: dict = field(default_factory=dict)


_INSULTS = frozenset(w.encode() for w in INSULTS)
_PRONOUNS = frozenset(w.encode() for w in PRONOUNS)


class Extractor:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.seen = lexicon, _Kinds(lexicon)

    def features(self, raw: bytes) -> list[float]:
        words = words_of(raw)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        kinds = list(map(self.seen.__getitem__, words))
        marked = [(i, k) for i, k in enumerate(kinds) if k]
        insults = learned = learned_sum = learned_most = stems = weight = hidden = stretched = pronouns = 0.0
        bad, you = [], []
        for i, (is_insult, is_learned, stem, is_you, is_hidden, is_stretched) in marked:
            insults += is_insult
            learned += is_learned > 0
            learned_sum += is_learned
            learned_most = max(learned_most, is_learned)
            stems += stem > 0
            weight = max(weight, stem)
            hidden += is_hidden
            stretched += is_stretched
            pronouns += is_you
            if is_insult or is_learned > 0 or stem > 0:
                bad.append(i)
            if is_you:
                you.append(i)
        near = 0
        if bad and you:
            at = np.searchsorted(you, bad)
            near = sum(1 for b, j in zip(bad, at) if (j < len(you) and you[j] - b <= 5) or (j and b - you[j - 1] <= 5))
        codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters = codes[65:91].sum() + codes[97:123].sum()
        marks = codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum()
        capitals = codes[65:91].sum() / max(1, letters)
        return [
            insults / n, min(insults, 50.0), learned / n, min(learned, 50.0), min(learned_sum, 100.0), learned_most, stems / n, min(stems, 50.0), weight, near / n, pronouns / n,
            float(capitals), float(capitals > 0.6), float(codes[33] / n), float(marks / max(1, len(raw))), hidden / n, stretched / n, float(np.log1p(n)),
        ]


class _Kinds(dict):
    """word -> what it counts for, or None for the most part; bounded."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes):
        if len(self) > 400_000:
            self.clear()
        hidden = bool(_HIDDEN.search(word))
        plain = word.translate(_PLAIN) if hidden else word
        stem = max((self.lexicon.stems.get(s, 0.0) for s in stems_of(plain)), default=0.0)
        kind = (plain in _INSULTS, self.lexicon.words.get(plain, 0.0), stem, word in _PRONOUNS, hidden, bool(_STRETCHED.search(word)))
        self[word] = kind = kind if any(kind) else None
        return kind


# ---- gradient-boosted trees on binned features, logistic loss


@dataclass
class Tree:
    """A full binary tree of ``depth``: at each inner node go right if feature > cut."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - (2**self.depth - 1)]


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> tuple[Tree, np.ndarray]:
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(g), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = (1e-6, 0, np.inf, None)
        if len(rows) >= 2 * least:
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = bins[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, e[k], k)
        if best[3] is not None:
            feature[node], cut[node] = best[1], best[2]
            right = bins[rows, best[1]] > best[3]
        else:
            right = np.zeros(len(rows), bool)
        at[rows] = 2 * node + 1 + right
    leaf = at - inner
    value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
    return Tree(depth, feature, cut, value), value[leaf]


@dataclass
class Model:
    lexicon: Lexicon
    start: float
    rate: float
    trees: list[Tree]
    xs: np.ndarray
    ys: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.xs, self.ys)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 3, ridge: float = 1.0) -> tuple[float, float, list[Tree]]:
    p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return start, rate, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65), method="lower"))[:-1] for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    out, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-out))
        tree, step = _grow(bins, edges, p - y, p * (1 - p) + 1e-9, depth, least, ridge)
        trees.append(tree)
        out += rate * step
    return start, rate, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots for interpolation, from a prior of one row of either label at the ends."""
    if not len(y):
        return np.array([-4.0, 4.0]), 1 / (1 + np.exp(np.array([4.0, -4.0])))
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of raw
    for r, t in zip(raw[order], y[order]):
        blocks.append([1.0, float(t), float(r)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, r2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + r2]
    xs = np.array([b[2] / b[0] for b in blocks])
    ys = np.array([(b[1] + 0.02) / (b[0] + 0.04) if b[0] < 1e9 else b[1] / b[0] for b in blocks])
    span = max(1.0, float(xs[-1] - xs[0]))  # a slight slope beyond the ends keeps the order of extreme scores
    xs = np.concatenate([[xs[0] - span], xs, [xs[-1] + span]])
    ys = np.concatenate([[ys[0] * 0.5], ys, [(ys[-1] + 1) / 2]])
    return xs, np.maximum.accumulate(ys)


# ---- fitting and scoring on documents


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of a fold a word (as itself: ``=word``) or a word beginning is; one row a term, fold and task."""
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        terms, folds, labels = zip(*seen) if seen else ((), (), ())
        out = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.binary()), "fold": pa.array(folds, pa.int32()), "toxic": pa.array(labels, pa.int32()), "n": pa.array(seen.values(), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        for raw, label, fold in zip(batch["text"], batch["toxic"].to_pylist(), batch["fold"].to_pylist()):
            words = set(words_of(raw.as_py()))
            seen.update((term, fold, label) for term in {b"=" + w for w in words}.union(*map(stems_of, words)))
        if len(seen) > 300_000:
            yield rows()
    yield rows()


def _featured(batches: Iterable[pa.RecordBatch], lexica) -> Iterator[pa.RecordBatch]:
    """Features by the lexicon of a row's fold; fold -1 is the calibration part, lexicon -1 the whole one."""
    extract = {fold: Extractor(lexicon) for fold, lexicon in lexica.value.items()}
    for batch in batches:
        x = [extract[fold].features(raw.as_py()) for raw, fold in zip(batch["text"], batch["fold"].to_pylist())]
        yield pa.RecordBatch.from_pydict({"fold": batch["fold"], "toxic": batch["toxic"], "x": pa.array(x, pa.list_(pa.float64()))})


def _scored(batches: Iterable[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    fitted = model.value
    extract = Extractor(fitted.lexicon)
    for batch in batches:
        x = np.array([extract.features(raw.as_py()) for raw in batch["text"]]).reshape(-1, len(FEATURES))
        s = np.clip(fitted.score(x), 0.0, 1.0)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def lexica_of(counted: DataFrame, sizes: dict[tuple[int, int], int], lexicon_size: int) -> dict[int, Lexicon]:
    """The whole lexicon (-1) and one without each fold, from ``counted`` (term, t0.., c0..) and rows by (fold, label).

    A term is learned if it is in 3 toxic texts and in twice as many toxic texts as clean ones; the
    ``lexicon_size`` of most toxic texts over that rate are kept.
    """
    lexica = {}
    for fold in range(-1, FOLDS):
        own = [f for f in range(FOLDS) if f != fold]
        t, c = (sum((F.col(f"{k}{f}") for f in own), F.lit(0)) for k in "tc")
        best = counted.select("term", t.alias("t"), c.alias("c")).where("t >= 3 and t >= 2 * c").orderBy(F.desc(F.expr("t - 2 * c")), "term").limit(lexicon_size).collect()
        toxic, clean = (sum(sizes.get((f, label), 0) for f in own) for label in (1, 0))
        base = np.log((toxic + 1) / (clean + 1))
        weight = {bytes(r["term"]): max(0.1, float(np.log((r["t"] + 0.2) / (r["c"] + 0.2)) - base)) for r in best}
        lexica[fold] = Lexicon({w[1:]: x for w, x in weight.items() if w.startswith(b"=")}, {w: x for w, x in weight.items() if not w.startswith(b"=")})
    return lexica


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_size: int = LEXICON_SIZE) -> Model:
    """A model from at most ``sample_rows`` labelled rows that aren't held out.

    A doc_id with several labels counts as toxic if one says so, one with several texts is read by
    the least of them; null ids and labels are ignored. Without labels of both kinds, or without
    documents, the model falls back to the written lexicon.
    """
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    # Bounded by its parameter: sample_rows triples of numbers.
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(10))  # 8 and 9 calibrate
    chosen = chosen.withColumn("fold", F.when(part < 8, part % FOLDS).otherwise(-1).cast("int"))
    chosen = spark.createDataFrame(chosen.toPandas().astype({"doc_id": "int64", "toxic": "int32", "fold": "int32"}), "doc_id long, toxic int, fold int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = materialise(texts.groupBy("doc_id", "fold", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}

    counted = map_arrow(texts.where("fold >= 0").select("toxic", "fold", "text"), _counts, "term binary, fold int, toxic int, n long")
    of = lambda label, f: F.sum(F.when((F.col("toxic") == label) & (F.col("fold") == f), F.col("n")).otherwise(0))
    counted = counted.groupBy("term").agg(*[of(1, f).alias(f"t{f}") for f in range(FOLDS)], *[of(0, f).alias(f"c{f}") for f in range(FOLDS)])
    lexica = lexica_of(materialise(counted.where(" + ".join(f"t{f}" for f in range(FOLDS)) + " >= 3"), "toxicity-terms"), sizes, lexicon_size)
    lexicon = lexica[-1]

    shared = spark.sparkContext.broadcast(lexica)
    got = map_arrow(texts.select("fold", "toxic", "text"), lambda b: _featured(b, shared), "fold int, toxic int, x array<double>").toArrow()
    fold, y = got["fold"].to_numpy(), got["toxic"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y, fold))  # rows come in any order; the fit doesn't depend on it
    fold, y, x = fold[order], y[order], x[order]
    start, rate, trees = boost(x[fold >= 0], y[fold >= 0])
    model = Model(lexicon, start, rate, trees, np.array([0.0]), np.array([0.0]))
    if not trees:
        model.trees = [Tree(1, np.array([1]), np.array([0.5]), np.array([-3.0, 3.0]))]
        model.start, model.rate, model.xs, model.ys = 0.0, 1.0, np.array([-3.0, 3.0]), np.array([0.05, 0.9])
        return model
    model.xs, model.ys = isotonic(model.raw(x[fold < 0]), y[fold < 0])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    A null or empty text has all features 0 and gets the score of such texts. Repeated rows
    are scored each. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = map_arrow(src, lambda b: _scored(b, shared, threshold), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = spread(read("documents").select("doc_id", "text"))
    return score(docs, fit(docs, read("labels").select("doc_id", "toxic")))
