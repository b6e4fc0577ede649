"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Candidates are tokens of 20 or more characters of the encodings' alphabets. For each, an
encoding is inferred and three tests ask whether it looks drawn at random: chi-squared
uniformity over the alphabet, runs of character classes, lag-one serial correlation. The
null hypothesis is ordinary text: its letter frequencies, class changes and correlation are
counted over all documents, and a test's p-value is the chance that ordinary text of the same
length looks at least as random. Fisher's method combines the three; the Benjamini-Hochberg
step, taken apart for each stratum of lengths, accepts candidates at a false-discovery rate.

``fit`` reads the texts once and leaves a small model; ``find`` and ``redact`` are maps.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.llm.common import map_arrow, text_bytes
from loomline.session import materialise, spread

KINDS = ("assign", "access", "hex")
ADDED_KIND = "random"
LEAST = 20
RATE = 0.001
STRATA = (20, 32, 48, 80)

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ASSIGN_KEYS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Inferred encodings, the narrowest first: name, alphabet.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("digits", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _DIGITS + _UPPER + _LOWER + "+/_-"),
)
_SETS = tuple((name, frozenset(a)) for name, a in ENCODINGS)
_CLASS = np.zeros(128, np.int64)
for _c, _chars in enumerate((_LOWER, _UPPER, _DIGITS, "+/_-="), 1):
    _CLASS[[ord(x) for x in _chars]] = _c


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, sorted."""
    out = []
    low = raw.lower()
    if any(k in low for k in _ASSIGN_KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def statistics(token: str) -> tuple[int, int, float, int, float]:
    """(encoding, length, chi-squared, class changes, lag-one correlation) of a token without its padding."""
    chars = set(token)
    enc = next((i for i, (_, s) in enumerate(_SETS) if chars <= s), len(_SETS) - 1)
    alphabet = ENCODINGS[enc][1]
    codes = np.frombuffer(token.encode(), np.uint8).astype(np.int64)
    n, k = len(codes), len(alphabet)
    counts = np.bincount(codes, minlength=128)
    chi2 = float((counts.astype(float) ** 2).sum() * k / n - n)
    classes = _CLASS[codes]
    changes = int((classes[1:] != classes[:-1]).sum())
    x = _place(enc)[codes]
    a, b = x[:-1] - x[:-1].mean(), x[1:] - x[1:].mean()
    spread = math.sqrt(float((a * a).sum() * (b * b).sum()))
    return enc, n, chi2, changes, float((a * b).sum() / spread) if spread else 1.0


_places: dict[int, np.ndarray] = {}


def _place(enc: int) -> np.ndarray:
    if enc not in _places:
        at = np.zeros(128)
        for i, x in enumerate(ENCODINGS[enc][1]):
            at[ord(x)] = i
        _places[enc] = at
    return _places[enc]


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, statistics) of tokens that overlap no base span."""
    taken, at = sorted((s, e) for s, _, e in base), 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if any(b > s for _, b in itertools.takewhile(lambda x: x[0] < e, itertools.islice(taken, at, None))):
            continue
        body = m.group().rstrip("=")
        if len(body) >= LEAST:
            yield s, e, statistics(body)


@dataclass
class Null:
    """What ordinary text looks like, per encoding: sums of letter shares, correlation; and the rate of class changes."""

    p2: np.ndarray
    p3: np.ndarray
    correlation: np.ndarray
    change: float

    @classmethod
    def of(cls, pairs: np.ndarray) -> Null:
        """From counts of neighbouring characters (128 x 128)."""
        n = len(ENCODINGS)
        p2, p3, corr = np.zeros(n), np.zeros(n), np.zeros(n)
        for i, (_, alphabet) in enumerate(ENCODINGS):
            at = [ord(x) for x in alphabet]
            own = pairs[np.ix_(at, at)].astype(float) + 1e-3
            p = own.sum(axis=1) / own.sum()
            p2[i], p3[i] = (p**2).sum(), (p**3).sum()
            x = np.arange(len(at), dtype=float)
            q, r = own.sum(axis=1) / own.sum(), own.sum(axis=0) / own.sum()
            mx, my = (q * x).sum(), (r * x).sum()
            cov = (own / own.sum() * np.outer(x - mx, x - my)).sum()
            corr[i] = cov / max(1e-9, math.sqrt((q * (x - mx) ** 2).sum() * (r * (x - my) ** 2).sum()))
        marked = _CLASS > 0
        inside = pairs[np.ix_(marked, marked)].astype(float)
        same = sum(pairs[np.ix_(_CLASS == c, _CLASS == c)].sum() for c in range(1, 5))
        change = 1 - same / inside.sum() if inside.sum() else 0.05
        return cls(p2, p3, corr, min(0.5, max(0.01, float(change))))

    def p_value(self, enc: np.ndarray, n: np.ndarray, chi2: np.ndarray, changes: np.ndarray, corr: np.ndarray) -> np.ndarray:
        """Chance that ordinary text of these lengths looks at least as random (arrays of one length)."""
        k = np.array([len(a) for _, a in ENCODINGS], float)[enc]
        p2, p3 = self.p2[enc], self.p3[enc]
        mean = k * (1 - p2) + n * k * p2 - n
        sd = k * np.sqrt(np.maximum(4 * n * (p3 - p2**2), 0) + 2 * p2) + 1e-9
        uniform = _phi((chi2 - mean) / sd)
        m = np.maximum(n - 1, 1) * self.change
        runs = _phi((m - changes + 0.5) / np.sqrt(m * (1 - self.change)))
        serial = _phi((np.abs(corr) - np.abs(self.correlation[enc])) * np.sqrt(n))
        half = -(np.log(uniform) + np.log(runs) + np.log(serial))  # half of Fisher's statistic, 6 degrees of freedom
        return np.exp(-half) * (1 + half + half**2 / 2)


def _phi(z: np.ndarray) -> np.ndarray:
    return np.maximum(np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in np.atleast_1d(z).tolist()]), 1e-300)


def stratum(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(STRATA), n, side="right") - 1


def cut_off(hist: dict[tuple[int, int], int], rate: float) -> list[float]:
    """Benjamini-Hochberg per stratum from counts of candidates in bins of -10 log10 p (upper edges, so never too many)."""
    cuts = []
    for s in range(len(STRATA)):
        bins = sorted(((b, c) for (t, b), c in hist.items() if t == s), reverse=True)
        total, seen, cut = sum(c for _, c in bins), 0, -1.0
        for b, c in bins:
            seen += c
            if 10 ** (-b / 10) <= rate * seen / total:
                cut = 10 ** (-b / 10)
        cuts.append(cut)
    return cuts


@dataclass
class Model:
    null: Null
    cuts: list[float]

    def spans(self, text: str, raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, added spans), each (start, index of kind, end)."""
        base = base_spans(text, raw)
        found = list(candidates(text, base))
        if not found:
            return base, []
        enc, n, chi2, changes, corr = (np.array(x) for x in zip(*(st for _, _, st in found)))
        p = self.null.p_value(enc, n, chi2, changes, corr)
        ok = p <= np.array(self.cuts)[stratum(n)]
        return base, [(s, len(KINDS), e) for (s, e, _), good in zip(found, ok) if good]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate statistics of every text, and at the end the task's counts of neighbouring characters as rows of enc -1."""
    total = np.zeros(128 * 128, np.int64)
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    names = ["enc", "n", "chi2", "changes", "corr"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows = []
        for value in batch["text"]:
            raw = value.as_py()
            b = np.frombuffer(raw, np.uint8)
            code = b[:-1].astype(np.int32) * 128 + b[1:]
            total += np.bincount(code[(b[:-1] < 128) & (b[1:] < 128)], minlength=128 * 128) if len(b) > 1 else 0
            text = raw.decode("utf-8", "replace")
            rows += [st for _, _, st in candidates(text, base_spans(text, raw))]
        if rows:
            yield out(rows)
    some = np.flatnonzero(total)
    if len(some):
        yield out([(-1, int(total[c]), 0.0, int(c), 0.0) for c in some])


def _binned(batches: Iterable[pa.RecordBatch], null) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        enc, n, chi2, changes, corr = (batch[c].to_numpy(zero_copy_only=False) for c in ("enc", "n", "chi2", "changes", "corr"))
        p = null.value.p_value(enc, n, chi2, changes, corr)
        bins = np.floor(np.minimum(-10 * np.log10(np.maximum(p, 1e-100)), 1000)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"stratum": pa.array(stratum(n).astype(np.int32)), "bin": pa.array(bins)})


def fit(docs: DataFrame, rate: float = RATE) -> Model:
    """Counts ordinary text and candidates over all documents; the model is a few hundred numbers."""
    spark = docs.sparkSession
    seen = materialise(map_arrow(docs.select(text_bytes().alias("text")), _pairs, "enc int, n long, chi2 double, changes long, corr double"), "secret-candidates")
    counts = seen.where("enc = -1").groupBy("changes").agg(F.sum("n").alias("n")).collect()  # at most 128 * 128 rows
    pairs = np.zeros(128 * 128, np.int64)
    for r in counts:
        pairs[r["changes"]] = r["n"]
    null = Null.of(pairs.reshape(128, 128))
    shared = spark.sparkContext.broadcast(null)
    hist = map_arrow(seen.where("enc >= 0"), lambda b: _binned(b, shared), "stratum int, bin int").groupBy("stratum", "bin").count().collect()  # bounded by strata and bins
    return Model(null, cut_off({(r["stratum"], r["bin"]): r["count"] for r in hist}, rate))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED_KIND)
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _found(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        cols: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for value in batch["text"]:
            raw = value.as_py()
            base, added = m.spans(raw.decode("utf-8", "replace"), raw)
            for i, k in enumerate(KINDS):
                cols[f"n_{k}"].append(sum(x[1] == i for x in base))
            cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols["spans"].append(_joined(base + added))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {c: pa.array(v, pa.int64() if c.startswith("n_") else pa.string()) for c, v in cols.items()})


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    A null or empty text has no spans. Repeated rows are scanned each; an empty table gives no rows.
    Offsets are code points of the whole text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_arrow(src, lambda b: _found(b, shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(batches: Iterable[pa.RecordBatch], model, mark: str) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        texts = []
        for value in batch["_text"]:
            raw = value.as_py()
            if raw is None:
                texts.append(None)
                continue
            text = raw.decode("utf-8", "replace")
            base, added = m.spans(text, raw)
            parts, at = [], 0
            for s, _, e in sorted(base + added):
                if e > at:
                    parts += [text[at : max(s, at)], mark] if s >= at else []
                    at = e
            texts.append("".join([*parts, text[at:]]) if parts else text)
        yield pa.RecordBatch.from_pydict({"_row": batch["_row"], "_text": pa.array(texts, pa.string())})


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span in text replaced by ``mark`` and n_chars, where there, counted anew.

    Overlapping spans become one mark. A null text stays null and keeps its n_chars, an empty one stays
    empty; repeated rows are redacted each; an empty table stays empty. Other columns stay, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("_row"), F.col("text").cast("binary").alias("_text"))
    rows = map_arrow(rows, lambda b: _redacted(b, shared, mark), f"_row {rows.schema['_row'].dataType.simpleString()}, _text string")
    value = {c: F.col(f"_row.{c}").alias(c) for c in rest} | {"text": F.col("_text").alias("text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("_text").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*[value[c] for c in docs.columns])


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return find(docs, fit(docs))
