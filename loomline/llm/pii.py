"""Personal data: fixed patterns, and weak supervision for what they leave out.

Candidates are the fixed patterns' spans and looser ones (national phone numbers, identity
numbers, bank accounts, spelled-out e-mail addresses, titled names). Regex, gazetteer and
context labelers vote on each: for (1), against (-1) or nothing (0). Votes of all documents are
counted by pattern of votes and features, a table bounded by the number of such patterns;
expectation-maximisation (binary Dawid-Skene, one accuracy table per labeler) estimates the
labelers' reliabilities and a posterior for each pattern, and a logistic span classifier is
trained on those posteriors. Its verdict adds spans; spans of the fixed patterns always stay.

``fit`` reads the texts once and leaves a small model; ``find`` is a map.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.llm.common import map_arrow, text_bytes
from loomline.session import spread

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("ssn", "iban", "name")
ALL_KINDS = KINDS + ADDED_KINDS
THRESHOLD = 0.8

# Gazetteers and context words.
TLDS = frozenset("com org net edu gov info biz io de fr es uk eu at ch it nl be us ca".split())
CALLING_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "351", "32", "31")
FIRST_NAMES = frozenset(
    "james mary john linda robert susan michael sarah david anna thomas maria peter paul laura hans klaus ursula karl petra jean marie pierre sophie claude jose juan carmen luis ana pedro".split()
)
FOR = re.compile(
    r"(?:phone|tel|telefon|telefono|téléphone|teléfono|mobile|cell|call|fax|handy|e-?mail|mail|correo|contact|kontakt|card|karte|carte|tarjeta|visa|mastercard|ssn|social security|iban|account|konto|compte|cuenta|name|nombre|nom)\W{0,3}\w{0,12}\W{0,3}$", re.IGNORECASE
)
AGAINST = re.compile(r"(?:version|ver|v|order|invoice|isbn|issn|part|sku|ticket|serial|build|release|rfc|fig|table|chapter|page|#|no)\W{0,3}$", re.IGNORECASE)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole (a match can't start within one), so long runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+(.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,63})+")),
    ("name", re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-zà-öø-ÿ]{1,30}(?:\x20[A-Z][a-zà-öø-ÿ]{1,30})?(?![A-Za-z])")),
)
_NAME_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run before an @ starts a match or no place in it does."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) of the fixed patterns, sorted."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    has_digit = any(d in text for d in "0123456789")
    for kind, pattern in _LOOSE:
        if kind == "email" and not ("dot]" in text or "dot)" in text or " dot " in text):
            continue
        if kind == "name" and not any(t in text for t in _NAME_TITLES):
            continue
        if kind in ("phone", "ssn", "iban") and not has_digit:
            continue
        out += [(ALL_KINDS.index(kind), m.start(), m.end()) for m in pattern.finditer(text)]
    return out


class Taken:
    """Spans by start, and the furthest end so far: whether another span overlaps one of them."""

    def __init__(self, spans: Iterable[tuple[int, int, int]] = ()):
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))

    def overlaps(self, s: int, e: int) -> bool:
        before = bisect_left(self.starts, e)
        return before > 0 and self.reach[before - 1] > s

    def add(self, s: int, e: int) -> None:
        """A span that overlaps none of those here."""
        at = bisect_left(self.starts, s)
        self.starts.insert(at, s)
        self.reach.insert(at, e)


def free_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose spans that overlap no fixed one."""
    taken = Taken(base)
    return [x for x in loose_spans(text) if not taken.overlaps(x[1], x[2])]


LABELERS = ("checksum", "shape", "gazetteer", "before", "against", "repeats")


def votes(text: str, kind: int, s: int, e: int) -> tuple[int, ...]:
    span, name = text[s:e], ALL_KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, s - 40) : s]
    checksum = {"card": lambda: 1 if luhn(digits) else -1, "iban": lambda: 1 if _mod97(span) else -1, "ssn": lambda: -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1}.get(name, lambda: 0)()
    around = text[s - 1 : s] + text[e : e + 1]
    shape = -1 if any(c.isalnum() or c == "_" for c in around) else 1
    gazetteer = 0
    if name == "email":
        gazetteer = 1 if re.split(r"[.\x20)\]]", span)[-1].lower() in TLDS else -1
    elif name == "phone":
        gazetteer = 1 if (digits.startswith(CALLING_CODES) if span[0] == "+" else digits[0] not in "01" and digits[3] not in "01") else -1
    elif name == "card":
        gazetteer = 1 if digits[0] in "3456" else -1
    elif name == "ip":
        gazetteer = -1 if digits[0] == "0" else 1
    elif name == "name":
        gazetteer = 1 if any(w.lower() in FIRST_NAMES for w in span.split()[1:]) else 0
    return (checksum, shape, gazetteer, 1 if FOR.search(before) else 0, -1 if AGAINST.search(before) else 0, -1 if len(digits) >= 7 and len(set(digits)) <= 2 else 0)


def pattern(text: str, kind: int, s: int, e: int, fixed: bool) -> tuple[int, ...]:
    """kind, votes, then features of the span: length class, share of digits, found by a fixed pattern."""
    span = text[s:e]
    share = sum("0" <= c <= "9" for c in span) / len(span)
    return (kind, *votes(text, kind, s, e), min(4, (e - s) // 8), int(share * 3.999), int(fixed))


@dataclass
class Model:
    weights: np.ndarray
    reliabilities: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_design(patterns) @ self.weights))

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(fixed spans, added spans); added ones overlap no fixed one and no longer or earlier added one."""
        base = base_spans(text)
        loose = free_spans(text, base)
        if not loose:
            return base, []
        p = self.probability(np.array([pattern(text, *x, False) for x in loose]))
        added, taken = [], Taken()
        for q, x in sorted(zip(p.tolist(), loose), key=lambda y: (-y[0], y[1])):
            if q >= THRESHOLD and not taken.overlaps(x[1], x[2]):
                added.append(x)
                taken.add(x[1], x[2])
        return base, sorted(added)


def _design(patterns: np.ndarray) -> np.ndarray:
    n, v = len(patterns), len(LABELERS)
    kinds = np.eye(len(ALL_KINDS))[patterns[:, 0]]
    vote = patterns[:, 1 : 1 + v]
    rest = patterns[:, 1 + v :]
    return np.hstack([np.ones((n, 1)), kinds, vote > 0, vote < 0, np.eye(5)[rest[:, 0]], np.eye(4)[rest[:, 1]]]).astype(float)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, reliabilities[labeler, truth, vote + 1]) by expectation-maximisation.

    Labelers start, and are held by ``prior`` pseudo-votes, at being right four times in five when they vote.
    """
    vote = patterns[:, 1 : 1 + len(LABELERS)]
    belief = np.array([[0.2, 0.5, 0.3], [0.05, 0.4, 0.55]])  # truth no, yes: votes -1, 0, 1
    theta = np.repeat(belief[None], len(LABELERS), axis=0)
    share = np.full(len(ALL_KINDS), 0.5)
    for _ in range(rounds):
        like = np.stack([np.log(theta[j][:, vote[:, j] + 1]) for j in range(len(LABELERS))]).sum(axis=0)
        odds = like[1] - like[0] + np.log(share[patterns[:, 0]] / (1 - share[patterns[:, 0]]))
        post = 1 / (1 + np.exp(-odds))
        for j in range(len(LABELERS)):
            for truth, w in ((0, counts * (1 - post)), (1, counts * post)):
                got = np.array([w[vote[:, j] == x].sum() for x in (-1, 0, 1)]) + prior * belief[truth]
                theta[j, truth] = got / got.sum()
        for k in range(len(ALL_KINDS)):
            own = patterns[:, 0] == k
            share[k] = ((counts * post)[own].sum() + 5) / (counts[own].sum() + 10)
    return post, theta


def train(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Logistic weights from patterns with soft labels, each weighing as often as it was counted.

    Newton steps, halved while they don't lower the loss, so that large counts converge too.
    """
    x, c, total = _design(patterns), counts, counts.sum()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((c * (np.logaddexp(0, z) - post * z)).sum() + ridge * (w @ w) / 2) / total

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - post)) + ridge * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h / total, g / total)
        while np.abs(step).max() >= 1e-8 and loss(w - step) > now:
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w - step, loss(w - step)
    return w


#: One pattern of each kind with agreeing votes, so that every kind has something to learn from.
_ANCHORS = tuple((k, 1, 1, 1, 1, 0, 0, 1, 2, 0) for k in range(len(ALL_KINDS))) + tuple((k, -1, -1, -1, 0, -1, -1, 1, 2, 0) for k in range(len(ALL_KINDS)))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for value in batch["text"]:
            text = value.as_py().decode("utf-8", "replace")
            base = base_spans(text)
            seen.update(pattern(text, *x, True) for x in base)
            seen.update(pattern(text, *x, False) for x in free_spans(text, base))
    rows = sorted(seen.items())
    yield pa.RecordBatch.from_pydict({"pattern": pa.array([list(p) for p, _ in rows], pa.list_(pa.int32())), "n": pa.array([c for _, c in rows], pa.int64())})


def fit(docs: DataFrame) -> Model:
    """A model from the votes on all candidates of all documents (rows of distinct vote patterns reach the driver)."""
    rows = map_arrow(docs.select(text_bytes().alias("text")), _counted, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    found = sorted((tuple(r["pattern"]), r["n"]) for r in rows)
    patterns = np.array([p for p, _ in found] + list(_ANCHORS))
    counts = np.array([float(n) for _, n in found] + [3.0] * len(_ANCHORS))
    post, theta = estimate(patterns, counts)
    return Model(train(patterns, counts, post), theta)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _found(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        cols: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for value in batch["text"]:
            base, added = m.spans(value.as_py().decode("utf-8", "replace"))
            for i, k in enumerate(KINDS):
                cols[f"n_{k}"].append(sum(x[0] == i for x in base))
            cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols["spans"].append(_joined(base + added))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {c: pa.array(v, pa.int64() if c.startswith("n_") else pa.string()) for c, v in cols.items()})


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs`` (doc_id, text).

    A null or empty text has no spans. Repeated rows are scanned each; an empty table gives no
    rows. Offsets are code points of the whole text. Kinds sort as listed, those the method adds last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_arrow(src, lambda b: _found(b, shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return find(docs, fit(docs))
