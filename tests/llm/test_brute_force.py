"""The training-data operators' own methods against plain Python, and edge rows of every operator."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontam, neardup, packing, pii, quality, secrets, tokens, tokenstore, toxicity, urls, warc
from tests.llm.test_llm import DOCS, LONG, SF, brute_components, brute_scores, ids_of

# ---- rows that no operator may choke on: nulls, empty and very long texts, ties, repeats, clashing names

TEXTS = [None, "", " \n\t", "one", "tie tie tie", "tie tie tie", "É日本 ½ \x1c x", LONG, LONG, "end <|endoftext|> next", "mail a.b@c.de token = \"abcdef12\" +1 (743) 555-3824"]
CLASHES = ("_row", "_doc", "_text", "_id", "_mark", "_m", "_b", "_r", "_kept", "_metrics", "_base", "_rules", "_place", "_alike", "_hot", "_words", "_spans", "_items", "_s", "_n", "key", "mark", "bands", "kept", "score", "n_words", "x", "part", "fold")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", None)] * 2 + [(None, "null id", None, None, None)] * 2
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_every_operator_takes_odd_rows(spark, odd, none, tmp_path):
    n = odd.count()
    bench = spark.createDataFrame([(1, "tie tie"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    per_row = {
        "quality": lambda d: quality.quality(d), "near": lambda d: neardup.near_duplicates(d), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)), "pii": lambda d: pii.find(d, pii.fit(d)),
        "decontamination": lambda d: decontam.contamination(d, bench), "secrets": lambda d: secrets.find(d, secrets.fit(d)), "redact": lambda d: secrets.redact(d, secrets.fit(d)),
        "shards": lambda d: tokenstore.read_shards(tokenstore.write_shards(d, f"file://{tmp_path}/{random.random()}")),
    }
    for name, run in per_row.items():
        assert run(odd).count() == n and run(none).count() == 0, name
    ids = {}
    for name, keep in {"good": quality.keep_good, "first": neardup.keep_first_of_each, "clean": lambda d: decontam.keep_clean(d, bench)}.items():
        left = keep(odd)
        rows = left.collect()
        assert left.columns == odd.columns and keep(none).count() == 0 and all(r["_row"] == "clash" for r in rows), name
        ids[name] = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert ids["first"] == [0, 1, 2, 3, 4, 6, 7, 9, 10] and ids["good"] == [] and ids["clean"] == [0, 1, 2, 3, 6, 7, 8, 9, 10]
    kept = decontam.contamination(odd, bench).where("contaminated").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [4, 4, 4, 5]


def test_packing_and_shards_of_odd_rows_equal_the_library(odd, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    pieces = collections.Counter()
    for r in packing.pack(odd).collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    want = collections.Counter()
    for i, t in rows:
        n = len(ids_of(t, 1)) // 4
        want[i, n] += n
    assert pieces == want
    m = tokenstore.write_shards(odd, f"file://{tmp_path}/odd", shards=3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_shards(m).collect())
    assert got == sorted((i is None, i or 0, len(x) // 4, zlib.crc32(x)) for i, x in ((i, ids_of(t, 2)) for i, t in rows))


def test_encoder_takes_texts_over_a_group(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 64)
    e, r = tokens.Encoder(tokens.default_path(), most=300), random.Random(6)
    texts = [(" " if r.random() < 0.8 else "  ").join("".join(r.choices("ab'Z9.,\né日½", k=r.randint(0, 9))) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["x <|endoftext|> y " * 9]
    assert [t for t, got in zip(texts, e.encode_all(pa.array(texts, pa.string()))) if got + (1).to_bytes(4, "little") != ids_of(t, 1)] == []


def plain_place(lengths, capacity, last):
    """Every piece looks at every sequence."""
    cost = lambda n: n + n * n / 1024
    total = sum(lengths)
    n = -(-total // capacity) if last else total // capacity
    used, costs, rows = [0] * n, [0.0] * n, []
    todo = sorted((-x, d, 0) for d, x in enumerate(lengths) if x)
    while todo and any(u < capacity for u in used):
        size, d, start = todo.pop(0)
        size = -size
        fits = [s for s in range(n) if capacity - used[s] >= size] or [s for s in range(n) if used[s] < capacity]
        s = min(fits, key=lambda s: (costs[s], s))
        take = min(size, capacity - used[s])
        rows.append((d, start, take, s, used[s]))
        used[s] += take
        costs[s] += cost(take)
        if take < size:
            todo = sorted([*todo, (take - size, d, start + take)])
    return rows


def test_placement_is_that_of_looking_everywhere():
    r = random.Random(8)
    for _ in range(60):
        lengths, last = [r.randint(0, 100) for _ in range(r.randint(0, 120))], r.random() < 0.5
        assert packing.place(lengths, 100, last)[0] == plain_place(lengths, 100, last)


def test_warc_of_odd_rows(spark, tmp_path):
    pages = [(None, "u", "x" * 1500), (None, None, None), (1, "u", "x" * 1500), (1, "u", "x" * 1500), (2, "v\x00w", "x" * 1500), (3, "u", "É" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("is_page", "payload", "digest", "winner", "c"):
        df = df.withColumn(c, F.lit("clash"))
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.write_warc(df, f"file://{tmp_path}/w")).collect())
    assert got == {(None, "response", None): 2, (1, "revisit", 2): 2, (2, "response", None): 1, (3, "response", None): 1}


# ---- 2 urls


def test_url_verdicts_follow_scores_and_threshold(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "http://" + "a/" * 60_000), (10**6 + 2, "http://" + "a/" * 60_000), (10**6 + 3, "é://ü")], "page_id long, url string")
    rows = urls.judge_urls(pages.unionByName(odd).withColumn("_s", F.lit("clash")).withColumn("score", F.lit("clash"))).collect()
    assert len(rows) == pages.count() + 5
    action = {t: a for a, t in urls.RULES}
    text = {r["page_id"]: r["url"] for r in pages.unionByName(odd).collect()}
    scores = brute_scores([(text[r["page_id"]] or "", action.get(r["rule"])) for r in rows if text[r["page_id"]] and len(text[r["page_id"]]) < 10_000])
    fold = [(scores[text[r["page_id"]]], action[r["rule"]] == "allow") for r in rows if r["rule"] and zlib.crc32(text[r["page_id"]].encode()) % 4 == 0]
    good, bad = sum(ok for _, ok in fold), sum(not ok for _, ok in fold)
    for r in rows:
        if r["rule"]:
            assert r["verdict"] == action[r["rule"]]
    free = [(r["score"], r["verdict"]) for r in rows if not r["rule"]]
    allowed, blocked = [s for s, v in free if v == "allow"], [s for s, v in free if v == "block"]
    assert good and bad and (not allowed or not blocked or max(blocked) < min(allowed))
    parted = lambda cut: sum(ok for s, ok in fold if s >= cut) / good + sum(not ok for s, ok in fold if s < cut) / bad
    cuts = {math.floor(s / 0.01) * 0.01 for s, _ in fold}
    between = [c for c in cuts if (not blocked or max(blocked) < c) and (not allowed or c <= min(allowed))]
    assert max(map(parted, between)) >= max(map(parted, cuts)) - 1e-9  # the cut in use is one of the best


# ---- 4 near duplicates


def test_pages_with_a_common_frame_are_not_linked_and_edits_are(spark):
    r = random.Random(12)
    frame = [f"f{i}" for i in range(200)]
    texts = []
    for n in range(40):  # same frame, own ends of different lengths around the threshold
        texts.append(" ".join(frame + [f"own{n}x{j}" for j in range(r.randint(8, 40))]))
    for n in range(40):
        t = list(frame)
        for i in r.sample(range(200), r.randint(0, 5)):
            t[i] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(t[r.randint(0, 15) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_prefix_filter_loses_no_pair(spark):
    """All classes undecided and outside: every pair that can be linked must be among the candidates."""
    r = random.Random(13)
    base = list(range(60))
    sets = [sorted(set(base[: r.randint(40, 60)]) | {1000 + r.randrange(400) for _ in range(r.randint(0, 8))}) for _ in range(120)]
    rows = [(f"k{i:03d}".encode(), s) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "key binary, set array<long>")
    classes = table.select("key", F.size("set").cast("long").alias("n"), F.col("key").alias("component"), F.lit(True).alias("outside"))
    got = {frozenset((bytes(x["a"]), bytes(x["b"]))) for x in neardup._undecided_pairs(classes, table, 85).collect()}
    want = set()
    for (a, s), (b, t) in itertools.combinations(rows, 2):
        i = len(set(s) & set(t))
        if 100 * i >= 85 * (len(s) + len(t) - i):
            want.add(frozenset((a, b)))
    assert want <= got and len(want) > 50


# ---- 5 toxicity


def plain_tree(x, y, p, depth, least, ridge):
    """The best split of every node by trying every cut of every feature; leaves hold Newton steps."""
    g, h = p - y, p * (1 - p) + 1e-9

    def value(rows):
        return -g[rows].sum() / (h[rows].sum() + ridge)

    def grow(rows, left):
        if left == 0 or len(rows) < 2 * least:
            return value(rows)
        best = (1e-6, None, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) >= least:
                    gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[b].sum() ** 2 / (h[b].sum() + ridge) - total
                    if gain > best[0] + 1e-12:
                        best = (gain, f, cut)
        if best[1] is None:
            return value(rows)
        return (best[1], best[2], grow(rows[x[rows, best[1]] <= best[2]], left - 1), grow(rows[x[rows, best[1]] > best[2]], left - 1))

    def run(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        return tree

    tree = grow(np.arange(len(y)), depth)
    return np.array([run(tree, row) for row in x])


def test_boosting_equals_trying_every_cut():
    r = np.random.default_rng(7)
    x = r.integers(0, 12, (80, 3)).astype(float)  # few values, so bins are the values
    y = (x[:, 0] + r.normal(0, 3, 80) > 6).astype(float)
    start, rate, trees = toxicity.boost(x, y, rounds=6, depth=2, rate=0.3, least=3, ridge=1.0)
    out = np.full(80, start)
    for tree in trees:
        step = plain_tree(x, y, 1 / (1 + np.exp(-out)), 2, 3, 1.0)
        assert np.allclose(tree.predict(x), step)
        out += rate * step


def test_isotonic_is_the_best_rising_fit():
    r = np.random.default_rng(9)
    raw = np.sort(r.normal(size=60))
    y = (r.random(60) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    xs, ys = toxicity.isotonic(raw, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) > 0).all()
    # Min-max form of the same fit: max over starts of min over ends of means.
    want = np.array([max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])
    blocks = [i for i in range(60) if i == 0 or want[i] != want[i - 1]] + [60]
    means = [raw[a:b].mean() for a, b in zip(blocks, blocks[1:])]
    fitted = [(y[a:b].sum() + 0.02) / (b - a + 0.04) for a, b in zip(blocks, blocks[1:])]
    assert np.allclose(xs[1:-1], means) and np.allclose(ys[1:-1], np.maximum.accumulate(fitted), atol=1e-9)


def test_lexicon_of_a_fold_leaves_it_out(spark):
    rows = [(b"=bad", *[3, 1, 0, 0], *[0, 0, 0, 0]), (b"=both", *[2, 2, 2, 2], *[2, 2, 0, 0]), (b"=rare", *[1, 1, 0, 0], *[0, 0, 0, 0]), (b"bad", *[3, 1, 0, 0], *[1, 0, 0, 0])]
    counted = spark.createDataFrame(rows, "term binary, " + ", ".join(f"t{f} long" for f in range(4)) + ", " + ", ".join(f"c{f} long" for f in range(4)))
    sizes = {(f, label): 5 for f in range(4) for label in (0, 1)}
    got = toxicity.lexica_of(counted, sizes, 10)
    assert set(got[-1].words) == {b"bad", b"both"} and set(got[-1].stems) == {b"bad"}
    assert set(got[0].words) == {b"both"} and set(got[1].words) == {b"bad", b"both"} and set(got[2].words) == {b"bad"}  # 6 >= 2 * 4 fails
    assert got[-1].words[b"bad"] == pytest.approx(math.log(4.2 / 0.2))
    assert set(toxicity.lexica_of(counted, sizes, 1)[-1].words) == {b"bad"}


def test_toxicity_reads_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(i, f"you idiot number {i}" if i % 2 else f"a calm note number {i}") for i in range(60)] + [(1, "zz other")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("text != 'zz other'"), model).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))


# ---- 6 personal data


def plain_em(patterns, counts, rounds, prior):
    belief = {0: {-1: 0.2, 0: 0.5, 1: 0.3}, 1: {-1: 0.05, 0: 0.4, 1: 0.55}}
    v, kinds = len(pii.LABELERS), range(len(pii.ALL_KINDS))
    theta = [{t: dict(belief[t]) for t in (0, 1)} for _ in range(v)]
    share = dict.fromkeys(kinds, 0.5)
    for _ in range(rounds):
        post = []
        for p in patterns:
            like = {t: math.prod(theta[j][t][p[1 + j]] for j in range(v)) for t in (0, 1)}
            yes, no = share[p[0]] * like[1], (1 - share[p[0]]) * like[0]
            post.append(yes / (yes + no))
        for j in range(v):
            for t in (0, 1):
                mass = {x: prior * belief[t][x] for x in (-1, 0, 1)}
                for p, c, q in zip(patterns, counts, post):
                    mass[p[1 + j]] += c * (q if t else 1 - q)
                theta[j][t] = {x: m / sum(mass.values()) for x, m in mass.items()}
        for k in kinds:
            own = [(c, q) for p, c, q in zip(patterns, counts, post) if p[0] == k]
            share[k] = (sum(c * q for c, q in own) + 5) / (sum(c for c, _ in own) + 10)
    return post


def test_em_and_classifier_against_plain_python():
    r = random.Random(15)
    patterns = sorted({(r.randrange(7), *[r.choice((-1, 0, 1)) for _ in range(6)], r.randrange(5), r.randrange(4), 0) for _ in range(40)})
    counts = [float(r.randint(1, 300)) for _ in patterns]
    post, theta = pii.estimate(np.array(patterns), np.array(counts), rounds=12)
    assert np.allclose(post, plain_em(patterns, counts, 12, 20.0), atol=1e-9) and np.allclose(theta.sum(axis=2), 1)
    w = pii.train(np.array(patterns), np.array(counts), post)
    x = pii._design(np.array(patterns))

    def loss(w):
        z = x @ w
        return float((np.array(counts) * (np.logaddexp(0, z) - post * z)).sum() + (w @ w) / 2)

    bump = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + 0.01 * bump.normal(size=len(w))) for _ in range(200))  # convex: no nearby point is better


def test_method_decides_over_loose_candidates(spark):
    """Texts in which only the classifier's verdict tells candidates apart."""
    good = ["phone: (212) 555-0187", "tel 415-555-0134 please", "iban DE89 3704 0044 0532 0130 00", "write to jane.roe [at] mail [dot] com"]
    bad = ["order no 000-00-0000", "version 111-111-1111", "ticket 000-00-0000", "part DE00 0000 0000 0000 0000 00"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate((good + bad) * 30)], "doc_id long, text string")
    model = pii.fit(docs)
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs, model).collect()}
    assert [bool(rows[i]) for i in range(8)] == [True] * 4 + [False] * 4
    for t in good + bad:  # the verdict is the classifier's probability of the span's own pattern
        for span in pii.loose_spans(t):
            p = model.probability(np.array([pii.pattern(t, *span, False)]))[0]
            assert (p >= pii.THRESHOLD) == (t in good)


def test_overlaps_by_sorted_spans_equal_all_against_all():
    r = random.Random(16)
    for _ in range(300):
        base = [(0, s, s + r.randint(1, 9)) for s in (r.randrange(80) for _ in range(r.randint(0, 12)))]
        taken = pii.Taken(base)
        for s in range(0, 80, 3):
            e = s + r.randint(1, 12)
            assert taken.overlaps(s, e) == any(s < b and a < e for _, a, b in base)
    added = pii.Taken()
    spans = []
    for _ in range(300):
        s = r.randrange(2000)
        e = s + r.randint(1, 15)
        free = not any(s < b and a < e for a, b in spans)
        assert added.overlaps(s, e) != free
        if free:
            added.add(s, e)
            spans.append((s, e))


# ---- 7 decontamination


def test_long_items_and_many_blocks(spark):
    r = random.Random(17)
    words = [f"w{i}" for i in range(40)]
    items = [(str(i), " ".join(r.choices(words, k=r.choice((0, 3, 13, 14, 900))))) for i in range(12)] + [("twin", " ".join(words)), ("twin2", " ".join(words))]
    texts = []
    for i in range(30):
        w = r.choices(words, k=r.randint(0, 80))
        if i % 3 == 0:
            own = r.choice(items)[1].split()
            at = r.randint(0, max(0, len(own) - 20))
            w[len(w) // 2 : len(w) // 2] = own[at : at + 20]
        texts.append(" ".join(w))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in decontam.contamination(docs, bench).collect()}
    parts = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in decontam.contamination(docs, bench, table_bytes=100 * decontam.WORD_BYTES).collect()}
    want = {}
    for i, t in enumerate(texts):
        w, hit, who = t.split(), set(), set()
        for name, raw in items:
            p = raw.split()
            for a in range(max(1, len(p) - 12)) if p else ():
                q = p[a : a + 13]
                for j in range(len(w) - len(q) + 1):
                    if w[j : j + len(q)] == q:
                        hit.update(range(j, j + len(q)))
                        who.add(name)
        want[i] = (len(w), len(hit), sorted(who))
    assert whole == parts == want


# ---- 10 secrets

PLAIN = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
)


def test_base_secrets_equal_plain_regexes():
    r = random.Random(18)
    parts = ["password", "Token", "api_key", "apikey", "secret", "AKIA", " ", "=", ":", '"', "'", "abc123", "ABCDEFGHIJ", "0123456789abcdef", "f", "G", "é", "\n", "-", "x/y+z="]
    for _ in range(20_000):
        t = "".join(r.choices(parts, k=r.randint(1, 12)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in p.finditer(t) if ok(m))
        assert secrets.base_spans(t, t.encode()) == want, t


def test_statistics_and_p_values():
    token = "0a1b2c3d4e5f60718293a4b5"
    enc, n, chi2, changes, corr = secrets.statistics(token)
    counts = collections.Counter(token)
    assert secrets.ENCODINGS[enc][0] == "hex" and n == len(token) and chi2 == pytest.approx(sum((counts[c] - n / 16) ** 2 / (n / 16) for c in "0123456789abcdef"))
    assert changes == sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    x = ["0123456789abcdef".index(c) for c in token]
    assert corr == pytest.approx(np.corrcoef(x[:-1], x[1:])[0, 1])
    pairs = np.zeros((128, 128), np.int64)
    text = "the quick brown fox jumps over the lazy dog and runs away from the hunters " * 40
    for a, b in zip(text, text[1:]):
        pairs[ord(a), ord(b)] += 1
    null = secrets.Null.of(pairs)
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    k = 16.0
    mean, sd = k * (1 - null.p2[enc]) + n * k * null.p2[enc] - n, k * math.sqrt(max(4 * n * (null.p3[enc] - null.p2[enc] ** 2), 0) + 2 * null.p2[enc]) + 1e-9
    m = (n - 1) * null.change
    ps = [phi((chi2 - mean) / sd), phi((m - changes + 0.5) / math.sqrt(m * (1 - null.change))), phi((abs(corr) - abs(null.correlation[enc])) * math.sqrt(n))]
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    want = math.exp(-half) * (1 + half + half * half / 2)
    got = null.p_value(*(np.array([v]) for v in (enc, n, chi2, changes, corr)))[0]
    assert got == pytest.approx(want)
    plain = secrets.statistics("thequickbrownfoxjumpsoverthe")
    assert null.p_value(*(np.array([v]) for v in plain))[0] > 100 * got


def test_false_discovery_cut_is_benjamini_hochberg():
    r = random.Random(19)
    for _ in range(200):
        # p-values at the upper edges of their bins, as the histogram sees them
        bins = [r.choice((0, 1, 2, 5, 20, 35, 60)) for _ in range(r.randint(1, 60))]
        hist = collections.Counter((0, b) for b in bins)
        cut = secrets.cut_off(dict(hist), 0.01)[0]
        p = sorted(10 ** (-b / 10) for b in bins)
        passed = [i for i in range(len(p)) if p[i] <= 0.01 * (i + 1) / len(p)]
        want = p[passed[-1]] if passed else -1.0
        assert cut == pytest.approx(want)


def test_method_finds_secrets_that_no_pattern_names(spark):
    r = random.Random(20)
    words = ["weather", "harbour", "quietly", "mountain", "reading", "letters", "because", "another"]
    rows = [(i, " ".join(r.choices(words, k=40)) + " " + "".join(r.choices(words, k=4))) for i in range(300)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hidden = {1000 + i: "".join(r.choices(alphabet, k=32 + i % 20)) for i in range(20)}
    docs = spark.createDataFrame(rows + [(k, f"see {v} here") for k, v in hidden.items()], "doc_id long, text string")
    model = secrets.fit(docs)
    got = {x["doc_id"]: (x["spans"], x["base_sha256"]) for x in secrets.find(docs, model).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[k] == (f"random:4:{4 + len(v)}", empty) for k, v in hidden.items()) and all(got[i][0] == "" for i, _ in rows)
    red = {x["doc_id"]: x["text"] for x in secrets.redact(docs, model).collect()}
    assert all(red[k] == "see [SECRET] here" for k in hidden) and all(red[i] == t for i, t in rows)
