"""Queries and operators that SQL doesn't check: plain Python on the same rows, and hand tables."""

import collections
import html
import itertools
import json
import random
import re
import unicodedata
from datetime import datetime, timezone

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomline import registries
from loomline.functions import text as T
from loomline.operators import evaluation as H, evidence as V, extract as X, graph as G, intake as I, knowledge as K, opportunity as O, reasoning as R, report as P, trend as N, vectors as W
from loomline.plans import graph as plan_graph, registry
from loomline.sources import collectors as C, connectors, readers, sinks
from loomline.streaming.jobs import next_run

registry.load_all()
SF = "/root/testdata/sf0.001"


def rows_of(name, *cols):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(cols))
    return list(zip(*(t[c].to_pylist() for c in cols)))


def run(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


# ---- registered queries without SQL


def test_capitalised_names(spark):
    want = {(i, n) for i, t in rows_of("documents", "doc_id", "text") for n in re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", t or "", re.ASCII)}
    assert {r[:2] for r in run(spark, "capitalised_names")} == want


def test_html_unescape_nfc(spark):
    want = {i: re.sub(r"[ \t\n\x0b\f\r]+", " ", unicodedata.normalize("NFC", html.unescape(re.sub(r"<[^>]+>", " ", h or "")))).strip(" ") for i, h in rows_of("pages", "page_id", "html")}
    assert dict(run(spark, "html_unescape_nfc")) == want


def test_language_agreement(spark):
    common = {"en": "the of and to is that", "de": "der die und das ist nicht", "fr": "le les des est que pour", "es": "el los que las por una"}
    want = collections.Counter()
    for lang, t in rows_of("documents", "lang", "text"):
        head = (t or "")[:500]
        counts = {k: sum(w in v.split() for w in re.split(r"\s+", head.lower(), flags=re.ASCII)) for k, v in common.items()}
        best = min(counts, key=lambda k: (-counts[k], k))
        want[lang, best if len(head) >= 20 and counts[best] else None] += 1
    assert {(a, b): n for a, b, n in run(spark, "language_agreement")} == dict(want)


def test_samples(spark):
    langs = dict(rows_of("documents", "doc_id", "lang"))
    strata = collections.Counter(langs.values())
    got = run(spark, "stratified_sample")
    assert collections.Counter(x for _, x in got) == {k: min(n, 40 // len(strata)) for k, n in strata.items()} and got and all(langs[i] == x for i, x in got)
    assert len(set(run(spark, "simple_sample"))) == 25 and sorted(run(spark, "simple_sample")) == sorted(run(spark, "simple_sample"))


def edges_of(spark):
    return [(r["src"], r["dst"], r["weight"]) for r in plan_graph.edges_of(spark, SF).collect()]


def components(nodes, pairs):
    label = {n: n for n in nodes}
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = {n: x if v == y else v for n, v in label.items()} if x != y else label
    return label


def linkage(pairs, threshold):
    """Average linkage by looking at every pair of groups at every step."""
    sim = {frozenset((a, b)): w for a, b, w in pairs}
    groups = [[n] for n in sorted({x for a, b, _ in pairs for x in (a, b)})]
    while len(groups) > 1:
        best = None
        for x, y in itertools.combinations(range(len(groups)), 2):
            average = round(sum(sim.get(frozenset((a, b)), 0.0) for a in groups[x] for b in groups[y]) / (len(groups[x]) * len(groups[y])), 12)
            key = (-average, min(groups[x]), min(groups[y]))
            best = min(best, (key, x, y)) if best else (key, x, y)
        if -best[0][0] < threshold or best[0][0] == 0:
            break
        groups[best[1]] += groups.pop(best[2])
        groups.sort(key=min)
    return {n: min(g) for g in groups for n in g}


def merge_small(cluster, pairs, small, most):
    size = collections.Counter(cluster.values())
    links = collections.defaultdict(float)
    for a, b, w in pairs:
        if a in cluster and b in cluster and cluster[a] != cluster[b]:
            for x, y in ((cluster[a], cluster[b]), (cluster[b], cluster[a])):
                if size[x] < small <= size[y] and size[x] + size[y] <= most:
                    links[x, y] += w
    into = {}
    for x in {x for x, _ in links}:
        into[x] = min((-links[x, y] / (size[x] * size[y]), y) for a, y in links if a == x and links[x, y] > 0)[1]
    return {n: into.get(c, c) for n, c in cluster.items()}


def test_clusters_against_plain_python(spark):
    edges = edges_of(spark)
    strong = [e for e in edges if e[2] >= 0.4]
    label = components({n for a, b, _ in strong for n in (a, b)}, [(a, b) for a, b, _ in strong])
    size = collections.Counter(label.values())
    by = collections.defaultdict(list)
    for a, b, w in strong:
        if 2 <= size[label[a]] <= 500:
            by[label[a]].append((a, b, w))
    want = {n: c for part in by.values() for n, c in linkage(part, 0.25).items()}
    assert dict(run(spark, "average_linkage_clusters")) == want and len(set(want.values())) < len(want)
    assert dict(run(spark, "merged_small_clusters")) == merge_small(want, strong, 4, 500)
    kept = {n: c for n, c in label.items() if 1 < size[c] <= 500}
    merged = merge_small(kept, edges, 3, 500)
    left = collections.Counter(merged.values())
    assert dict(run(spark, "post_processed_clusters")) == {n: c for n, c in merged.items() if left[c] >= 3}
    weight, degree = collections.Counter(), collections.Counter()
    for a, b, w in strong:
        for n in (a, b):
            weight[n] += w
            degree[n] += 1
    best = {}
    for n, c in label.items():
        if 3 <= size[c] <= 500:
            best[c] = min(best.get(c, (0, 0, n)), (-round(weight[n], 9), -round(weight[n] / degree[n], 9), n))
    assert dict(run(spark, "cluster_representatives")) == {c: x[2] for c, x in best.items()}


def test_betweenness_and_depth_first(spark):
    pairs = sorted({(r["src"], r["dst"]) for r in plan_graph.graph(spark, SF).collect()})
    after = collections.defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
    nodes = {n for p in pairs for n in p}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:  # all shortest paths, counted through every middle node
        far, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in after[v]:
                if w not in far:
                    far[w], ways[w] = far[v] + 1, 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
        for t in order[1:]:
            through = {t: 1}
            for v in reversed(order):
                if v != t and far[v] < far[t]:
                    through[v] = sum(through.get(w, 0) for w in after[v] if far.get(w) == far[v] + 1 and far[w] <= far[t])
            for v in order[1:]:
                if v != t and far[v] < far[t]:
                    score[v] += ways[v] * through[v] / ways[t]
    n = len(nodes)
    got = dict(run(spark, "betweenness"))
    assert set(got) == nodes and all(got[v] == pytest.approx(score[v] / ((n - 1) * (n - 2)), abs=1e-9) for v in nodes)
    small = collections.defaultdict(list)
    for a, b in pairs:
        if a < 400 and b < 400:
            small[a].append(b)
    seen, order = set(), []

    def visit(v):
        if v not in seen:
            seen.add(v)
            order.append(v)
            for w in sorted(small[v]):
                visit(w)

    visit(1)
    assert [v for _, v in sorted(run(spark, "depth_first_order"))] == order


def greedy(rows, overlap):
    kept = []
    for score, key, items in sorted(rows, key=lambda r: (-r[0], r[1])):
        s = set(items)
        if not s or not any(k and len(s & k) >= overlap * len(s | k) for _, k in kept):
            kept.append((key, s))
    return {k for k, _ in kept}


def test_suppress_duplicates_is_greedy(spark):
    r = random.Random(3)
    for overlap in (0.5, 0.85):
        rows = [(float(r.randint(0, 30)), i, r.sample("abcdefghij", r.randint(0, 9))) for i in range(150)]
        df = spark.createDataFrame(rows, "score double, key long, evidence array<string>")
        assert {x["key"] for x in O.suppress_duplicates(df, "score", overlap=overlap).collect()} == greedy(rows, overlap)
    orders = collections.defaultdict(lambda: [0.0, set()])
    for c, p, s, total in rows_of("orders", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"):
        orders[c][0] += 2 * total
        orders[c][1] |= {p, s}
    kept = greedy([(v[0], k, v[1]) for k, v in orders.items()], 0.85)
    got = sorted(run(spark, "opportunity_dedup"))
    assert {k for _, k, _, _ in got} <= kept and len(got) == min(100, len(kept)) and [x[0] for x in got] == list(range(1, len(got) + 1)) and {x[2] for x in got} == {"ranked"}


def test_hashed_embeddings(spark):
    texts = {str(i): t for i, t in rows_of("documents", "doc_id", "text") if i % 10}
    got = {r["id"]: r for r in registry.QUERIES["hashed_embeddings"](spark, SF).collect()}
    assert set(got) == set(texts) and all((r["error"] == "blank") == (not (texts[i] or "").strip()) == (r["embedding"] is None) for i, r in got.items())
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1) for r in got.values() if r["embedding"])


def test_every_query_without_oracle_is_tested_here():
    tested = "capitalised_names html_unescape_nfc language_agreement stratified_sample simple_sample cluster_representatives average_linkage_clusters merged_small_clusters post_processed_clusters betweenness depth_first_order opportunity_dedup hashed_embeddings"
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(tested.split())


# ---- operators on hand tables


def test_rare_texts_are_cleaned_like_the_others(spark):
    texts = ["a &eacute; b", "étude", "plain <b>x</b>", "&amp;lt; &#65;", None, "", "café &nbsp; x"]
    got = {r["doc_id"]: r["clean_text"] for r in I.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "a é b", 1: "étude", 2: "plain x", 3: "&lt; A", 4: None, 5: "", 6: "café x"}


def test_validate_flags_every_repeat_of_blank_ids(spark):
    when = datetime(2020, 1, 1)
    raw = spark.createDataFrame([(i, v, "x", "s", "t", "c", when, when) for i, v in enumerate(["a", "", "", None, "a", "b"])], "ordinal long, id string, external_id string, source string, title string, content string, created timestamp, updated timestamp")
    got = {r["ordinal"]: r["reasons"] for r in I.validate(raw).collect()}
    assert got == {0: [], 1: ["missing_id"], 2: ["missing_id", "duplicate_id"], 3: ["missing_id", "duplicate_id"], 4: ["duplicate_id"], 5: []}


def test_distribution_quantiles(spark):
    r = random.Random(1)
    values = [float(r.randint(0, 40)) for _ in range(501)]
    d = I.distribution(spark.createDataFrame([(v,) for v in values], "v double").repartition(5), "v").first()
    v, n = sorted(values), len(values)
    assert (d["median"], d["p25"], d["p75"], d["min"], d["max"], d["n"]) == (v[n // 2], v[int(0.25 * (n - 1))], v[int(0.75 * (n - 1))], v[0], v[-1], n)


def test_evidence_members_with_salts(spark):
    r = random.Random(2)
    rows = [(f"{r.randrange(10**9):09d}", "cat", None, f"v{i % 2}", None, "x" * r.randint(1, 40) + str(i)) for i in range(400)]
    obs = spark.createDataFrame(rows, "observation_id string, category string, canonical_value string, value string, entity string, text_snippet string")
    got = {x["signal_key"]: x for x in V.evidence_members(obs, 7, 3, 4).collect()}
    for k in ("v0", "v1"):
        own = [x for x in rows if x[3] == k]
        assert got[f"cat:{k}"]["observation_ids"] == sorted(x[0] for x in own)[:7]
        assert got[f"cat:{k}"]["top_snippets"] == [x[5] for x in sorted(own, key=lambda x: (-len(x[5]), x[5], x[0]))[:3]]


def test_enrich_order_of_resolution(spark):
    rows = [("late", "delivery_delay", None), ("refund please", None, None), ("slow app", None, None), ("bad", None, None), ("odd", "new_label", None), ("Amazon", None, "Amazon"), ("too bad", "poor_quality", None)]
    got = {r["value"]: (r["category"], r["canonical_value"], r["canonical_source"]) for r in X.enrich(spark.createDataFrame(rows, "value string, label string, entity string")).collect()}
    assert got["late"] == ("Delivery", "Late Delivery", "pattern") and got["refund please"] == ("Pricing", "pricing", "problem_signals") and got["slow app"] == ("Performance", "performance", "problem_signals")
    assert got["bad"][1:] == (None, None) and got["odd"] == (None, "New Label", "pattern_label") and got["Amazon"] == (None, None, None) and got["too bad"] == ("Quality", "Poor Quality", "pattern")


def test_rake_takes_phrases_of_any_length(spark):
    text = "alpha beta gamma delta epsilon zeta and alpha beta"
    got = {r["phrase"]: (r["n"], r["score"]) for r in X.rake(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    # alpha and beta: degree 6 + 2, frequency 2; the others 6 / 1
    assert got == {"alpha beta gamma delta epsilon zeta": (1, 32.0), "alpha beta": (1, 8.0)}


def test_correlate_against_all_pairs(spark):
    r = random.Random(5)
    items = {i: r.sample("abcdefgh", r.randint(0, 8)) for i in range(60)}
    got = {(x["first"], x["second"]): x["shared"] for x in N.correlate(spark.createDataFrame(list(items.items()), "k long, ps array<string>"), "k", "ps").collect()}
    want = {}
    for a, b in itertools.combinations(items, 2):
        n = len(set(items[a]) & set(items[b]))
        if n >= 2 and n >= 0.5 * min(len(items[a]), len(items[b])):
            want[a, b] = n
    assert got == want


def test_top_k_in_blocks(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(90, 8))
    v[5] = v[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, []), (501, None)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for x in W.top_k(df, df.where("vec_id % 3 = 0"), 4, block=20).collect():
        got[x["query_id"]].append((-round(x["score"], 9), x["target_id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == set(range(0, 90, 3))
    for q, found in got.items():
        assert [t for _, t in sorted(found)] == [t for _, t in sorted((-round(float(u[q] @ u[t]), 9), t) for t in range(90))[:4]]


def test_neighbourhood_of_a_hub_is_capped(spark):
    pairs = [("h", f"n{i:03d}") for i in range(300)] + [("n000", "far"), ("p", "h")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    got = [(r["node"], r["depth"]) for r in O.neighbourhoods(edges, spark.createDataFrame([("h",), ("far",)], "problem string"), 10).where("problem = 'h'").collect()]
    assert sorted(got, key=lambda x: (x[1], x[0])) == [("h", 0), *[(f"n{i:03d}", 1) for i in range(9)]]


def test_graph_that_needs_more_rounds_is_refused(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    with pytest.raises(RuntimeError):
        G.topological_levels(chain, 3)
    with pytest.raises(RuntimeError):
        G.strongly_connected(chain, 1)
    assert not G.has_cycle(chain) and G.has_cycle(chain.union(spark.createDataFrame([(6, 0)], "src long, dst long")))
    with pytest.raises(NotImplementedError):
        G.communities("louvain", chain)


def tiny(spark):
    obs = spark.createDataFrame([("o1", "slow", 0.9), ("o2", "late", 0.8)], "observation_id string, text string, confidence double")
    ev = spark.createDataFrame([("e1", "slow app", 0.7), ("e2", "late parcel", 0.6)], "evidence_id string, text string, confidence double")
    sig = spark.createDataFrame([("s1", "Performance", ["e1"], 0.8), ("s2", "Delivery", ["e2", "e9"], 0.4)], "signal_id string, label string, evidence_ids array<string>, confidence double")
    cl = spark.createDataFrame([("c1", "o1", ["o1", "o2"], 0.9)], "cluster_id string, representative_id string, member_ids array<string>, quality_score double")
    rel = spark.createDataFrame([("o1", "o2", 0.95), ("o1", "zz", 0.9)], "source_id string, target_id string, similarity_score double")
    return {"observation": obs, "evidence": ev, "problem_signal": sig, "cluster": cl}, rel


def test_graph_is_built_from_assets(spark):
    nodes, edges = K.build(*tiny(spark))
    kinds = collections.Counter(r["node_type"] for r in nodes.collect())
    assert kinds == {"observation": 2, "evidence": 2, "problem_signal": 2, "cluster": 1}
    assert sorted(r["type"] for r in edges.collect()) == ["belongs_to", "causes", "member_of_cluster", "similar_to"]  # the weak signal's edge is dropped
    found = {r["code"]: r["n"] for r in K.issues(nodes, edges).collect()}
    assert found["components"] == 4 and found["orphan_nodes"] == 2 and found["orphan_edges"] == found["duplicate_nodes"] == found["cycles"] == 0
    broken = edges.unionByName(edges.limit(1)).unionByName(edges.limit(1).withColumns({"edge_id": F.lit("x"), "src": F.lit("gone"), "dst": F.lit("gone"), "weight": F.lit(2.0), "type": F.lit("odd")}))
    found = {r["code"]: r["n"] for r in K.issues(nodes, broken).collect()}
    assert (found["duplicate_edges"], found["orphan_edges"], found["self_loops"], found["invalid_weight"], found["unknown_types"]) == (1, 1, 1, 1, 1)
    assert K.by_label(nodes, "PARCEL").count() == 1 and K.by_property(nodes, "representative_id", "o1").count() == 1 and K.by_filters(nodes, "cluster", absent="x").count() == 1
    n, e = K.remove_nodes(nodes, edges, nodes.where("node_type = 'cluster'"))
    assert n.count() == 6 and e.count() == 2 and K.upsert_nodes(nodes, nodes.limit(2)).count() == 7


def test_rules_and_their_cache(spark, tmp_path):
    nodes, edges = K.build(*tiny(spark))
    got = R.infer(nodes, edges).collect()
    assert [(r["rule"], r["confidence"]) for r in got] == [("causal_chain", 0.56)]
    assert R.resolve(("causal_chain",)) == ["causal_chain", "transitive_closure"]
    first = R.cached(nodes, edges, f"file://{tmp_path}/cache")
    assert first.count() == 1 and R.cached(nodes, edges, f"file://{tmp_path}/cache").count() == 1
    assert R.graph_hash(nodes, edges) != R.graph_hash(nodes, edges.limit(1))
    by = {how: {r["effect"]: r["score"] for r in R.causes(nodes, edges, how).collect()} for how in ("confidence", "depth", "transitive_impact")}
    ids = {r["source_id"]: r["node_id"] for r in nodes.collect()}
    assert by["confidence"] == {ids["s1"]: 0.56, ids["s2"]: 0.0} and by["depth"][ids["s1"]] == 1.0 and by["transitive_impact"][ids["s1"]] == 0.28


def test_cluster_validator(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "src long, dst long, weight double")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (9, "b")], "node long, cluster string")
    reps = spark.createDataFrame([("a", 9)], "cluster string, representative long")
    got = sorted((r["code"], r["cluster"], r["node"]) for r in G.cluster_issues(members, edges, reps).collect())
    assert got == [("DISCONNECTED_CLUSTER", "b", None), ("DUPLICATE_MEMBERS", "a", None), ("MIN_SIZE_VIOLATION", "b", None), ("MISSING_REPRESENTATIVE", "b", None), ("ORPHAN_MEMBER_ID", "b", "9"), ("OVERLAPPING_MEMBER", "b", "3"), ("REPRESENTATIVE_NOT_IN_CLUSTER", "a", "9")]


def test_stage_penalties(spark):
    edges = spark.createDataFrame([(0.5, 0.4)] * 11, "similarity double, confidence double")
    comp = spark.createDataFrame([(i, i // 2) for i in range(20)], "node long, component long")
    assert H.relationship_health(edges, comp, 100).first()["score"] == 100 - 20 - 10 - 10
    clusters = spark.createDataFrame([(1, 0.1), (1, 0.2), (5, 0.9)], "size long, quality double")
    assert H.cluster_health(clusters).first()["score"] == 100 - 30 - 20
    none = spark.createDataFrame([], "rule string, confidence double")
    assert H.reasoning_health(none, 0, 0).first()["score"] == 40 and H.cluster_health(clusters.limit(0)).first()["score"] == 0
    some = spark.createDataFrame([("r", 0.2)] * 3, "rule string, confidence double")
    assert H.reasoning_health(some, 0, 2).first()["score"] == 100 - 20 - 15 - 10


def test_integrity_and_snapshots(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    sinks.write_asset(df, base, "good", "r1")
    sinks.write_asset(df, base, "stale", "r0")
    sinks.write_asset(df, base, "changed", "r1")
    sinks.append_asset(df.limit(1), base, "changed")
    got = {(r["asset"], r["check"]): r["status"] for r in H.integrity(spark, base, "r1", {"good": ["id"], "stale": ["id", "x"], "changed": [], "none": []}).collect()}
    assert got[("good", "checksum")] == "PASS" and got[("stale", "run_id")] == "WARN" and got[("stale", "schema")] == "FAIL" and got[("changed", "checksum")] == "FAIL" and got[("none", "exists")] == "FAIL"
    index = sinks.snapshot_run(spark, base, ["good", "none"], f"{base}/snap", "s1")
    sinks.snapshot_run(spark, base, ["good"], f"{base}/snap", "s2")
    assert [(r["asset"], r["rows"]) for r in index.collect()] == [("good", 2)] and [r["snapshot_id"] for r in sinks.scan_snapshots(spark, f"{base}/snap").collect()] == ["s1", "s2"]
    assert sinks.read_snapshot(spark, f"{base}/snap", "good", "s1").count() == 2
    sinks.append_raw(df.withColumn("source", F.lit("web")), f"{base}/raw")
    day = spark.sql("select cast(current_date() as string)").first()[0]
    assert sinks.read_raw(spark, f"{base}/raw", "web", day).count() == 2 and sinks.read_raw(spark, f"{base}/nothing", "web", day).count() == 0
    sinks.write_normalised(df.withColumn("title", F.col("t")), f"{base}/norm")
    assert tuple(spark.read.parquet(f"{base}/norm").columns) == sinks.NORMALISED
    with pytest.raises(ValueError):
        sinks.render("T", [("S", df)], "json", rows=1)


def test_reports(spark, tmp_path):
    base = f"file://{tmp_path}"
    opp = spark.createDataFrame([("a", 0.8), ("b", 0.55), ("c", 0.2)], "key string, opportunity_score double")
    sinks.write_asset(opp, base, "opportunities", "r1")
    sinks.write_asset(spark.createDataFrame([("t", "growing", 0.7)], "subject string, trend_type string, trend_score double"), base, "trends", "r1")
    found = P.collect(spark, base)
    one = P.build("executive_summary", found, now=datetime(2024, 1, 1, tzinfo=timezone.utc), lists={"companies": ["Acme"], "tags": ["q1"]})
    assert [s["type"] for s in one["sections"]] == ["executive_summary", "top_findings", "trend_analysis", "opportunity_analysis", "confidence", "recommendations", "appendix"]
    assert one["sections"][5]["content"]["recommendations"] == ["Pursue 1 high-value opportunities identified", "Explore 1 promising opportunities further", "Monitor 1 growing trends for strategic alignment"]
    two = P.build("market", found | {"opportunities": found["opportunities"] | {"top": [{"title": "d", "score": 0.9}]}}, now=datetime(2024, 2, 1, tzinfo=timezone.utc), lists={"companies": ["Bolt"]})
    for r in (one, two):
        P.store(spark, r, f"{base}/reports")
    kept = P.load(spark, f"{base}/reports")
    titles = lambda **k: [r["title"] for r in P.search(kept, **k).collect()]
    assert titles() == ["Market", "Executive Summary"] and titles(company="ACME") == ["Executive Summary"] and titles(since="2024-01-15") == ["Market"] and titles(query="q1") == ["Executive Summary"]
    diff = P.compare(kept, one["report_id"], two["report_id"]).first()
    assert diff["new_opportunities"] == ["d"] and diff["removed_opportunities"] == ["a", "b", "c"] and diff["new_companies"] == ["Bolt"]
    with pytest.raises(ValueError):
        P.build("nothing", found)
    assert P.CHARTS["pie"](opp, "key", "opportunity_score")["slices"][0]["share"] == round(0.8 / 1.55, 4) and P.CHARTS["bar"](opp, "key", "opportunity_score")["labels"] == ["a", "b", "c"]
    links = spark.createDataFrame([("x", "y", 2)], "s string, t string, n int")
    assert P.CHARTS["sankey"](links, "s", "t", "n")["links"] == [{"source": 0, "target": 1, "value": 2}] and P.CHARTS["heatmap"](links, "s", "t", "n")["z"] == [[2]]
    assert P.export_stage("opp", {"all": opp}, base)["tables"]["all"]["rows"] == 3


def test_collectors_follow_their_pages(spark, tmp_path):
    r = C.Response
    page = lambda *ids, **k: r(200, [{"id": i} for i in ids], k)
    client = C.Replay({"issues/a&page=1": page(1, 2, Link='<x>; rel="next"'), "issues/a&page=2": page(3), "issues/b&page=1": r(500)})
    assert [[x["id"] for x in p] for p in C.Issues(client, ["a", "b"], attempts=2, sleep=lambda s: None).fetch(C.SyncState("issues"))] == [[1, 2], [3]] and client.asked.count("issues/b&page=1") == 2
    stored = {"stories/top": r(200, [7, 8]), "stories/item/7": r(200, {"id": 7, "kids": list(range(20, 28))}), "stories/item/8": r(200, {"id": 8, "dead": True})}
    stored |= {f"stories/item/{i}": r(200, {"id": i, "deleted": i == 21}) for i in range(20, 28)}
    assert [x["id"] for p in C.Stories(C.Replay(stored)).fetch(C.SyncState("stories")) for x in p] == [7, 20, 22, 23, 24]
    posts = lambda ids, more, end: r(200, {"edges": [{"node": {"id": i}} for i in ids], "pageInfo": {"hasNextPage": more, "endCursor": end}})
    launches = {"launches": posts([1], True, "c1"), "launches&after=c1": posts([2], False, None), "launches/1/comments": posts([10], True, "k1"), "launches/1/comments&after=k1": posts([11], True, "k2"), "launches/1/comments&after=k2": posts([12], True, "k3"), "launches/1/comments&after=k3": posts([13], False, None)}
    assert [x["id"] for p in C.Launches(C.Replay(launches)).fetch(C.SyncState("launches")) for x in p] == [1, 10, 11, 12, 2]
    videos = {"videos/search&q=x": r(200, {"items": [{"id": {"videoId": "v"}}], "nextPageToken": "t"}), "videos/v": r(200, {"id": "v"}), "videos/v/comments": r(200, {"items": [{"id": "c"}]}), "videos/search&pageToken=t&q=x": r(200, {"items": []})}
    poor = C.Videos(C.Replay(videos), ["x"], quota=102)
    assert [x["id"] for p in poor.fetch(C.SyncState("videos")) for x in p] == ["v", "c"] and poor.quota == 0
    apps = {"reviews/app": r(200, {"reviews": [{"reviewId": i} for i in "abc"], "token": "n"}), "reviews/app&token=n": r(200, {"reviews": [{"reviewId": "d"}, {"reviewId": "e"}]})}
    assert [x["reviewId"] for p in C.AppReviews(C.Replay(apps), ["app"], most_reviews=4).fetch(C.SyncState("app_reviews")) for x in p] == list("abcd")
    base = f"file://{tmp_path}"
    state = C.sync(spark, C.Issues(client, ["a"]), base, f"{base}/state", datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert (state.collected, state.cursor, state.failures) == (3, "3", 0) and C.load_state(spark, f"{base}/state", "issues") == state and C.load_state(spark, f"{base}/state", "new") == C.SyncState("new")


def test_comments_are_normalised(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"items": [{"id": 5, "text": "hi", "by": "ann", "time": 1}, {"id": 6, "deleted": True}]}))
    raw = connectors.replay(spark, "stories", f"file://{tmp_path}")
    got = connectors.normalise("stories", raw, comments=True).collect()
    assert [(r["external_id"], r["content"], r["title"], r["source_type"]) for r in got] == [("5", "hi", "", "comment")] and got[0]["id"] != connectors.normalise("stories", raw).first()["id"]


def test_directory_is_read_by_families(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(f"clean_comment,category\nhello {i},1\n,0\n")
    (tmp_path / "odd.csv").write_text("x,y\n1,2\n")
    (tmp_path / "note.txt").write_text("no")
    df, errors = readers.load_directory(spark, f"file://{tmp_path}")
    assert sorted(r["text"] for r in df.collect()) == ["hello 0", "hello 1", "hello 2"] and [p.rpartition("/")[2] for p in errors] == ["odd.csv"]


def test_schedules():
    now = datetime(2024, 5, 1, 3, 0)  # a Wednesday
    assert next_run("once", now) is None and next_run("hourly", now) == datetime(2024, 5, 1, 4, 0) and next_run("daily", now) == datetime(2024, 5, 2, 2, 0)
    assert next_run("weekly", now) == datetime(2024, 5, 5, 2, 0) and next_run("weekly", datetime(2024, 5, 5, 2, 0)) == datetime(2024, 5, 12, 2, 0) and next_run("daily", datetime(2024, 5, 1, 1, 0)) == datetime(2024, 5, 1, 2, 0)


def test_registries_refuse_a_taken_name():
    assert "causal_chain" in registries.names("rules") and "market" in registries.names("templates")
    with pytest.raises(ValueError):
        registries.register("embedding", "hashed", None)
    with pytest.raises(NotImplementedError):
        W.EMBEDDERS["openai"](["x"])


def test_threshold_warning_and_index(spark, tmp_path):
    assert W.threshold_warning((0.5, 0.9), 0.7) is None and "under" in W.threshold_warning((0.5, 0.9), 0.3) and "over" in W.threshold_warning((0.5, 0.9), 0.95)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index = W.LinearIndex(v).add(spark.createDataFrame([(3, [1.0, 0.1])], "vec_id long, embedding array<double>"))
    index.save(f"file://{tmp_path}/index")
    again = W.LinearIndex.load(spark, f"file://{tmp_path}/index")
    assert [r["target_id"] for r in again.search(v.where("vec_id = 1"), 2).orderBy(F.desc("score")).collect()] == [1, 3]
    assert X.ngram_counts(spark.createDataFrame([("aaa bbb",)] * 5, "text string"), 2).collect()[0]["n"] == 5 and T.title_case is not None
