"""Reports: sections from the pipeline's small aggregates, templates, charts, a store with search and comparison."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.operators.opportunity import recommendation
from loomline.sources.sinks import collect_assets

MOST_ITEMS = 20  # items shown of a ranked list: a top-k report


def _count(df: DataFrame | None) -> int:
    return df.count() if df is not None else 0


def collect(spark: SparkSession, folder: str) -> dict:
    """What a report is made of, from the assets that are there: counts, means, distributions and top items."""
    a = collect_assets(spark, folder, ["opportunities", "trends", "root_causes", "inferences", "evidence_aggregations", "graph_nodes", "graph_edges"])
    out: dict = {"available": {k: k in a for k in ("graph_nodes", "inferences", "opportunities", "trends")}}
    opp = a.get("opportunities")
    if opp is not None:
        kinds = {r["k"]: r["n"] for r in opp.groupBy(recommendation(F.col("opportunity_score")).alias("k")).agg(F.count("*").alias("n")).collect()}  # five kinds
        mean = opp.agg(F.avg("opportunity_score").alias("a"), F.max("opportunity_score").alias("m")).first()
        top = opp.orderBy(F.desc("opportunity_score"), "key").limit(MOST_ITEMS).select(F.col("key").cast("string").alias("title"), F.col("opportunity_score").alias("score"))
        out["opportunities"] = {"total": sum(kinds.values()), "kinds": kinds, "avg_score": mean["a"] or 0.0, "max_score": mean["m"] or 0.0, "top": [r.asDict() for r in top.collect()]}
    trends = a.get("trends")
    if trends is not None:
        kinds = {r["trend_type"]: r["n"] for r in trends.groupBy("trend_type").agg(F.count("*").alias("n")).collect()}  # four kinds
        top = trends.orderBy(F.desc("trend_score"), "subject").limit(MOST_ITEMS).select(F.col("subject").cast("string").alias("title"), F.col("trend_score").alias("score"))
        out["trends"] = {"total": sum(kinds.values()), "kinds": kinds, "avg_score": trends.agg(F.avg("trend_score")).first()[0] or 0.0, "top": [r.asDict() for r in top.collect()]}
    causes, inferences, evidence = a.get("root_causes"), a.get("inferences"), a.get("evidence_aggregations")
    reasoning = {"root_causes": _count(causes), "inferences": _count(inferences), "evidence": _count(evidence), "avg_confidence": 0.0, "causes": [], "conclusions": []}
    if inferences is not None:
        reasoning["avg_confidence"] = inferences.agg(F.avg("confidence")).first()[0] or 0.0
    if causes is not None:
        reasoning["causes"] = [r.asDict() for r in causes.orderBy(F.desc("score"), "cause", "effect").limit(MOST_ITEMS).select(F.col("cause").alias("title"), "score").collect()]
    if evidence is not None:
        reasoning["conclusions"] = [r.asDict() for r in evidence.orderBy(F.desc("confidence"), "conclusion").limit(MOST_ITEMS).select(F.col("conclusion").alias("title"), "confidence", "evidence_count").collect()]
    out["reasoning"] = reasoning
    out["graph"] = {"nodes": _count(a.get("graph_nodes")), "edges": _count(a.get("graph_edges"))}
    return out


def _opp(c: dict) -> dict:
    return c.get("opportunities", {"total": 0, "kinds": {}, "avg_score": 0.0, "max_score": 0.0, "top": []})


def _trend(c: dict) -> dict:
    return c.get("trends", {"total": 0, "kinds": {}, "avg_score": 0.0, "top": []})


def executive_summary(c: dict) -> dict:
    o, t, r, g = _opp(c), _trend(c), c["reasoning"], c["graph"]
    text = f"Analysis of {o['total']} opportunities, {t['total']} trends, {r['root_causes']} root causes, and {g['nodes']} knowledge graph nodes."
    return {"summary": text, "metrics": {"opportunities": o["total"], "trends": t["total"], "growing_trends": t["kinds"].get("growing", 0), "strong_pursue": o["kinds"].get("strong_pursue", 0), "root_causes": r["root_causes"], "nodes": g["nodes"]}}


def top_findings(c: dict) -> dict:
    found = [x | {"source": "opportunity"} for x in _opp(c)["top"]] + [x | {"source": "trend"} for x in _trend(c)["top"]]
    return {"findings": sorted(found, key=lambda x: -x["score"])[:MOST_ITEMS], "total": min(len(found), MOST_ITEMS)}


def trend_analysis(c: dict) -> dict:
    t = _trend(c)
    return {"total": t["total"], "distribution": {k: t["kinds"].get(k, 0) for k in ("growing", "declining", "emerging")}, "items": t["top"]}


def opportunity_analysis(c: dict) -> dict:
    o = _opp(c)
    return {"total": o["total"], "strong_pursue": o["kinds"].get("strong_pursue", 0), "worth_exploring": o["kinds"].get("worth_exploring", 0), "avg_score": o["avg_score"], "max_score": o["max_score"], "items": o["top"]}


def reasoning_summary(c: dict) -> dict:
    return {k: c["reasoning"][k] for k in ("inferences", "root_causes", "evidence")}


def root_cause_section(c: dict) -> dict:
    return {"items": c["reasoning"]["causes"], "total": len(c["reasoning"]["causes"])}


def evidence_section(c: dict) -> dict:
    return {"items": c["reasoning"]["conclusions"], "total": c["reasoning"]["evidence"]}


def confidence_section(c: dict) -> dict:
    scores = {"reasoning": c["reasoning"]["avg_confidence"], "opportunities": _opp(c)["avg_score"], "trends": _trend(c)["avg_score"]}
    scores = {k: v for k, v in scores.items() if v}
    return {"metrics": scores, "overall": round(sum(scores.values()) / len(scores), 3) if scores else 0.0}


def chart_section(c: dict) -> dict:
    return {"total": 0}


def recommendation_section(c: dict) -> dict:
    o, t = _opp(c)["kinds"], _trend(c)["kinds"]
    said = (
        (o.get("strong_pursue", 0), "Pursue {} high-value opportunities identified"), (o.get("worth_exploring", 0), "Explore {} promising opportunities further"),
        (t.get("growing", 0), "Monitor {} growing trends for strategic alignment"), (t.get("emerging", 0), "Watch {} emerging trends for early signals"),
    )
    return {"recommendations": [text.format(n) for n, text in said if n] or ["Continue monitoring pipeline for new opportunities and trends"]}


def appendix(c: dict) -> dict:
    return {"sources": c["available"]}


#: Section builders by type, in the order of a report.
SECTIONS: dict[str, Callable[[dict], dict]] = {
    "executive_summary": executive_summary, "top_findings": top_findings, "trend_analysis": trend_analysis, "opportunity_analysis": opportunity_analysis, "reasoning_summary": reasoning_summary,
    "root_causes": root_cause_section, "evidence": evidence_section, "confidence": confidence_section, "charts": chart_section, "recommendations": recommendation_section, "appendix": appendix,
}
_ENDS = ("confidence", "recommendations", "appendix")
#: Templates: the sections of each type of report.
TEMPLATES = {
    "executive_summary": ("executive_summary", "top_findings", "trend_analysis", "opportunity_analysis", *_ENDS),
    "business": ("executive_summary", "opportunity_analysis", "root_causes", "evidence", *_ENDS),
    "founder": ("executive_summary", "top_findings", "opportunity_analysis", "root_causes", "charts", *_ENDS),
    "investor": ("executive_summary", "opportunity_analysis", "trend_analysis", "evidence", *_ENDS),
    "market": ("executive_summary", "trend_analysis", "opportunity_analysis", "charts", *_ENDS),
    "technology": ("executive_summary", "trend_analysis", "reasoning_summary", "root_causes", "evidence", *_ENDS),
}


def build(kind: str, collected: dict, title: str | None = None, now: datetime | None = None, lists: dict[str, list[str]] | None = None) -> dict:
    """A report: id, kind, title, time, sections, summary, and its lists (tags, companies, products, technologies, opportunities)."""
    if kind not in TEMPLATES:
        raise ValueError(f"no report template {kind}")
    made = (now or datetime.now(timezone.utc)).isoformat()
    o, t = _opp(collected), _trend(collected)
    title = title or kind.replace("_", " ").title()
    summary = f"This report analyzes {o['total']} opportunities and {t['total']} trends. Found {o['kinds'].get('strong_pursue', 0)} strong-pursue opportunities and {t['kinds'].get('growing', 0)} growing trends."
    lists = {k: sorted((lists or {}).get(k, [])) for k in ("tags", "companies", "products", "technologies")} | {"opportunities": [x["title"] for x in o["top"]]}
    sections = [{"type": s, "order": i, "content": SECTIONS[s](collected)} for i, s in enumerate(SECTIONS) if s in TEMPLATES[kind]]
    return {"report_id": hashlib.sha256(f"{kind}:{title}:{made}".encode()).hexdigest()[:16], "kind": kind, "title": title, "generated_at": made, "summary": summary, "sections": sections, **lists}


_LISTS = ("tags", "companies", "products", "technologies", "opportunities")
_STORED = "report_id string, kind string, title string, generated_at string, content string, " + ", ".join(f"{c} array<string>" for c in _LISTS)


def store(spark: SparkSession, report: dict, folder: str) -> None:
    """Adds a report to the store; its lists are columns, so search reads the index and not the contents."""
    row = (report["report_id"], report["kind"], report["title"], report["generated_at"], json.dumps(report, default=str), *[report[c] for c in _LISTS])
    spark.createDataFrame([row], _STORED).write.mode("append").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(folder)


def search(reports: DataFrame, query: str | None = None, kind: str | None = None, tag: str | None = None, company: str | None = None, technology: str | None = None, since: str | None = None, until: str | None = None, top: int = 20) -> DataFrame:
    """Newest first; lists match whole values, the query parts of title, kind and lists, all case-blind; days are inclusive."""
    out = reports if kind is None else reports.where(F.col("kind") == kind)
    for col, value in (("tags", tag), ("companies", company), ("technologies", technology)):
        out = out if value is None else out.where(F.array_contains(F.transform(col, F.lower), value.lower()))
    day = F.substring("generated_at", 1, 10)
    out = out if since is None else out.where(day >= since)
    out = out if until is None else out.where(day <= until)
    if query is not None:
        q = query.lower()
        hit = F.lower("title").contains(q) | F.lower("kind").contains(q)
        for col in ("tags", "companies", "technologies"):
            hit = hit | F.exists(col, lambda x: F.lower(x).contains(q))
        out = out.where(hit)
    return out.orderBy(F.desc("generated_at"), "report_id").limit(top)


def compare(reports: DataFrame, before: str, after: str) -> DataFrame:
    """One row: opportunities that are new and that went, new companies and products, of two stored reports."""
    side = lambda i, p: reports.where(F.col("report_id") == i).select(*[F.col(c).alias(f"{p}_{c}") for c in _LISTS])
    both = side(before, "a").join(F.broadcast(side(after, "b")))  # one row each
    diff = lambda x, y, c: F.array_except(f"{x}_{c}", f"{y}_{c}")
    return both.select(
        F.lit(before).alias("before"), F.lit(after).alias("after"), diff("b", "a", "opportunities").alias("new_opportunities"), diff("a", "b", "opportunities").alias("removed_opportunities"),
        diff("b", "a", "companies").alias("new_companies"), diff("b", "a", "products").alias("new_products"), F.col("a_tags"), F.col("b_tags"),
    )


# ---- charts


def _points(df: DataFrame, cols: list[str], most: int, order: str) -> list[list]:
    got = [list(r) for r in df.select(*cols).orderBy(order).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a chart shows at most {most} points: aggregate first")
    return got


def series_chart(kind: str, df: DataFrame, x: str, y: str, most: int = 1000) -> dict:
    """bar, line and timeline: labels and values in order of ``x``."""
    points = _points(df, [x, y], most, x)
    return {"type": kind, "labels": [p[0] for p in points], "values": [p[1] for p in points]}


def pie_chart(df: DataFrame, label: str, value: str, most: int = 1000) -> dict:
    points = _points(df, [label, value], most, label)
    total = sum(p[1] for p in points) or 1
    return {"type": "pie", "slices": [{"label": p[0], "value": p[1], "share": round(p[1] / total, 4)} for p in points]}


def heatmap_chart(df: DataFrame, x: str, y: str, value: str, most: int = 10_000) -> dict:
    points = _points(df, [x, y, value], most, x)
    xs, ys = sorted({p[0] for p in points}), sorted({p[1] for p in points})
    at = {(p[0], p[1]): p[2] for p in points}
    return {"type": "heatmap", "x": xs, "y": ys, "z": [[at.get((i, j), 0) for i in xs] for j in ys]}


def treemap_chart(df: DataFrame, parent: str, label: str, value: str, most: int = 10_000) -> dict:
    points = _points(df, [parent, label, value], most, parent)
    return {"type": "treemap", "parents": [p[0] for p in points], "labels": [p[1] for p in points], "values": [p[2] for p in points]}


def sankey_chart(df: DataFrame, source: str, target: str, value: str, most: int = 10_000) -> dict:
    points = _points(df, [source, target, value], most, source)
    names = sorted({n for p in points for n in p[:2]})
    return {"type": "sankey", "nodes": names, "links": [{"source": names.index(p[0]), "target": names.index(p[1]), "value": p[2]} for p in points]}


CHARTS: dict[str, Callable[..., dict]] = {
    "bar": lambda df, x, y: series_chart("bar", df, x, y), "line": lambda df, x, y: series_chart("line", df, x, y), "timeline": lambda df, x, y: series_chart("timeline", df, x, y),
    "pie": pie_chart, "heatmap": heatmap_chart, "treemap": treemap_chart, "sankey": sankey_chart,
}


# ---- exporters of stages


def export_stage(name: str, frames: dict[str, DataFrame], folder: str, most: int = 10_000) -> dict:
    """Writes a stage's frames as CSV and JSON folders and gives its dashboard: rows and columns of each."""
    board = {"stage": name, "tables": {}}
    for part, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_{part}_csv")
        df.write.mode("overwrite").json(f"{folder}/{name}_{part}_json")
        board["tables"][part] = {"rows": df.count(), "columns": df.columns}
    return board
