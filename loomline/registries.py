"""Extension points by name: each is a dictionary that a caller may add to.

Plain functions of columns or frames stand for scalar and table extensions; providers are callables or classes with the
shape of those already there.
"""

from __future__ import annotations

from loomline.functions import text as T
from loomline.operators import evaluation, extract, graph, knowledge, opportunity, reasoning, report, trend, vectors
from loomline.sources import collectors, connectors, readers

CLEANERS = {"mojibake": T.fix_mojibake, "html": T.strip_html, "urls": T.mask_urls, "emoji": T.strip_emoji, "space": T.clean_space, "normalise": T.normalise, "spelling": T.correct_spelling}
EXTRACTORS = {"entities": extract.entities, "names": extract.capitalised_names, "patterns": extract.patterns, "ngrams": extract.ngram_counts, "tfidf": extract.tfidf, "rake": extract.rake, "phrases": extract.adjective_noun}
SIMILARITY = {"cosine": vectors.cosine, "dot": vectors.dot, "euclidean": vectors.euclidean}
SCORING = {"market": opportunity.market_scores, "trend": opportunity.trend_scores, "competition": opportunity.competition_scores}
TREND_SCORING = {"confidence": trend.confidence_score, "momentum": trend.momentum, "composite": trend.composite_score}
RENDERERS = ("json", "markdown", "html", "csv")

REGISTRIES: dict[str, dict] = {
    "loaders": readers._LOADERS, "cleaners": CLEANERS, "extractors": EXTRACTORS, "collectors": collectors.COLLECTORS, "adapters": connectors.ADAPTERS, "embedding": vectors.EMBEDDERS, "similarity": SIMILARITY,
    "clustering": graph.PROVIDERS, "graph_assets": knowledge.ASSETS, "rules": reasoning.RULES, "scoring": SCORING, "trend_scoring": TREND_SCORING, "stage_weights": evaluation.STAGE_WEIGHTS, "charts": report.CHARTS,
    "sections": report.SECTIONS, "templates": report.TEMPLATES,
}


def register(kind: str, name: str, value) -> None:
    """Adds to a registry; a name that is taken is an error."""
    if name in REGISTRIES[kind]:
        raise ValueError(f"{kind} already has {name}")
    REGISTRIES[kind][name] = value


def names(kind: str) -> list[str]:
    return sorted(REGISTRIES[kind])
