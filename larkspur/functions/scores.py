"""Scores: similarities, decay, importance, priorities.  Every literal is a double, so no plan turns decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

HYBRID = {"vector": 0.5, "graph": 0.3, "behaviour": 0.2}
# Words that make a memory important, and the importance of what a tool stores.
IMPORTANT = ("bug", "fix", "error", "important")
TOOL_IMPORTANCE = {
    "explain_change": 0.75, "context_pack": 0.70, "semantic_search_code": 0.65, "who_calls": 0.60, "subgraph": 0.60,
    "dependency_graph": 0.60, "search_docs": 0.55,
}
NOVEL_ABOVE, SUPPRESS_ABOVE = 0.85, 0.92
PRUNE_BELOW, PRUNE_BELOW_AGGRESSIVE, DECAY = 0.15, 0.05, 0.1


def doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Zero where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def similarity(d2: Column | str) -> Column:
    """From a squared distance; for unit vectors this is the cosine, cut at zero."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - col(d2) / F.lit(2.0))


def combined(d2: Column | str, behaviour: Column | str) -> Column:
    return F.round(F.lit(0.8) * similarity(d2) + F.lit(0.2) * F.coalesce(col(behaviour).cast("double"), F.lit(0.0)), 4)


def behaviour_score(count: Column | str, most: Column | str) -> Column:
    """Logarithmic share of the largest count; zero without counts."""
    return F.when(col(most) > 0, F.log1p(F.coalesce(col(count), F.lit(0)).cast("double")) / F.log1p(col(most).cast("double"))).otherwise(F.lit(0.0))


def graph_score(hops: Column | str) -> Column:
    return F.when(col(hops).isNotNull(), F.lit(1.0) / (F.lit(1.0) + col(hops))).otherwise(F.lit(0.0))


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) != set(HYBRID) or abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError(f"retrieval weights must name {sorted(HYBRID)} and sum to 1: {weights}")
    return weights


def final_score(vector: Column | str, graph: Column | str, behaviour: Column | str, weights: dict[str, float] | None = None) -> Column:
    w = check_weights(weights or HYBRID)
    return F.round(F.lit(w["vector"]) * col(vector) + F.lit(w["graph"]) * col(graph) + F.lit(w["behaviour"]) * col(behaviour), 4)


def importance(text: Column | str) -> Column:
    found = sum((F.lower(col(text)).contains(w).cast("int") for w in IMPORTANT), F.lit(0))
    return F.least(F.lit(1.0), F.least(F.length(col(text)) / F.lit(100.0), F.lit(1.0)) + F.lit(0.2) * found)


def tool_importance(tool: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TOOL_IMPORTANCE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(tool)), F.lit(0.5))


def result_importance(tool: Column | str, section_scores: Column | str, top_score: Column | str) -> Column:
    """Packed context counts by the mean score of its sections plus a tenth, other results by their top score."""
    mean = F.aggregate(col(section_scores), F.lit(0.0), lambda s, x: s + x) / F.size(col(section_scores))
    packed = F.least(F.lit(1.0), mean + F.lit(0.1))
    scored = F.when((col(tool) == "context_pack") & (F.size(col(section_scores)) > 0), packed).when(col(top_score).isNotNull(), F.least(F.lit(1.0), col(top_score)))
    return F.coalesce(scored, tool_importance(tool))


def days_between(then: Column | str, as_of: Column | str) -> Column:
    """Whole days, as a double-safe long; the reference time is always given."""
    return F.floor((F.unix_micros(col(as_of)) - F.unix_micros(col(then))) / F.lit(86_400_000_000)).cast("long")


def decayed(importance_: Column | str, days: Column | str) -> Column:
    return col(importance_) * F.exp(F.lit(-DECAY) * col(days))


def cleanup_priority(days: Column | str, importance_: Column | str, sim: Column | str, full_age: float = 30.0) -> Column:
    age = F.least(F.greatest(col(days).cast("double"), F.lit(0.0)) / F.lit(full_age), F.lit(1.0))
    return F.lit(0.4) * age + F.lit(0.3) * (F.lit(1.0) - col(importance_)) + F.lit(0.3) * F.least(F.greatest(col(sim), F.lit(0.0)), F.lit(1.0))


def recency_weight(days: Column | str) -> Column:
    return F.when(col(days) <= 7, F.lit(1.0)).when(col(days) <= 30, F.lit(0.5)).otherwise(F.lit(0.1))


def confidence(score: Column | str) -> Column:
    return F.when(col(score) >= 0.60, "high").when(col(score) >= 0.35, "medium").otherwise("low")
