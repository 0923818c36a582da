"""Rule tables as column expressions: learning tags, question types, query tiers, error hints, query rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Signals of what a learning is, in the order in which they are tried, and of global scope.
CORRECTION = ("mistake", "correction", "corrected", "wrong approach", "incorrect", "don't do this", "fixed:", "fix:", "bug fix", "fixed a bug")
PROD_ISSUE = ("prod issue", "production issue", "reported", "root cause", "incident", "outage", "regression", "prod bug", "in production")
DECISION = ("we decided", "decided to", "decision:", "we chose", "going with", "our approach", "architecture decision", "adr:")
GLOBAL_SCOPE = ("prefer", "always use", "never use", "style", "convention", "claude", "gemini", "cursor", "ai model", "model preference", "developer preference", "dev preference")
GLOBAL_CORRECTION = ("ai model", "claude", "gemini", "cursor", "model")
# Question types, first match wins.
QUESTION_TYPES = (
    (r"^why\b", "why"), (r"^what\b", "what"), (r"^how\b", "how"), (r"^(fix|debug|resolve|solve|error|bug)\b", "debug"),
    (r"^(explain|describe|tell me about|what does)\b", "explain"), (r"^where\b", "where"),
    (r"^(refactor|improve|optimize|simplify|clean)\b", "refactor"), (r"^(add|implement|create|write|build)\b", "implement"),
)
# The words and phrases that the query tier depends on.
REASONING = (
    "why", "compare", "refactor", "design", "tradeoff", "trade-off", "architecture", "explain", "difference", "versus", "vs", "pros", "cons",
    "evaluate", "analyse", "analyze", "suggest", "recommend", "detail", "detailed", "improve", "improvements", "thorough", "comprehensive",
    "complex", "advanced", "in-depth", "deep dive", "security", "vulnerability", "vulnerabilities", "audit", "exploit", "attack surface",
    "injection", "authentication", "authorization", "performance", "bottleneck", "optimize", "optimization", "latency", "throughput",
    "scalability", "scalable", "reliability", "reliable", "step by step", "walk me through", "walk through",
)
LOOKUP = ("what is", "what are", "show", "list", "find", "get", "display", "print", "fetch", "retrieve", "where is", "which")
IMPERATIVE = ("implement", "build", "architect", "create", "design", "write", "develop", "engineer", "scaffold", "generate")
CONTEXT = (
    "last time", "earlier", "previously", "history", "before", "session", "remember", "recall", "as discussed", "you said", "what i", "my last",
    "in this repo", "in our repo", "in our codebase", "in my project", "in this codebase", "in this project", "our implementation", "our code", "this codebase", "this repo",
)
FULL_CONTEXT = ("full context", "everything related", "all related", "complete context")
DOCS_WORDS = "install|tier|mcp|prune|doctor|serve.api|retrieve|store|how does|index.repo|memory|graph|embedding"
ERROR_TRACE = r"(?i)(traceback|error:|exception:|syntaxerror|typeerror|nameerror|attributeerror|importerror|valueerror|keyerror|indexerror|runtimeerror|\bat line \d+|\bline \d+|stacktrace)"
TIERS = ((2.0, "QUICK"), (4.0, "STANDARD"), (9.0, "COMPLEX"))
TIER_RETRIEVAL = {"QUICK": (3, 0), "STANDARD": (5, 3), "COMPLEX": (10, 5), "EXPERT": (20, 10)}
# Hints by part of an error's name, first match wins.
ERROR_HINTS = (
    ("NameError", "Undefined variable — check imports and scope before use."),
    ("ImportError", "Import failed — verify package is installed and module path is correct."),
    ("AttributeError", "Object missing attribute — check type, None-guard, or spelling."),
    ("TypeError", "Wrong type — validate inputs at function boundary."),
    ("KeyError", "Missing dict key — use .get() with default or check existence first."),
    ("IndexError", "List out of range — guard with len() check before access."),
    ("ValueError", "Invalid value — add input validation before processing."),
    ("SyntaxError", "Syntax error — run a linter (ruff/flake8) before committing."),
    ("RuntimeError", "Runtime failure — add error logging at the call site."),
    ("OSError", "File/IO error — always guard file ops with try/except OSError."),
    ("Timeout", "Timeout — add explicit timeout parameter and retry logic."),
    ("AssertionError", "Assertion failed — review invariants; do not use assert in prod."),
)
DEFAULT_HINT = "Track root cause and add a targeted guard at the call site."
# Learning types by commit prefix and by comment tag.
COMMIT_PREFIXES = (
    ("fix:", "bug"), ("revert:", "bug"), ("decision:", "decision"), ("breaking:", "prod_issue"), ("feat:", "decision"),
    ("perf:", "decision"), ("security:", "prod_issue"), ("hotfix:", "prod_issue"),
)
COMMIT_ALARM = r"\b(broke|regression|critical|security|hotfix|revert)\b"
COMMENT_TAGS = {"fixme": "bug", "bug": "bug", "hack": "quirk", "warning": "quirk", "note": "decision", "todo": "decision", "xxx": "bug"}
COMMENT = r"(?i)#\s*(FIXME|HACK|NOTE|TODO|XXX|BUG|WARNING)[:\s]+(.{10,200})"
# What the query rewriter looks for.
VAGUE = r"(?i)\b(it|that|this|the thing|the bug|the issue|the problem|the error|the fix)\b"
NAME = r"\b([a-z_][a-z0-9_]{2,}|[A-Z][a-zA-Z0-9]{2,})\b"
DEPTH = r"(?i)\b(detailed|explain|overview|brief|quick|tldr|summary|in depth|step by step)\b"
QUERY_STOP_WORDS = [
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "for", "of", "and", "or", "not", "how", "why", "what", "when", "where", "which", "does",
    "do", "did", "can", "could", "will", "would", "fix", "bug", "issue", "error", "code", "file", "function", "class", "method",
]
DOC_INTENT = r"(?i)\b(how does|overview|architecture|what is|explain|describe|why does|design|purpose|history|background|changelog|readme|documentation)\b"


def any_of(text: Column, signals: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | text.contains(s)
    return out


def hits(text: Column, signals: tuple[str, ...] | list[str]) -> Column:
    return sum((text.contains(s).cast("int") for s in signals), F.lit(0))


def learning_type(text: Column | str) -> Column:
    """Null where no signal fires."""
    low = F.lower(col(text))
    return F.when(any_of(low, CORRECTION), "correction").when(any_of(low, PROD_ISSUE), "prod_issue").when(any_of(low, DECISION), "decision")


def learning_scope(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.when(any_of(low, GLOBAL_SCOPE) | ((learning_type(text) == "correction") & any_of(low, GLOBAL_CORRECTION)), "global").otherwise("project")


def question_type(text: Column | str) -> Column:
    low = F.lower(F.trim(col(text)))
    out = F.lit("other")
    for pattern, name in reversed(QUESTION_TYPES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def error_hint(kind: Column | str) -> Column:
    out = F.lit(DEFAULT_HINT)
    for key, hint in reversed(ERROR_HINTS):
        out = F.when(F.lower(col(kind)).contains(key.lower()), hint).otherwise(out)
    return out


def tier_score(query: Column | str) -> Column:
    """Sum of the seven signals of how much work a query is."""
    low = F.lower(F.trim(col(query)))
    tokens = F.filter(F.split(low, r"\s+"), lambda t: t != "")
    vague = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))),
            lambda i: F.coalesce(F.get(tokens, i - 1), F.lit("")).isin("it", "this", "that", "they", "them") & ~F.coalesce(F.when(i >= 2, F.get(tokens, i - 2)), F.lit("")).rlike("[a-zA-Z_]{3,}"),
        )
    )
    parts = F.filter(F.transform(F.split(low, r"""[\s,;:"'()\[\]{}]+"""), lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), lambda t: F.length(t) >= 2)
    names = F.size(F.array_distinct(F.filter(parts, lambda t: (t.contains("_") & F.replace(t, F.lit("_"), F.lit("")).rlike(r"^\p{L}+$")) | t.rlike(r"\.[a-z]{1,4}$"))))
    # fixed values: the weights of the signals
    return (
        F.lit(3.0) * hits(low, REASONING)
        - F.lit(2.0) * hits(low, LOOKUP)
        + F.lit(2.0) * vague
        + F.lit(1.5) * F.greatest(names - 2, F.lit(0))
        + F.lit(3.0) * any_of(low, CONTEXT).cast("int")
        + F.lit(0.05) * F.greatest(F.size(tokens) - 20, F.lit(0))
        + F.lit(5.0) * any_of(low, IMPERATIVE).cast("int")
    )


def _tier(score: Column) -> Column:
    out = F.lit("EXPERT")
    for most, name in reversed(TIERS):
        out = F.when(score <= most, name).otherwise(out)
    return out


def classify(query: Column | str, products: tuple[str, ...] = ()) -> Column:
    """``struct<tier, score, override>``; ``products`` are names whose mention makes a question one about the documentation."""
    q, low = F.trim(col(query)), F.lower(F.trim(col(query)))
    words = "|".join([*products, DOCS_WORDS])
    score = tier_score(query)
    override = (
        F.when(F.size(F.filter(F.split(low, r"\s+"), lambda t: t != "")) <= 1, "single_token")
        .when(q.rlike(rf"(?i)\b({words})\b"), "docs_query")
        .when(any_of(low, FULL_CONTEXT), "full_context_phrase")
        .when(q.rlike(ERROR_TRACE), "error_trace")
    )
    tier = (
        F.when(override.isin("single_token", "docs_query"), "QUICK")
        .when(override == "full_context_phrase", "EXPERT")
        .when(override == "error_trace", F.when(score >= 9.0, "EXPERT").otherwise("COMPLEX"))
        .otherwise(_tier(score))
    )
    shown = F.when(override.isin("single_token", "docs_query"), F.lit(0.0)).when(override == "full_context_phrase", F.lit(20.0)).otherwise(F.round(score, 2))
    return F.struct(tier.alias("tier"), shown.alias("score"), override.alias("override"))


def tier_retrieval(tier: Column | str, top_k: int, episodes: int) -> Column:
    """How much to fetch for a tier, at least what the caller asks for."""
    out = F.struct(F.lit(top_k).alias("top_k"), F.lit(episodes).alias("episodes"))
    for name, (k, e) in TIER_RETRIEVAL.items():
        out = F.when(col(tier) == name, F.struct(F.lit(max(k, top_k)).alias("top_k"), F.lit(max(e, episodes)).alias("episodes"))).otherwise(out)
    return out


def commit_learning(subject: Column | str) -> Column:
    """``struct<type, text>`` of a commit subject; a null type where it teaches nothing."""
    s = F.trim(col(subject))
    low = F.lower(s)
    kind, text = F.when(low.rlike(COMMIT_ALARM), "prod_issue"), s
    for prefix, name in reversed(COMMIT_PREFIXES):
        kind = F.when(low.startswith(prefix), name).otherwise(kind)
        text = F.when(low.startswith(prefix), F.trim(F.substring(s, len(prefix) + 1, 1 << 20))).otherwise(text)
    return F.struct(kind.alias("type"), text.alias("text"))


def comment_learning(line: Column | str) -> Column:
    """``struct<tag, type, text>`` of a tagged comment; a null tag where a line has none."""
    tag = F.lower(F.regexp_extract(col(line), COMMENT, 1))
    table = F.create_map(*[F.lit(x) for pair in COMMENT_TAGS.items() for x in pair])
    found = F.when(tag != "", tag)
    return F.struct(F.upper(found).alias("tag"), F.coalesce(F.try_element_at(table, found), F.when(found.isNotNull(), "bug")).alias("type"), F.trim(F.regexp_extract(col(line), COMMENT, 2)).alias("text"))
