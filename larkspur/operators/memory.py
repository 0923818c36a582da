"""Episodes, learnings, sessions and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scores
from ..functions.text import ascii_bounds, whitespace_words
from . import ordered, patterns, text_search, vector

ROTATE_AT, ROTATE_SHARE = 10_000, 0.2

# ── episodes ────────────────────────────────────────────────────────────────────────────────────────────────────────


def between(events: DataFrame, start=None, end=None, time_col: str = "time") -> DataFrame:
    """Events of a time range, both ends included."""
    if start is not None:
        events = events.where(F.col(time_col) >= F.lit(start).cast("timestamp"))
    return events if end is None else events.where(F.col(time_col) <= F.lit(end).cast("timestamp"))


def event_text(events: DataFrame) -> Column:
    return F.concat_ws(" ", F.col("event"), F.array_join(F.map_values("metadata"), " "))


def search(events: DataFrame, query: str, k: int = 10, start=None, end=None) -> DataFrame:
    """BM25 over event names and metadata values; the statistics are those of the time range alone."""
    docs = between(events, start, end).select("id", event_text(events).alias("text"))
    return text_search.bm25(docs, query, k, "id", "text")


def search_plus(events: DataFrame, query: str, k: int = 10, embedder=None) -> DataFrame:
    """BM25+ over event names and metadata as JSON; where nothing ranks and an embedder is given, cosine above 0.3."""
    docs = events.select("id", F.concat_ws(" ", "event", F.to_json("metadata")).alias("text"))
    found = text_search.bm25_plus(docs, query, k, "id", "text")
    if embedder is None or not found.isEmpty():
        return found
    rows = vector.embed(events.select("id", F.substring(F.coalesce("event", F.to_json("metadata")), 1, 512).alias("text")), "text", embedder)
    near = vector.knn_cosine(rows, embedder([query])[0].tolist(), k, id_col="id", least=0.3)
    return near.select("id", F.round("cosine", 6).alias("score"))


def with_previous(events: DataFrame, id_col: str = "id", time_col: str = "time", bucket: str | None = None) -> DataFrame:
    """Events with the id of the one before.  ``bucket`` names a stream (a user, a session) of its own order."""
    if not bucket:
        return ordered.previous(events, [time_col, id_col], id_col)
    return events.withColumn("prev", F.lag(id_col).over(Window.partitionBy(bucket).orderBy(time_col, id_col)))


def history(events: DataFrame, n: int = 100, time_col: str = "time", id_col: str = "id") -> DataFrame:
    """The last ``n`` events, oldest first."""
    return events.orderBy(F.desc(time_col), F.desc(id_col)).limit(n).orderBy(time_col, id_col)


def rotate(events: DataFrame, cap: int = ROTATE_AT, time_col: str = "time", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Kept and archived events: at the cap the oldest fifth goes, one at least."""
    n = events.count()
    if n < cap:
        return events, events.limit(0)
    places = ordered.numbered(events, [time_col, id_col], "__place")
    share = max(1, int(n * ROTATE_SHARE))
    return places.where(F.col("__place") > share).drop("__place"), places.where(F.col("__place") <= share).drop("__place")


def mark_stale(events: DataFrame, path: str, reason: str = "file removed") -> DataFrame:
    """Flag events that mention a path and are not stale yet."""
    text = F.concat(F.coalesce("event", F.lit("")), F.coalesce(F.to_json("metadata"), F.lit("")))
    hit = text.contains(path) & ~F.coalesce("stale", F.lit(False))
    return events.withColumn("stale_reason", F.when(hit, F.lit(reason)).otherwise(F.col("stale_reason"))).withColumn("stale", F.coalesce("stale", F.lit(False)) | hit)


def newly_stale(events: DataFrame, paths: DataFrame, reason: str = "file removed") -> DataFrame:
    """The events that ``mark_stale_any`` changes, as it leaves them."""
    marked = mark_stale_any(events, paths, reason)
    before = events.where(~F.coalesce("stale", F.lit(False))).select("id")
    return marked.where("stale").join(before, "id", "left_semi").select(*events.columns)


def mark_stale_any(events: DataFrame, paths: DataFrame, reason: str = "file removed") -> DataFrame:
    """Flag events that mention any of ``paths(path)``; texts and paths meet by their grams (``patterns.holding``)."""
    text = F.concat(F.coalesce("event", F.lit("")), F.coalesce(F.to_json("metadata"), F.lit("")))
    found = patterns.holding(events.select("id", text.alias("text")), paths.select(F.col("path").alias("pattern")))
    hit = found.select("id").distinct().withColumn("__hit", F.lit(True))
    rows = events.join(hit, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)) & ~F.coalesce("stale", F.lit(False)))
    rows = rows.withColumn("stale_reason", F.when(F.col("__hit"), F.lit(reason)).otherwise(F.col("stale_reason")))
    return rows.withColumn("stale", F.coalesce("stale", F.lit(False)) | F.col("__hit")).select(*events.columns)


# ── learnings ───────────────────────────────────────────────────────────────────────────────────────────────────────


def tagged(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumn("type", rules.learning_type(text_col)).withColumn("scope", rules.learning_scope(text_col))


def current(learnings: DataFrame) -> DataFrame:
    """Learnings neither deprecated nor superseded."""
    gone = learnings.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    return learnings.where(~F.coalesce("deprecated", F.lit(False))).join(gone, "id", "left_anti")


def learning_score(text: Column, query: str, days: Column) -> Column:
    """Share of the query's words found in the text (repeats count), and how new it is."""
    words = query.lower().split()
    found = sum((F.lower(text).contains(w).cast("int") for w in words), F.lit(0))
    return F.lit(0.7) * found / F.lit(float(max(len(words), 1))) + F.lit(0.3) / (F.lit(1.0) + F.coalesce(days, F.lit(365)))


def retrieve(learnings: DataFrame, query: str, as_of: Column, k: int = 5, types: list[str] | None = None) -> DataFrame:
    rows = learnings.where(F.col("type").isin(types)) if types else learnings
    days = scores.days_between("timestamp", as_of)
    return rows.withColumn("score", F.round(learning_score(F.col("text"), query, days), 6)).orderBy(F.desc("score"), "id").limit(k)


def retrieve_scopes(learnings: DataFrame, query: str, as_of: Column, k: int = 5) -> DataFrame:
    """Top ``k`` of every scope, each id once, newest first."""
    days = scores.days_between("timestamp", as_of)
    scored = learnings.withColumn("score", F.round(learning_score(F.col("text"), query, days), 6))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id"))
    kept = scored.withColumn("__p", place).where(F.col("__p") <= k).groupBy("id").agg(F.max_by(F.struct(*[c for c in scored.columns if c != "id"]), "score").alias("x"))
    return kept.select("id", "x.*").orderBy(F.desc("timestamp"), "id").limit(k)


def conflicts(learnings: DataFrame, text: str, k: int = 3, above: float = 0.3) -> DataFrame:
    """Learnings that share more than ``above`` of the new text's words; those of the project first."""
    words = sorted(set(text.lower().split()))
    new = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    overlap = F.size(F.array_intersect(F.array_distinct(whitespace_words("text")), new)) / F.lit(float(max(len(words), 1)))
    return learnings.withColumn("overlap", F.round(overlap, 6)).where(F.col("overlap") > above).orderBy(F.col("scope") != "project", F.desc("overlap"), "id").limit(k)


def supersede(learnings: DataFrame, old: str, new: DataFrame) -> DataFrame:
    return learnings.unionByName(new.withColumn("supersedes", F.lit(old)), allowMissingColumns=True)


def injected(learnings: DataFrame, each: int = 200, total: int = 1800, k: int = 3) -> DataFrame:
    """Up to ``k`` corrections and production issues for a prompt, newest first, within a total length."""
    top = learnings.where(F.col("type").isin("correction", "prod_issue")).orderBy(F.desc("timestamp"), "id").limit(k).withColumn("text", F.substring("text", 1, each))
    run = F.sum(F.length("text")).over(Window.orderBy(F.desc("timestamp"), "id"))
    return top.withColumn("__run", run).where(F.col("__run") <= total).drop("__run")


# ── retention ───────────────────────────────────────────────────────────────────────────────────────────────────────


def prune(memories: DataFrame, as_of: Column, aggressive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept and pruned memories by decayed importance; a missing time counts as new."""
    days = F.coalesce(scores.days_between("created_at", as_of), F.lit(0))
    scored = memories.withColumn("decay_score", scores.decayed("importance", days))
    keep = F.coalesce(F.col("decay_score") >= (scores.PRUNE_BELOW_AGGRESSIVE if aggressive else scores.PRUNE_BELOW), F.lit(False))
    return scored.where(keep), scored.where(~keep)


def compact(memories: DataFrame) -> DataFrame:
    """Live rows numbered anew without gaps, in the old order, without bringing all rows to one task."""
    return ordered.numbered(vector.live(memories), ["row_id"], "__place").withColumn("row_id", F.col("__place") - 1).drop("__place")


def dead_share(memories: DataFrame) -> DataFrame:
    dead = F.coalesce("deprecated", F.lit(False)) | F.coalesce("suppressed", F.lit(False))
    share = F.avg(dead.cast("double"))
    return memories.agg(F.coalesce(share, F.lit(0.0)).alias("dead_share")).withColumn("rebuild", F.col("dead_share") >= 0.20)


def cleanup_queue(items: DataFrame, as_of: Column) -> DataFrame:
    days = (F.unix_micros(as_of) - F.unix_micros("suppressed_at")) / F.lit(86_400_000_000.0)
    return items.withColumn("priority", F.round(scores.cleanup_priority(days, "importance", "similarity"), 6))


def pop_batch(queue: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The ``n`` of highest priority, and the rest."""
    top = queue.orderBy(F.desc("priority"), "entry_id").limit(n)
    return top, queue.join(top.select("entry_id"), "entry_id", "left_anti")


def latest_scores(memories: DataFrame, updates: DataFrame) -> DataFrame:
    """Memories with the last of the logged updates ``(row_id, score, seq)`` of their behaviour score."""
    last = updates.groupBy("row_id").agg(F.max_by("score", "seq").alias("__score"))
    return memories.join(last, "row_id", "left").withColumn("behaviour_score", F.coalesce("__score", "behaviour_score")).drop("__score")


def with_tombstones(memories: DataFrame, gone: DataFrame) -> DataFrame:
    return memories.join(gone.select("row_id").distinct(), "row_id", "left_anti")


def suppress(memories: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """Apply suppressions ``(row_id, reason)``."""
    m = marks.groupBy("row_id").agg(F.min("reason").alias("__reason"))
    hit = F.col("__reason").isNotNull()
    rows = memories.join(m, "row_id", "left")
    return (
        rows.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)) | hit)
        .withColumn("suppress_reason", F.coalesce("__reason", "suppress_reason"))
        .withColumn("suppressed_at", F.when(hit, at).otherwise(F.col("suppressed_at")))
        .drop("__reason")
    )


def storable(rows: DataFrame, least_length: int = 50, least_importance: float = 0.30) -> DataFrame:
    return rows.where((F.length("text") >= least_length) & (F.col("importance") >= least_importance))


# ── sessions (conv_id, turn, role, text) ────────────────────────────────────────────────────────────────────────────


def capped(turns: DataFrame, exchanges: int = 10) -> DataFrame:
    """The last turns of every conversation, two per exchange."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return turns.withColumn("__p", place).where(F.col("__p") <= 2 * exchanges).drop("__p")


def key_texts(turns: DataFrame, k: int = 3, least: int = 40) -> DataFrame:
    """Assistant texts to remember: those that correct something in order, then the longest."""
    said = turns.where((F.col("role") == "assistant") & (F.length("text") > least))
    fix = rules.any_of(F.lower("text"), rules.CORRECTION)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("__fix"), F.when(F.col("__fix"), F.col("turn")).otherwise(-F.length("text")), "turn"))
    return said.withColumn("__fix", fix).withColumn("place", place).where(F.col("place") <= k).select("conv_id", "turn", "place", "text")


def last_exchanges(turns: DataFrame, length: int = 300) -> DataFrame:
    """Per conversation the last assistant text and the user text before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = turns.withColumn("user", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(before))
    last = asked.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.struct("user", "text"), "turn").alias("x"), F.max("turn").alias("turn"))
    return last.select("conv_id", "turn", F.substring("x.user", 1, length).alias("user"), F.substring("x.text", 1, length).alias("assistant"))


def seeds(turns: DataFrame, pattern: str = r"(?i)\b(fix|decid|because|should|must|never|always|instead)", least: int = 80) -> DataFrame:
    """Assistant texts worth a memory, with the user turn right before them."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("user", F.when(F.lag("role").over(order) == "user", F.lag("text").over(order)))
    return paired.where((F.col("role") == "assistant") & (F.length("text") >= least) & F.col("text").rlike(ascii_bounds(pattern))).select("conv_id", "turn", "user", "text")


def find_session(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session of that id, or the only one whose id starts so; none where several do."""
    found = sessions.where(F.col("session_id").startswith(prefix))
    alone = found.agg((F.count("*") == 1).alias("__alone"))
    return found.crossJoin(F.broadcast(alone)).where(F.col("__alone") | (F.col("session_id") == prefix)).drop("__alone")


def list_sessions(sessions: DataFrame, k: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), "session_id").limit(k)


def unclosed(sessions: DataFrame) -> DataFrame:
    return sessions.where("closed_at is null")


def current_session(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.max_by("session_id", "created_at").alias("session_id"))
