"""Behaviour, episode, learning, session, retention, rule, packing and indexing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import rules, scores
from ..functions import text as T
from ..operators import behaviour, chunking, indexing, memory, metrics, packing
from .registry import query, table

_AS_OF = "2024-02-01"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


def _episodes(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.from_json("props", "map<string,string>").alias("metadata"), F.col("ts").alias("time"),
        F.lit(None).cast("boolean").alias("stale"), F.lit(None).cast("string").alias("stale_reason"), "user_id",
    )


def _micros(c):
    return F.unix_micros(c)


@query("SELECT event_id AS id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def event_history(spark, d):
    return memory.history(_episodes(spark, d), 100).select("id", _micros("time").alias("at"))


@query("SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def event_prev(spark, d):
    return memory.with_previous(_episodes(spark, d), bucket="user_id").select("id", "prev")


@query("SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events) WHERE n < 500 OR k > greatest(1, floor(n * 2e-1))")
def event_rotate(spark, d):
    return memory.rotate(_episodes(spark, d), 500)[0].select("id")


@query("SELECT event_id AS id, contains(event_type || props, 'purch') AS stale, CASE WHEN contains(event_type || props, 'purch') THEN 'file removed' END AS stale_reason FROM events")
def mark_stale(spark, d):
    return memory.mark_stale(_episodes(spark, d), "purch").select("id", "stale", "stale_reason")


_ERR = "SELECT CASE user_id % 4 WHEN 0 THEN 'KeyError' WHEN 1 THEN 'TimeoutExpired' WHEN 2 THEN 'MyTypeError' ELSE 'Odd' END AS error_type, 'f' || user_id % 11 AS file, ts, event_id FROM events WHERE event_type = 'error'"


@query(f"""SELECT error_type, count(*) AS count, array_to_string(list_sort(list(DISTINCT file)), ',') AS files, epoch_us(max(ts)) AS last_seen, substr(md5(error_type), 1, 8) AS signature, least(count(*), 5) AS kept,
CASE WHEN error_type = 'KeyError' THEN 'Missing dict key — use .get() with default or check existence first.' WHEN error_type = 'TimeoutExpired' THEN 'Timeout — add explicit timeout parameter and retry logic.' WHEN error_type = 'MyTypeError' THEN 'Wrong type — validate inputs at function boundary.' ELSE 'Track root cause and add a targeted guard at the call site.' END AS hint
FROM ({_ERR}) GROUP BY error_type HAVING count(*) >= 2""")
def error_patterns(spark, d):
    events = table(spark, d, "events").where("event_type = 'error'")
    kind = F.when(F.col("user_id") % 4 == 0, "KeyError").when(F.col("user_id") % 4 == 1, "TimeoutExpired").when(F.col("user_id") % 4 == 2, "MyTypeError").otherwise("Odd")
    rows = events.select(kind.alias("error_type"), F.concat(F.lit("f"), F.col("user_id") % 11).alias("file"), F.col("ts").alias("time"), F.col("event_id").cast("string").alias("message"))
    found = behaviour.error_patterns(rows, 2)
    return found.select("error_type", "count", F.array_join("files", ",").alias("files"), _micros("last_seen").alias("last_seen"), "signature", F.size("occurrences").cast("long").alias("kept"), "hint")


@query("""WITH q AS (SELECT event_id AS query_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts AS edit_ts, event_id FROM events WHERE event_type = 'purchase'),
h AS (SELECT query_id, min((edit_ts, 'f' || p.event_id)) AS x FROM q JOIN p ON q.user_id = p.user_id AND edit_ts BETWEEN ts AND ts + INTERVAL 60 MINUTE GROUP BY query_id)
SELECT q.query_id, epoch_us(x[1]) AS edit_at, x[2] AS file_edited, x IS NOT NULL AS useful FROM q LEFT JOIN h ON h.query_id = q.query_id""")
def useful_window(spark, d):
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("query_id"), "user_id", "ts")
    edits = events.where("event_type = 'purchase'").select("user_id", "ts", F.concat(F.lit("f"), "event_id").alias("file"))
    return behaviour.useful_queries(views, edits, 60).select("query_id", _micros("edit_ts").alias("edit_at"), "file_edited", "useful")


@query("""WITH x AS (SELECT l_orderkey AS s, 'p' || (l_partkey % 40) AS file, l_linenumber AS seq FROM lineitem),
f AS (SELECT s, file AS b, min(seq) AS first FROM x GROUP BY s, file),
p AS (SELECT x.file AS a, f.b, count(*) AS n FROM x JOIN f ON f.s = x.s AND f.b <> x.file AND x.seq > f.first GROUP BY x.file, f.b)
SELECT file_a, file_b, sum(n)::BIGINT AS n FROM (SELECT a AS file_a, b AS file_b, n FROM p UNION ALL SELECT b, a, n FROM p) GROUP BY file_a, file_b""")
def coedit_matrix(spark, d):
    items = table(spark, d, "lineitem")
    return behaviour.coedits(items.select(F.col("l_orderkey").alias("session"), F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("file"), F.col("l_linenumber").alias("seq")))


@query("""SELECT 'c' || o_custkey AS path, max(CASE WHEN days <= 7 THEN 1e0 WHEN days <= 30 THEN 5e-1 ELSE 1e-1 END) AS weight
FROM (SELECT o_custkey, floor((epoch_us(TIMESTAMP '1996-06-01') - epoch_us(o_orderdate::TIMESTAMP)) / 86400000000) AS days FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01') GROUP BY o_custkey""")
def git_recency_weights(spark, d):
    as_of = F.lit("1996-06-01").cast("timestamp")
    commits = table(spark, d, "orders").withColumn("time", F.col("o_orderdate").cast("timestamp")).where(F.col("time") < as_of)
    return behaviour.git_recency(commits.select(F.concat(F.lit("c"), "o_custkey").alias("path"), "time"), as_of)


@query("SELECT 'p' || l_partkey AS symbol, count(*) AS hit_count, least(1e0, 1e-1 * count(*)) AS relevance FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey ORDER BY hit_count DESC, symbol LIMIT 15")
def hot_symbols(spark, d):
    items = table(spark, d, "lineitem")
    history = items.select(F.array(F.concat(F.lit("p"), "l_partkey")).alias("symbols"), (F.col("l_returnflag") == "R").alias("useful"), F.col("l_shipdate").alias("time"))
    return behaviour.hot_symbols(behaviour.feedback(history), 15).select("symbol", "hit_count", "relevance")


@query("""WITH s AS (SELECT 'p' || l_partkey AS symbol, max(l_quantity) / 10 AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey),
h AS (SELECT 'p' || l_partkey AS symbol, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT symbol, round(greatest(coalesce(w, 0) + coalesce(n, 0), coalesce(w / 2, 0)), 6) AS hit_count, round(least(1e0, 1e-1 * coalesce(n, 0)), 6) AS relevance FROM s FULL JOIN h USING (symbol)""")
def seeded_weights(spark, d):
    """Symbol weights seeded from recency, raised by feedback and seeded again with less: hits add up and no seed takes any away."""
    items = table(spark, d, "lineitem")
    symbol = F.concat(F.lit("p"), "l_partkey").alias("symbol")
    seeds = items.where("l_returnflag = 'A'").select(symbol, (F.col("l_quantity") / 10).alias("weight"))
    hits = items.where("l_returnflag = 'R'").select(symbol, F.col("l_shipdate").alias("time"))
    none = spark.createDataFrame([], schemas.SYMBOL_WEIGHTS)
    at = F.lit("2024-02-01").cast("timestamp")
    weights = behaviour.with_hits(behaviour.with_seeds(none, seeds, at), hits)
    again = behaviour.with_seeds(weights, seeds.withColumn("weight", F.col("weight") / 2), at)
    return again.select("symbol", F.round("hit_count", 6).alias("hit_count"), F.round("relevance", 6).alias("relevance"))



@query("SELECT l_partkey AS id, round(ln(1 + n::DOUBLE) / ln(1 + (max(n) OVER ())::DOUBLE), 6) AS behaviour_score FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)")
def behaviour_score(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("id", F.round(scores.behaviour_score("n", "most"), 6).alias("behaviour_score"))


_PRUNE = "SELECT event_id AS id, (event_id % 10) / 10e0 AS importance, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000) AS days FROM events"


def _aged(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 10 / F.lit(10.0)).alias("importance"), F.col("ts").alias("created_at"))


@query(f"SELECT id, round(importance * exp(-1e-1 * days), 6) AS decay_score FROM ({_PRUNE}) WHERE importance * exp(-1e-1 * days) >= 15e-2")
def decay_prune(spark, d):
    return memory.prune(_aged(spark, d), _as_of())[0].select("id", F.round("decay_score", 6).alias("decay_score"))


@query(f"SELECT id FROM ({_PRUNE}) WHERE importance * exp(-1e-1 * days) < 5e-2")
def decay_archive(spark, d):
    return memory.prune(_aged(spark, d), _as_of(), aggressive=True)[1].select("id")


@query("""SELECT event_id::VARCHAR AS entry_id, round(4e-1 * least(greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000e0, 0) / 30, 1) + 3e-1 * (1 - (event_id % 10) / 10e0) + 3e-1 * least(greatest(user_id % 13 / 12e0, 0), 1), 6) AS priority
FROM events ORDER BY priority DESC, entry_id LIMIT 50""")
def cleanup_priority(spark, d):
    items = table(spark, d, "events").select(F.col("event_id").cast("string").alias("entry_id"), (F.col("event_id") % 10 / F.lit(10.0)).alias("importance"), F.col("ts").alias("suppressed_at"), (F.col("user_id") % 13 / F.lit(12.0)).alias("similarity"))
    return memory.pop_batch(memory.cleanup_queue(items, _as_of()), 50)[0].select("entry_id", "priority")


@query("SELECT round(avg(CASE WHEN vec_id % 17 = 3 OR vec_id % 13 = 5 THEN 1e0 ELSE 0e0 END), 6) AS dead_share, avg(CASE WHEN vec_id % 17 = 3 OR vec_id % 13 = 5 THEN 1e0 ELSE 0e0 END) >= 2e-1 AS rebuild FROM embeddings")
def dead_fraction(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 17 == 3).alias("deprecated"), (F.col("vec_id") % 13 == 5).alias("suppressed"))
    return memory.dead_share(rows).select(F.round("dead_share", 6).alias("dead_share"), "rebuild")


@query("SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings WHERE NOT (vec_id % 17 = 3)")
def index_compaction(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("vec_id").alias("old_id"), (F.col("vec_id") % 17 == 3).alias("deprecated"))
    return memory.compact(rows).select("old_id", F.col("row_id").cast("long").alias("row_id"))


@query("SELECT l_partkey AS row_id, arg_max(l_quantity, (l_orderkey, l_linenumber)) AS behaviour_score FROM lineitem GROUP BY l_partkey")
def latest_score_overlay(spark, d):
    updates = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row_id"), F.col("l_quantity").alias("score"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    base = updates.select("row_id").distinct().withColumn("behaviour_score", F.lit(0.0))
    return memory.latest_scores(base, updates).select("row_id", "behaviour_score")


_LEARN = "SELECT doc_id AS id, text, CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'project' END AS scope, doc_id % 400 AS days, coalesce(text, '') AS t FROM documents"
_SCORE = "round(7e-1 * (contains(lower(t), 'license')::INT + contains(lower(t), 'the')::INT + contains(lower(t), 'que')::INT + contains(lower(t), 'the')::INT) / 4 + 3e-1 / (1 + days), 6)"


def _learnings(spark, d):
    stamp = F.timestamp_micros(F.unix_micros(_as_of()) - (F.col("doc_id") % 400) * 86_400_000_000)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "global").otherwise("project").alias("scope"), stamp.alias("timestamp"), F.lit("decision").alias("type"))


@query(f"SELECT id, {_SCORE} AS score FROM ({_LEARN}) ORDER BY score DESC, id LIMIT 10")
def learning_retrieve(spark, d):
    return memory.retrieve(_learnings(spark, d), "license the que the", _as_of(), 10).select("id", "score")


@query(f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY {_SCORE} DESC, id) AS k FROM ({_LEARN})) WHERE k <= 5 ORDER BY days, id LIMIT 5")
def learning_scopes(spark, d):
    return memory.retrieve_scopes(_learnings(spark, d), "license the que the", _as_of(), 5).select("id")


@query(f"""SELECT id, round(o, 6) AS overlap FROM (SELECT id, scope, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(trim(t)), '\\s+'), lambda x: x <> '')), ['the', 'and', 'of', 'que', 'licensed'])) / 5e0 AS o FROM ({_LEARN}))
WHERE o > 3e-1 ORDER BY scope <> 'project', overlap DESC, id LIMIT 7""")
def learning_conflicts(spark, d):
    return memory.conflicts(_learnings(spark, d), "the and of que licensed", 7).select("id", "overlap")


_TEXTS = (
    "We made a mistake here", "root cause was a lock", "we decided to use parquet", "nothing to see", "fixed: the model preference", "always use tabs",
    "ADR: choose the broker", "An OUTAGE was reported", "going with plan b", "style guide", "", "bug fix for ai model",
)


def _values(texts) -> str:
    return ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(texts))


def _any(col: str, signals) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(col, s.replace("'", "''")) for s in signals) + ")"


_TYPE = f"CASE WHEN {_any('l', rules.CORRECTION)} THEN 'correction' WHEN {_any('l', rules.PROD_ISSUE)} THEN 'prod_issue' WHEN {_any('l', rules.DECISION)} THEN 'decision' END"


#: What some rows of a table say beside their own words, so that every rule meets texts of the table.
_SAYS = "SELECT doc_id AS id, substr(coalesce(text, ''), 1, 200) AS own, {} AS said FROM documents"


def _said(texts, key: str) -> str:
    return f"list_extract([{', '.join(_quoted(t) for t in texts)}], (({key}) % {len(texts)} + 1)::INT)"


def _quoted(text: str) -> str:
    return "'{}'".format(text.replace("'", "''"))


def _say(texts, key):
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))


@query(f"""SELECT id, type, CASE WHEN {_any('l', rules.GLOBAL_SCOPE)} OR (type = 'correction' AND {_any('l', rules.GLOBAL_CORRECTION)}) THEN 'global' ELSE 'project' END AS scope
FROM (SELECT id, l, {_TYPE} AS type FROM (SELECT id, lower(own || ' ' || said) AS l FROM ({_SAYS.format(_said(_TEXTS, 'doc_id'))})))""")
def learning_auto_tag(spark, d):
    """Learnings told from documents, each with a sentence that some rule may know."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit(" "), _say(_TEXTS, F.col("doc_id"))).alias("text"))
    return memory.tagged(rows).select("id", "type", "scope")


_QUESTIONS = (
    "why is the sky blue", "What does parse do", "how to fix it", "fix the build", "explain joins", "where is main", "refactor this", "add a cache", "implement a new caching layer",
    "x", "give me full context on this", "traceback in the worker at line 5", "compare hash join vs sort join performance", "list files", "does it work",
    "design and implement scalable authentication for our code in this repo", "show a_b c_d e_f x.py last time", "prune the index", "", "that",
)


def _questions(spark):
    return spark.createDataFrame(list(enumerate(_QUESTIONS)), "i int, text string")


def _case_types(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for p, n in rules.QUESTION_TYPES) + " ELSE 'other' END"


@query(f"SELECT question_type, count(*) AS n FROM (SELECT {_case_types('lower(trim(t))')} AS question_type FROM (SELECT t FROM (VALUES {_values(_QUESTIONS)}) v(i, t) UNION ALL SELECT text FROM conversations WHERE role = 'user')) GROUP BY question_type")
def question_types(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("text")
    return behaviour.question_types(_questions(spark).select("text").unionByName(asked))


def _hits(col: str, signals) -> str:
    return "(" + " + ".join("contains({}, '{}')::INT".format(col, s) for s in signals) + ")"


_CLASSIFY = f"""
WITH q AS (SELECT i, trim(t) AS t, lower(trim(t)) AS l, list_filter(string_split_regex(lower(trim(t)), '\\s+'), lambda x: x <> '') AS w FROM (SELECT conv_id || ':' || turn AS i, {_said(_QUESTIONS, 'conv_id + turn')} || CASE WHEN conv_id % 2 = 0 THEN ' ' || substr(coalesce(text, ''), 1, 120) ELSE '' END AS t FROM conversations)),
s AS (SELECT *, 3e0 * {_hits('l', rules.REASONING)} - 2e0 * {_hits('l', rules.LOOKUP)}
    + 2e0 * len(list_filter(range(1, len(w) + 1), lambda k: w[k] IN ('it', 'this', 'that', 'they', 'them') AND NOT (k > 1 AND regexp_matches(w[k - 1], '[a-zA-Z_]{{3,}}'))))
    + 15e-1 * greatest(len(list_distinct(list_filter(list_transform(string_split_regex(l, '[\\s,;:"''()\\[\\]{{}}]+'), lambda x: trim(x, '.')), lambda x: length(x) >= 2 AND ((contains(x, '_') AND regexp_full_match(replace(x, '_', ''), '[a-z]+')) OR regexp_matches(x, '\\.[a-z]{{1,4}}$'))))) - 2, 0)
    + 3e0 * {_any('l', rules.CONTEXT)}::INT + 5e-2 * greatest(len(w) - 20, 0) + 5e0 * {_any('l', rules.IMPERATIVE)}::INT AS score FROM q),
o AS (SELECT *, CASE WHEN len(w) <= 1 THEN 'single_token' WHEN regexp_matches(l, '\\b({rules.DOCS_WORDS})\\b') THEN 'docs_query' WHEN {_any('l', rules.FULL_CONTEXT)} THEN 'full_context_phrase' WHEN regexp_matches(l, '{rules.ERROR_TRACE.removeprefix("(?i)")}') THEN 'error_trace' END AS override FROM s)
SELECT i, override, CASE WHEN override IN ('single_token', 'docs_query') THEN 'QUICK' WHEN override = 'full_context_phrase' THEN 'EXPERT' WHEN override = 'error_trace' THEN CASE WHEN score >= 9 THEN 'EXPERT' ELSE 'COMPLEX' END
    WHEN score <= 2 THEN 'QUICK' WHEN score <= 4 THEN 'STANDARD' WHEN score <= 9 THEN 'COMPLEX' ELSE 'EXPERT' END AS tier,
    CASE WHEN override IN ('single_token', 'docs_query') THEN 0e0 WHEN override = 'full_context_phrase' THEN 20e0 ELSE round(score, 2) END AS score FROM o"""


@query(_CLASSIFY)
def classify_tier(spark, d):
    """Tiers of questions, alone or followed by what a conversation's turn says."""
    asked = F.concat(_say(_QUESTIONS, F.col("conv_id") + F.col("turn")), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 120))).otherwise(""))
    rows = table(spark, d, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("i"), asked.alias("text")).withColumn("x", rules.classify("text"))
    return rows.select("i", "x.override", "x.tier", "x.score")


@query("SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split_regex(lower(trim(text)), '\\s+'), lambda x: regexp_replace(regexp_replace(x, '^[.,;:!?\"''()\\[\\]{}]+', ''), '[.,;:!?\"''()\\[\\]{}]+$', '')), lambda x: length(x) > 3)) AS term FROM conversations WHERE role = 'user') GROUP BY term")
def terminology(spark, d):
    return behaviour.terminology(table(spark, d, "conversations").where("role = 'user'"))


@query("SELECT round(avg(length(text)), 6) AS mean, CASE WHEN avg(length(text)) > 120 THEN 'detailed' WHEN avg(length(text)) < 40 THEN 'concise' ELSE 'medium' END AS depth FROM (SELECT text FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC, text LIMIT 50)")
def preferred_depth(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'")
    return behaviour.preferred_depth(asked, [F.desc("conv_id"), F.desc("turn"), "text"]).select(F.round("mean", 6).alias("mean"), "depth")


_COMMITS = ("fix: broken join", "feat: add reader", "Revert: old plan", "docs only change", "this broke the build again", "perf: faster scan", "hotfix: x", "critical path security")


@query(f"""SELECT hash, type, text FROM (SELECT hash, CASE WHEN starts_with(l, 'fix:') OR starts_with(l, 'revert:') THEN 'bug' WHEN starts_with(l, 'decision:') OR starts_with(l, 'feat:') OR starts_with(l, 'perf:') THEN 'decision'
    WHEN starts_with(l, 'breaking:') OR starts_with(l, 'security:') OR starts_with(l, 'hotfix:') THEN 'prod_issue' WHEN regexp_matches(l, '\\b(broke|regression|critical|security|hotfix|revert)\\b') THEN 'prod_issue' END AS type,
    CASE WHEN regexp_matches(l, '^(fix|revert|decision|breaking|feat|perf|security|hotfix):') THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END AS text
FROM (SELECT hash, trim(t) AS t, lower(trim(t)) AS l FROM (SELECT 'h' || event_id AS hash, {_said(_COMMITS, 'event_id')} || ' ' || event_type || ' of ' || user_id AS t FROM events))) WHERE type IS NOT NULL AND length(text) >= 10""")
def commit_learnings(spark, d):
    """Learnings from the subjects of commits, one per event."""
    subject = F.concat(_say(_COMMITS, F.col("event_id")), F.lit(" "), "event_type", F.lit(" of "), "user_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("h"), "event_id").alias("hash"), subject.alias("message"))
    return behaviour.commit_learnings(rows)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 4")
def session_cap(spark, d):
    return memory.capped(table(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


@query("""WITH u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations)
SELECT conv_id, max(turn) AS turn, substr(arg_max((q, text), turn)[1], 1, 300) AS user, substr(arg_max((q, text), turn)[2], 1, 300) AS assistant FROM u WHERE role = 'assistant' GROUP BY conv_id""")
def last_exchange(spark, d):
    return memory.last_exchanges(table(spark, d, "conversations"))


@query(f"""SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY f DESC, CASE WHEN f THEN turn ELSE -length(text) END, turn) AS place
FROM (SELECT *, {_any('lower(text)', rules.CORRECTION)} AS f FROM conversations WHERE role = 'assistant' AND length(text) > 40)) WHERE place <= 3""")
def key_texts(spark, d):
    return memory.key_texts(table(spark, d, "conversations")).select("conv_id", "turn", "place")


@query("""SELECT conv_id, turn, user FROM (SELECT *, CASE WHEN lag(role) OVER w = 'user' THEN lag(text) OVER w END AS user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND length(text) >= 80 AND regexp_matches(text, '(ing|tion)\\b')""")
def session_seed(spark, d):
    return memory.seeds(table(spark, d, "conversations"), pattern=r"(ing|tion)\b").select("conv_id", "turn", "user")


@query("SELECT doc_id, chunk, text FROM (SELECT doc_id, chunk, array_to_string(list_slice(w, chunk * 200 + 1, chunk * 200 + 200), ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 200 + 1))::INT AS chunk FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)) WHERE length(text) >= 20")
def chunk_words(spark, d):
    return indexing.chunk_words(table(spark, d, "documents"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH c AS (SELECT doc_id::VARCHAR AS source, list_filter(flatten(list_transform(
    list_transform(string_split_regex(coalesce(text, ''), '(?m)^#{{2,}}\\s+'), lambda s: {_STRIP.format('s')}),
    lambda s: CASE WHEN length(s) <= 1800 THEN [s] ELSE string_split(list_reduce(
        list_filter(list_transform(string_split_regex(s, '\\n{{2,}}'), lambda p: {_STRIP.format('p')}), lambda p: p <> ''),
        lambda a, p: CASE WHEN length(list_last(string_split(a, chr(1)))) + 2 + length(p) <= 1800 THEN a || chr(10) || chr(10) || p ELSE a || chr(1) || p END), chr(1)) END)),
    lambda c: length(c) >= 60) AS l FROM documents)
SELECT source, i - 1 AS position, l[i] AS text FROM (SELECT source, l, unnest(range(1, len(l) + 1)) AS i FROM c)""")
def chunk_markdown(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return chunking.chunks(docs, count=None)


@query("SELECT least(1e0, least(length(t) / 100e0, 1e0) + 2e-1 * (contains(lower(t), 'bug')::INT + contains(lower(t), 'fix')::INT + contains(lower(t), 'error')::INT + contains(lower(t), 'important')::INT)) AS importance, i AS id FROM (SELECT doc_id AS i, coalesce(text, '') AS t FROM documents)")
def importance_score(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), scores.importance(F.coalesce("text", F.lit(""))).alias("importance"))


@query("""WITH r AS (SELECT n_name AS query, n_nationkey % 4 + 1 AS place, 'src/' || lower(n_name) || '.py' AS file FROM nation),
g AS (SELECT n_name AS query, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'none' END AS pat FROM nation),
b AS (SELECT g.query, min(CASE WHEN contains(r.file, g.pat) THEN place END) AS first, count(place) AS n FROM g LEFT JOIN r ON r.query = g.query GROUP BY g.query)
SELECT round(avg(coalesce(first <= 1, false)::INT), 6) AS recall_at_1, round(avg(CASE WHEN n > 0 THEN coalesce(first <= 1, false)::INT END), 6) AS precision_at_1,
       round(avg(coalesce(first <= 3, false)::INT), 6) AS recall_at_3, round(avg(CASE WHEN n > 0 THEN coalesce(first <= 3, false)::INT END), 6) AS precision_at_3 FROM b""")
def precision_recall(spark, d):
    nation = table(spark, d, "nation")
    results = nation.select(F.col("n_name").alias("query"), (F.col("n_nationkey") % 4 + 1).alias("place"), F.concat(F.lit("src/"), F.lower("n_name"), F.lit(".py")).alias("file"), F.lit("s").alias("symbol"))
    golden = nation.select(F.col("n_name").alias("query"), F.lit("t").alias("expected_symbol"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise("none").alias("expected_file_pattern"))
    return metrics.precision_recall(results, golden)


@query("""WITH x AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(v) FILTER (WHERE k = least(50 * n // 100, n - 1)) AS p50, max(v) FILTER (WHERE k = least(95 * n // 100, n - 1)) AS p95, max(v) FILTER (WHERE k = least(99 * n // 100, n - 1)) AS p99 FROM x GROUP BY l_returnflag""")
def percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "lineitem"), "l_extendedprice", group="l_returnflag")


_SYM = "SELECT 'd' || n_regionkey || '/f' || n_nationkey || '.py' AS file, n_name AS name FROM nation"


def _symbols(spark, d):
    path = F.concat(F.lit("d"), "n_regionkey", F.lit("/f"), "n_nationkey", F.lit(".py"))
    return table(spark, d, "nation").select(path.alias("file"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "CLASS").otherwise("FUNCTION").alias("type"), F.lit(1).alias("start_line"), F.col("n_nationkey").alias("end_line"), F.concat(F.lit("Doc of "), "n_name", F.lit(". More")).alias("docstring"))


@query(f"SELECT substr(file, 1, 2) AS dir, count(*) AS files, count(*) FILTER (WHERE name < 'M') AS symbols FROM ({_SYM}) GROUP BY 1")
def coverage(spark, d):
    symbols = _symbols(spark, d)
    files = symbols.select(F.col("file").alias("path")).distinct()
    return indexing.coverage(symbols.where("name < 'M'"), files)


@query("""SELECT 'd' || n_regionkey AS dir, count(*) AS file_count, coalesce(array_to_string(list(n_name ORDER BY 'd' || n_regionkey || '/f' || n_nationkey || '.py') FILTER (WHERE n_nationkey % 2 = 0), ','), '') AS classes, 'python' AS dominant_language FROM nation GROUP BY n_regionkey""")
def dir_rollup(spark, d):
    symbols = _symbols(spark, d)
    files = symbols.select(F.col("file").alias("path"), F.lit("python").alias("language"))
    return indexing.directory_summaries(indexing.file_summaries(symbols, files)).select("dir", "file_count", F.array_join("top_classes", ",").alias("classes"), "dominant_language")


@query("""SELECT path, '`' || path || '` — Doc of ' || n_name || '.' || CASE WHEN n_nationkey % 2 = 0 THEN '  Classes: ' ELSE '  Functions: ' END || n_name AS summary FROM (SELECT *, 'd' || n_regionkey || '/f' || n_nationkey || '.py' AS path FROM nation)""")
def file_summary(spark, d):
    symbols = _symbols(spark, d)
    files = symbols.select(F.col("file").alias("path"), F.lit("python").alias("language"))
    return indexing.file_summaries(symbols, files).select("path", "summary")


_REWRITE = ("where is parse_tree used", "fix it now", "auth flow", "show the overview of things", "list files")


_WORD = "lower(regexp_extract(coalesce(text, ''), '[a-zA-Z]{5,}'))"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORD} AS w FROM conversations WHERE regexp_matches(coalesce(text, ''), '[a-zA-Z]{{5,}}')),
q AS (SELECT conv_id || ':' || turn AS id, (conv_id + turn) % 5 AS kind, {_said(_REWRITE, 'conv_id + turn')} || ' ' || w AS query, w FROM w)
SELECT id, query, CASE kind WHEN 0 THEN 'HOT_SYMBOL' WHEN 1 THEN 'VAGUE_REF' WHEN 2 THEN 'TERMINOLOGY' WHEN 3 THEN 'PASSTHROUGH' ELSE 'DEPTH_SIGNAL' END AS method,
       CASE kind WHEN 0 THEN query || ' [parse_tree]' WHEN 1 THEN 'fix session_store now ' || w WHEN 2 THEN query || ' authentication' WHEN 3 THEN query ELSE query || ' [detailed]' END AS text FROM q""")
def enhance_query(spark, d):
    """Queries that end in a word of a conversation's turn, rewritten by the first rule that applies."""
    from ..operators import hybrid

    word = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[a-zA-Z]{5,}", 0))
    rows = table(spark, d, "conversations").where(word != "").select(F.concat("conv_id", F.lit(":"), "turn").alias("id"), F.concat(_say(_REWRITE, F.col("conv_id") + F.col("turn")), F.lit(" "), word).alias("query"))
    log = spark.createDataFrame([("what is session_store", 1), ("does this work", 2)], "query string, seq int")
    return hybrid.enhance(rows, ["a::parse_tree", "parse_tree"], log, ["authentication", "joins"], "detailed").select("id", "query", "method", "text")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, role = 'assistant' AS code, greatest(1, length(coalesce(text, '')) // 4) AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'assistant', turn) AS k FROM conversations),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 300::BIGINT AS room, 60::BIGINT AS docs, false AS stopped, false AS truncated, []::VARCHAR[] AS packed FROM r
    UNION ALL
    SELECT f.conv_id, r.k, f.room - CASE WHEN x.code_in OR x.doc_in THEN r.tokens ELSE 0 END, f.docs - CASE WHEN x.doc_in THEN r.tokens ELSE 0 END, f.stopped OR (r.code AND NOT x.code_in),
           f.truncated OR (r.code AND NOT x.code_in) OR (NOT r.code AND r.tokens <= f.docs AND NOT x.doc_in), CASE WHEN x.code_in OR x.doc_in THEN list_append(f.packed, r.turn::VARCHAR) ELSE f.packed END
    FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1, LATERAL (SELECT r.code AND NOT f.stopped AND r.tokens <= f.room AS code_in, NOT r.code AND r.tokens <= f.docs AND r.tokens <= f.room AS doc_in) x)
SELECT conv_id AS query_id, array_to_string(arg_max(packed, k), ',') AS packed, 300 - min(room) AS used, bool_or(truncated) AS truncated FROM f GROUP BY conv_id""")
def greedy_pack(spark, d):
    rows = table(spark, d, "conversations")
    bucket = F.when(F.col("role") == "assistant", "code").otherwise("doc")
    packed = rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), bucket.alias("bucket"), F.col("turn").alias("id"), T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = packing.pack(packed, 300)
    return found.select("query_id", F.array_join("packed", ",").alias("packed"), F.col("used").cast("long").alias("used"), "truncated")


@query("""SELECT doc_id, running_tokens FROM (SELECT doc_id, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM documents WHERE text IS NOT NULL) WHERE running_tokens <= 4000""")
def prefix_budget(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return packing.prefix_budget(rows, "source", ["doc_id"], 4000).select("doc_id", "running_tokens")


@query("SELECT event_type AS action, count(*) AS count, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen FROM events GROUP BY event_type")
def action_counters(spark, d):
    found = behaviour.action_counters(table(spark, d, "events").select(F.col("event_type").alias("action"), F.col("ts").alias("time")))
    return found.select("action", "count", _micros("first_seen").alias("first_seen"), _micros("last_seen").alias("last_seen"))


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id")
def preference_upsert(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("at"))
    return behaviour.latest(rows, "key", "at").select("key", "value")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming import streams

    return streams.event_counts(table(spark, d, "events")).select(_micros("start").alias("start"), "event_type", "n")
