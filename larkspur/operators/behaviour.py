"""Behaviour analytics: query log, feedback, co-edits, errors, profiles, recency seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scores
from . import ordered
from ..functions.text import whitespace_words


def terminology(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, n)``: words of more than three characters, stripped of punctuation."""
    words = F.transform(whitespace_words(text_col), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$""", ""))
    return queries.select(F.explode(F.filter(words, lambda w: F.length(w) > 3)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def last_n(rows: DataFrame, n: int, order: list, group: str | None = None) -> DataFrame:
    """The last ``n`` rows by ``order`` (latest first), of every group where one is named."""
    if group is None:
        return rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__p", place).where(F.col("__p") <= n).drop("__p")


def preferred_depth(queries: DataFrame, order: list, text_col: str = "text", n: int = 50) -> DataFrame:
    """One row: detailed above 120 characters on average over the last ``n`` queries, concise below 40, else medium."""
    mean = last_n(queries, n, order).agg(F.avg(F.length(text_col)).alias("mean"))
    return mean.select("mean", F.when(F.col("mean") > 120, "detailed").when(F.col("mean") < 40, "concise").otherwise("medium").alias("depth"))


def question_types(queries: DataFrame, text_col: str = "text") -> DataFrame:
    return queries.groupBy(rules.question_type(text_col).alias("question_type")).agg(F.count("*").alias("n"))


def feedback(history: DataFrame) -> DataFrame:
    """``(symbol, hit_count, relevance, last_hit)`` from useful queries."""
    hits = history.where("useful").select(F.explode("symbols").alias("symbol"), "time")
    return hits.groupBy("symbol").agg(F.count("*").alias("hit_count"), F.least(F.lit(1.0), F.lit(0.1) * F.count("*")).alias("relevance"), F.max("time").alias("last_hit"))


def with_hits(weights: DataFrame, hits: DataFrame) -> DataFrame:
    """Weights after useful queries ``(symbol, time)``: each row is a hit on top of what a symbol has, and a tenth more relevance."""
    new = hits.groupBy("symbol").agg(F.count("*").alias("__n"), F.max("time").alias("__at"))
    joined = weights.join(new, "symbol", "full_outer")
    n = F.coalesce("__n", F.lit(0))
    return joined.select("symbol", (F.coalesce("hit_count", F.lit(0.0)) + n).cast("double").alias("hit_count"), F.least(F.lit(1.0), F.coalesce("relevance", F.lit(0.0)) + F.lit(0.1) * n).alias("relevance"), F.greatest("last_hit", "__at").alias("last_hit"))


def with_seeds(weights: DataFrame, seeds: DataFrame, at) -> DataFrame:
    """Weights after seeding ``(symbol, weight)``: hits rise to a symbol's highest seed where they are fewer, and nothing else is lost."""
    new = seeds.groupBy("symbol").agg(F.max("weight").alias("__weight"))
    joined = weights.join(new, "symbol", "full_outer")
    hits = F.greatest(F.coalesce("hit_count", F.lit(0.0)), F.coalesce("__weight", F.lit(0.0)))
    return joined.select("symbol", hits.cast("double").alias("hit_count"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"), F.when(F.col("__weight").isNotNull(), at).otherwise(F.col("last_hit")).alias("last_hit"))


def hot_symbols(weights: DataFrame, k: int = 10) -> DataFrame:
    return weights.orderBy(F.desc("hit_count"), "symbol").limit(k)


def coedits(edits: DataFrame, session: str = "session", file: str = "file", seq: str = "seq") -> DataFrame:
    """``(file_a, file_b, n)``, both ways round: every edit counts against each other file touched before it in the session.

    The right side is one row per session and file, its first touch, so a file edited all day adds one partner, not many.
    """
    first = edits.groupBy(F.col(session).alias("s"), F.col(file).alias("b")).agg(F.min(seq).alias("first"))
    every = edits.groupBy(F.col(session).alias("s"), F.col(file).alias("a"), F.col(seq).alias("at")).agg(F.count("*").alias("times"))
    pairs = every.join(first, "s").where("a <> b and at > first").groupBy("a", "b").agg(F.sum("times").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy(F.col("a").alias("file_a"), F.col("b").alias("file_b")).agg(F.sum("n").alias("n"))


def useful_queries(queries: DataFrame, edits: DataFrame, minutes: int = 5, by: str = "user_id") -> DataFrame:
    """Queries with the first edit by the same user within ``minutes`` after them, null where there is none.

    Both sides are cut into time buckets of the window's length, so the interval join is an equi-join on user and bucket.
    """
    span = minutes * 60
    bucket = lambda c: F.floor(F.unix_seconds(c) / span)
    left = queries.withColumn("__b", F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) + 1)))
    right = edits.select(F.col(by), F.col("ts").alias("edit_ts"), F.col("file").alias("file_edited"), bucket(F.col("ts")).alias("__b"))
    hit = left.join(right, [by, "__b"]).where(F.col("edit_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")))
    first = hit.groupBy("query_id").agg(F.min(F.struct("edit_ts", "file_edited")).alias("x"))
    return queries.join(first, "query_id", "left").select("query_id", by, "ts", F.col("x.edit_ts").alias("edit_ts"), F.col("x.file_edited").alias("file_edited"), F.col("x").isNotNull().alias("useful"))


def error_patterns(errors: DataFrame, least: int = 1, recent: int = 5) -> DataFrame:
    """Per error type: count, files, last seen, signature, last occurrences and a hint."""
    place = F.row_number().over(Window.partitionBy("error_type").orderBy(F.desc("time"), F.desc("file"), F.desc("message")))
    last = errors.withColumn("__p", place).where(F.col("__p") <= recent).groupBy("error_type").agg(F.array_sort(F.collect_list(F.struct("time", "file", "message"))).alias("occurrences"))
    sums = errors.groupBy("error_type").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("file")).alias("files"), F.max("time").alias("last_seen"))
    found = sums.where(F.col("count") >= least).join(last, "error_type")
    signature = F.substring(F.md5(F.col("error_type").cast("binary")), 1, 8)
    return found.select("error_type", "count", "files", "last_seen", signature.alias("signature"), "occurrences", rules.error_hint("error_type").alias("hint")).orderBy(F.desc("count"), "error_type")


def profile(queries: DataFrame, hits: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: the most common question type, the ten most used terms and the share of symbols among hits."""
    kind = question_types(queries, text_col).orderBy(F.desc("n"), "question_type").limit(1).select(F.col("question_type").alias("top_question_type"))
    terms = terminology(queries, text_col).orderBy(F.desc("n"), "term").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "term"))).alias("x")).select(F.transform("x", lambda t: t["term"]).alias("top_terms"))
    focus = hits.agg(F.round(F.lit(100.0) * F.avg(F.col("symbol").contains("::").cast("double")), 1).alias("code_focus_pct"))
    row = kind.crossJoin(terms).crossJoin(focus)
    return row.withColumn("hints", F.concat_ws("; ", F.concat(F.lit("asks mostly: "), "top_question_type"), F.concat(F.lit("terms: "), F.array_join("top_terms", ", "))))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key: upserts of preferences, rewrites, scores."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def rewrites(rows: DataFrame, k: int = 100) -> DataFrame:
    """Query rewrites by lower-cased query: the latest wins, hits add up, the ``k`` most hit are kept."""
    each = rows.groupBy(F.lower("query").alias("query")).agg(F.max_by("rewrite", "time").alias("rewrite"), F.count("*").alias("hit_count"))
    return each.orderBy(F.desc("hit_count"), "query").limit(k)


def action_counters(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))


def style_summary(queries: DataFrame, order: list[str], every: int = 10) -> DataFrame:
    """One row per full block of ``every`` queries, in the order of columns: mean length and main question type."""
    numbered = ordered.numbered(queries, order).withColumn("block", F.floor((F.col("place") - 1) / every))
    sums = numbered.groupBy("block").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_length"), F.mode(rules.question_type("text"), True).alias("question_type"))
    return sums.where(F.col("n") == every)


def git_recency(commit_files: DataFrame, as_of) -> DataFrame:
    """``(path, weight)``: the highest recency weight of the commits that touched a file."""
    days = scores.days_between("time", as_of)
    return commit_files.groupBy("path").agg(F.max(scores.recency_weight(days)).alias("weight"))


def seed_symbols(recency: DataFrame, symbols: DataFrame) -> DataFrame:
    """Recency of files on to their symbols; files without any keep it themselves."""
    joined = recency.join(symbols.select(F.col("file").alias("path"), "name"), "path", "left")
    return joined.select(F.when(F.col("name").isNotNull(), F.concat("path", F.lit("::"), "name")).otherwise(F.col("path")).alias("symbol"), "weight").distinct()


def commit_learnings(commits: DataFrame, message_col: str = "message") -> DataFrame:
    found = commits.withColumn("x", rules.commit_learning(message_col)).where("x.type is not null")
    return found.select("hash", F.col("x.type").alias("type"), F.substring("x.text", 1, 400).alias("text")).where(F.length("text") >= 10)


def comment_learnings(lines: DataFrame) -> DataFrame:
    """Learnings from tagged comments of ``(file, n, line)``."""
    found = lines.withColumn("x", rules.comment_learning("line")).where("x.tag is not null")
    text = F.concat("x.tag", F.lit(" in "), "file", F.lit(":"), "n", F.lit(": "), "x.text")
    return found.select("file", "n", F.col("x.type").alias("type"), F.substring(text, 1, 400).alias("text"))


def diff_stats(patch_lines: DataFrame) -> DataFrame:
    """Added, removed and hunks per commit from ``(hash, line)`` of its patch."""
    line = F.col("line")
    return patch_lines.groupBy("hash").agg(
        F.count_if(line.startswith("+") & ~line.startswith("+++")).alias("added"),
        F.count_if(line.startswith("-") & ~line.startswith("---")).alias("removed"),
        F.count_if(line.startswith("@@")).alias("hunks"),
    )
