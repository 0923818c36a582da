"""Mixing sources to target weights by hash-threshold histograms, native operations only.

Targets share the words of the corpus by weight; a target stops at ``MAX_COPIES`` times its source, and what is left
over is shared again by weight.  A document is taken whole as often as its source's target holds the source; what the
target then still lacks, its budget, is filled by taking some documents once more.

Documents over ``1 / FINE`` of their source are at most ``FINE`` a source, so a fold over that short list settles them: by
falling size class, within a class by hash, each is taken or not so that the words taken stay nearest to the budget's share
of the words seen; what a long one leaves over or lacks, shorter ones make up for.  All others are taken below a threshold of their hash, which nested histograms find: words by source and the first 12
bits of the hash, then by the next 12 bits within the one bucket in which the budget ends, then by the full hash within
that.  The document at the threshold is taken if that is nearer to the target, so a source's taken words miss it by half
such a document at most.  Rows with equal hashes are repeats of one document; a last pair of histograms, over their row
numbers, takes as many of them as come nearest.  Nothing is sorted but histogram rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and what remains of it after the first and the second level.
HASH_BITS = 60
LEVELS = (48, 36)
FINE = 1024
#: Bits of a row number within one bucket of the histogram of repeated rows.
ROW_BITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, so any SQL engine can follow; null counts as ``null`` and as empty."""
    content = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(id.cast("string"), F.lit("null")), F.lit("|"), content)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Orders sources by code point and null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(skey, source_size, target)`` from rows ``(skey, size)``.

    Sources in the order of what a unit of weight may take at most are filled up first; the level of the rest follows.
    The windows below run over one row per source.
    """
    sums = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)
    weighed = sums.select("skey", "source_size", F.element_at(F.array(*map(F.lit, weights)), place + 1).alias("weight"), (F.col("source_size") * max_copies).cast("double").alias("cap"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = weighed.withColumn("level", level)
    # the first source that the level of those from it on does not fill has the level for all of them
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("q"), "skey", "level"))).over(everything)["level"])
    return ranked.select("skey", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _large(size: Column, source_size: Column) -> Column:
    return size * FINE > source_size


def _settle_large(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with the row numbers ``picks`` of its sources' large documents that are taken once more, and with what is
    left of the budget for the others, ``rest``."""
    large = sized.join(goal, "skey").where(_large(F.col("size"), F.col("source_size")))
    fallen = -F.length(F.bin("size"))
    large = large.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct(fallen.alias("fallen"), "h", "row", "size"))).alias("docs"), F.sum("size").alias("words"))
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("seen"), zero.alias("taken"), F.array().cast("array<bigint>").alias("picks"))
    found = goal.join(large, "skey", "left")

    def step(s: Column, doc: Column) -> Column:
        seen = s["seen"] + doc["size"]
        near = 2 * s["taken"] + doc["size"] < 2 * (F.col("budget") * seen / F.col("source_size"))
        taken, picks = s["taken"] + F.when(near, doc["size"]).otherwise(zero), F.when(near, F.array_append(s["picks"], doc["row"])).otherwise(s["picks"])
        return F.struct(seen.alias("seen"), taken.alias("taken"), picks.alias("picks"))

    found = found.withColumn("state", F.coalesce(F.aggregate("docs", state, step), state))
    others = F.col("source_size") - F.coalesce("words", zero)
    rest = F.greatest(F.lit(0.0), F.least(others.cast("double"), F.col("budget") - F.col("state.taken")))
    return found.select("skey", "source_size", "target", "whole", F.col("state.picks").alias("picks"), rest.alias("rest"))


def _boundary(rows: DataFrame, budgets: DataFrame, bucket: str) -> DataFrame:
    """Per source the bucket in which ``budget`` ends and the budget left for it; a source that stays within it has none."""
    words = rows.groupBy("skey", bucket).agg(F.sum("size").alias("words"), F.min("size").alias("least"))
    upto = Window.partitionBy("skey").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = words.withColumn("upto", F.sum("words").over(upto)).join(budgets, "skey").where("upto > budget")
    first = running.groupBy("skey").agg(F.min(F.struct(bucket, "least", (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))).alias("x"))
    return first.select("skey", f"x.{bucket}", "x.least", F.col("x.left").alias("budget"))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(skey, source_size, target, whole, picks, below, row_below)`` per source from rows ``(skey, size, h, row)``.

    Every document is taken ``whole`` times.  A large one is taken once more if its row is among ``picks``; any other if its
    hash is under ``below``, or equal to it and its row under ``row_below``.
    """
    goal = targets(sized, weights, max_copies)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_copies), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    budget = F.when(F.col("whole") >= max_copies, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialise(goal.withColumn("whole", whole).withColumn("budget", budget), "targets")
    goal = materialise(_settle_large(sized, goal), "large")
    rows = sized.join(goal.select("skey", "source_size"), "skey").where((F.col("size") > 0) & ~_large(F.col("size"), F.col("source_size"))).select("skey", "size", "h", "row")
    rows = rows.withColumn("b1", F.shiftright("h", LEVELS[0])).withColumn("b2", F.shiftright("h", LEVELS[1]))
    one = materialise(_boundary(rows, goal.select("skey", F.col("rest").alias("budget")), "b1"), "level1")
    two = materialise(_boundary(rows.join(one.select("skey", "b1"), ["skey", "b1"]), one.select("skey", "budget"), "b2"), "level2")
    three = materialise(_boundary(rows.join(two.select("skey", "b2"), ["skey", "b2"]), two.select("skey", "budget"), "h"), "level3")
    # repeats at the threshold: a row is taken if half of it fits
    ties = rows.join(three.select("skey", "h"), ["skey", "h"]).withColumn("b", F.shiftright("row", ROW_BITS))
    four = _boundary(ties, three.select("skey", (F.col("budget") + F.col("least") / 2).alias("budget")), "b")
    five = _boundary(ties.join(four.select("skey", "b"), ["skey", "b"]), four.select("skey", "budget"), "row")
    ends = three.select("skey", F.col("h").alias("below")).join(five.select("skey", F.col("row").alias("row_below")), "skey", "left")
    found = goal.join(ends, "skey", "left")
    none = F.lit(1 << HASH_BITS)
    return materialise(found.select("skey", "source_size", "target", "whole", "picks", F.coalesce("below", none).alias("below"), F.coalesce("row_below", F.lit((1 << 63) - 1)).alias("row_below")), "plan")


def _copied(rows: DataFrame, decided: DataFrame, size: str, h: str, row: str, skey: str, out: str) -> DataFrame:
    """``rows`` with the columns of ``decided`` but its picks, and how often each row is taken as ``out``."""
    slim = decided.drop("picks")
    both = rows.join(slim, rows[skey] == slim["skey"])
    large = _large(rows[size], slim["source_size"])
    below = (rows[h] < slim["below"]) | (rows[h] == slim["below"]) & (rows[row] < slim["row_below"])
    picked = decided.select(F.explode("picks").alias("picked"))
    some = both.where(large).join(picked, rows[row] == picked["picked"], "left")
    some = some.withColumn(out, slim["whole"] + picked["picked"].isNotNull().cast("int")).drop(picked["picked"])
    return both.where(~large).withColumn(out, slim["whole"] + below.cast("int")).unionByName(some)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row of ``docs``.

    A null text has no words; null sources are one source, the last.  Whole texts are counted, however long.  Rows with
    equal or null ids differ by their texts; repeated rows are taken up to as many as the target wants, which of them does
    not matter.  Other columns are ignored.  An empty table gives an empty result, one without words zeros.
    """
    id, text = F.col(id_col), F.col(text_col)
    sized = docs.select(id.cast("long").alias("id"), source_key(F.col(source_col)).alias("key"), word_count(text).alias("size"), row_hash(id, text).alias("h"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    decided = plan(sized.select(F.col("key").alias("skey"), "size", "h", "row"))
    return _copied(sized, decided, "size", "h", "row", "key", "n").select("id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``, whatever their names.

    Nulls, ties, repeated rows, empty and long texts as in ``mix``; documents without words go with their source's.
    """
    key, size, h, row, n = (f"__{name}_{uuid.uuid4().hex}" for name in ("key", "size", "h", "row", "n"))
    id, text = F.col(id_col), F.col(text_col)
    rows = docs.withColumns({key: source_key(F.col(source_col)), size: word_count(text), h: row_hash(id, text), row: F.monotonically_increasing_id()})
    rows = materialise(rows, "sized")
    decided = plan(rows.select(F.col(key).alias("skey"), F.col(size).alias("size"), F.col(h).alias("h"), F.col(row).alias("row")))
    decided = decided.select("skey", *(F.col(c) for c in decided.columns if c != "skey"))
    taken = _copied(rows, decided, size, h, row, key, n).where(F.col(n) > 0)
    return taken.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(rows[c] for c in docs.columns))
