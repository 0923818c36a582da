"""Which of many patterns does each of many texts hold?  By grams and an equi-join, without comparing all with all.

A text that holds a pattern holds each of its grams, so a pattern stands for the one of its grams that the fewest texts
hold, and only texts with that gram are looked at.  Grams have three characters, or as many as a shorter pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct grams of ``n`` characters; a text is cut into characters once, so long texts cost their length."""
    marks = F.split(text, "")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    found = F.transform(starts, lambda i: F.array_join(F.slice(marks, i, F.lit(n)), ""))
    return F.when(F.length(text) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", pattern_col: str = "pattern") -> DataFrame:
    """Distinct ``(id, pattern)`` where the text of ``texts(id, text)`` holds the pattern, as written.

    Null texts and patterns hold nothing and are held by none; an empty pattern is held by every text that is not null.
    """
    some = patterns.select(F.col(pattern_col).alias("pattern")).where("pattern is not null").distinct()
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sized = some.where("pattern <> ''").withColumn("n", F.least(F.length("pattern"), F.lit(GRAM)))
    sizes = [r["n"] for r in sized.select("n").distinct().collect()]  # 1, 2 and 3 at most
    empty = None if some.where("pattern = ''").isEmpty() else rows.select("id", F.lit("").alias("pattern")).distinct()
    if not sizes:
        return empty if empty is not None else rows.select("id", F.lit("").alias("pattern")).limit(0)
    each = F.flatten(F.array(*[_grams(F.col("text"), n) for n in sorted(sizes)]))
    held = written(rows.withColumn("__row", F.monotonically_increasing_id()), "texts")
    grams = held.select("__row", F.explode(each).alias("gram"))
    own = sized.select("pattern", F.explode(F.when(F.col("n") == GRAM, _grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))).alias("gram"))
    asked = grams.join(own.select("gram").distinct(), "gram", "left_semi")
    counts = asked.groupBy("gram").agg(F.count("*").alias("texts"))
    rare = own.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("texts", "gram"))
    key = rare.withColumn("place", place).where("place = 1 and texts > 0").select("gram", "pattern")
    pairs = asked.join(key, "gram").select("__row", "pattern").join(held, "__row").where(F.contains("text", "pattern")).select("id", "pattern").distinct()
    return pairs if empty is None else pairs.unionByName(empty)
