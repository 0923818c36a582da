"""Retrieval quality and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def precision_recall(results: DataFrame, golden: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Per ``k`` the share of golden queries with a hit among the first ``k`` results: over all queries (recall) and over
    those with any result (precision).

    ``results(query, place, file, symbol)``; a hit names the symbol or a file that holds the pattern.
    """
    hit = (F.col("symbol") == F.col("expected_symbol")) | F.contains("file", "expected_file_pattern")
    joined = golden.join(results, "query", "left")
    best = joined.groupBy("query").agg(F.min(F.when(F.coalesce(hit, F.lit(False)), F.col("place"))).alias("first"), F.count("place").alias("n"))
    cols = []
    for k in ks:
        found = F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")
        cols += [F.round(F.avg(found), 6).alias(f"recall_at_{k}"), F.round(F.avg(F.when(F.col("n") > 0, found)), 6).alias(f"precision_at_{k}")]
    return best.agg(*cols)


def percentiles(rows: DataFrame, value_col: str, ps: tuple[int, ...] = (50, 95, 99), group: str | None = None) -> DataFrame:
    """Order statistics at position ``int(p / 100 * n)``, clamped.

    Values are counted first, so ranks come from a running sum over distinct values per group.
    """
    if not group:
        counts = rows.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count("*").alias("n"))
        ranked = ordered.running_sum(counts, [value_col]).crossJoin(F.broadcast(rows.agg(F.count(value_col).alias("total"))))
        return ranked.agg(*[F.min(F.when(F.col("upto") > _at(p), F.col(value_col))).alias(f"p{p}") for p in ps])
    key = [group]
    counts = rows.where(F.col(value_col).isNotNull()).groupBy(*key, value_col).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*key)
    ranked = counts.withColumn("upto", F.sum("n").over(part.orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(part))
    picks = [F.min(F.when(F.col("upto") > _at(p), F.col(value_col))).alias(f"p{p}") for p in ps]
    return ranked.groupBy(*key).agg(*picks)


def _at(p: int) -> Column:
    return F.least(F.floor(F.lit(p) * F.col("total") / 100), F.col("total") - 1)


def token_reduction(queries: DataFrame) -> DataFrame:
    """Mean share of tokens saved from ``(baseline_tokens, packed_tokens)``; queries without a baseline don't count."""
    saved = F.when(F.col("baseline_tokens") > 0, F.lit(1.0) - F.col("packed_tokens") / F.col("baseline_tokens"))
    return queries.agg(F.round(F.lit(100.0) * F.avg(saved), 2).alias("reduction_pct"), F.count(saved).alias("queries"))


def session_brief(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, hot: DataFrame, n: int = 5) -> DataFrame:
    """``(section, place, item)``: sizes, recent decisions, entry points and hot symbols."""
    from . import graph

    place = lambda *o: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*o))
    sizes = graph.stats(nodes, edges).select(F.lit("graph").alias("section"), F.lit(1).alias("place"), F.concat_ws(" ", "nodes", F.lit("nodes,"), "edges", F.lit("edges")).alias("item"))
    made = decisions.orderBy(F.desc("timestamp"), "id").limit(n).select(F.lit("decisions").alias("section"), place(F.desc("timestamp"), "id").alias("place"), F.substring("text", 1, 200).alias("item"))
    entry = graph.entry_nodes(edges, n).select(F.lit("entry points").alias("section"), place(F.desc("in_degree"), "node").alias("place"), F.col("node").alias("item"))
    top = hot.orderBy(F.desc("hit_count"), "symbol").limit(n).select(F.lit("hot symbols").alias("section"), place(F.desc("hit_count"), "symbol").alias("place"), F.col("symbol").alias("item"))
    return sizes.unionByName(made).unionByName(entry).unionByName(top)


def health(**stores: DataFrame) -> DataFrame:
    """``(store, n)`` of every named store."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n") for name, df in stores.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
