"""Packing retrieved rows into a token budget, and the context bundle around it.

Packing is sequential by nature and bounded by its candidates, so a group's rows (a query's few dozen) are folded in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import token_estimate
from . import ordered

CODE_FIRST_SHARE, DOC_FIRST_SHARE = 0.2, 0.4
BUNDLE_BUDGETS = {"STANDARD": 6_000, "COMPLEX": 12_000, "EXPERT": 24_000}


def pack(candidates: DataFrame, budget: int, doc_share: float = CODE_FIRST_SHARE, group: str = "query_id") -> DataFrame:
    """``(query_id, packed, used, truncated)`` from ``(query_id, place, bucket, id, tokens)``.

    Code comes first and stops at the first row that does not fit; documents follow, one over their share of the budget is
    skipped, one over what is left is skipped and marks the result as truncated.
    """
    state = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(int(budget * doc_share)).cast("long").alias("docs"), F.lit(False).alias("stopped"), F.lit(False).alias("truncated"), F.array().cast("array<string>").alias("packed"))

    def step(s, x):
        code = x["bucket"] == "code"
        fits_code = code & ~s["stopped"] & (x["tokens"] <= s["left"])
        in_share = ~code & (x["tokens"] <= s["docs"])
        fits_doc = in_share & (x["tokens"] <= s["left"])
        take = fits_code | fits_doc
        return F.struct(
            (s["left"] - F.when(take, x["tokens"]).otherwise(F.lit(0))).cast("long").alias("left"),
            (s["docs"] - F.when(fits_doc, x["tokens"]).otherwise(F.lit(0))).cast("long").alias("docs"),
            (s["stopped"] | (code & ~fits_code)).alias("stopped"),
            (s["truncated"] | (code & ~fits_code) | (in_share & ~fits_doc)).alias("truncated"),
            F.when(take, F.array_append(s["packed"], x["id"])).otherwise(s["packed"]).alias("packed"),
        )

    order = F.array_sort(F.collect_list(F.struct((F.col("bucket") != "code").alias("late"), "place", "bucket", F.col("id").cast("string").alias("id"), F.col("tokens").cast("long").alias("tokens"))))
    rows = candidates.groupBy(group).agg(order.alias("rows"))
    folded = rows.select(group, F.aggregate("rows", state, step).alias("s"))
    return folded.select(group, F.col("s.packed").alias("packed"), (F.lit(budget) - F.col("s.left")).alias("used"), F.col("s.truncated").alias("truncated"))


def with_tokens(rows: DataFrame, text_col: str = "text", vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """``rows`` with the token count of a text, null counting as empty.

    ``vocabulary`` is a file that every executor can read (``.json`` of tokenizers, ``.model`` of sentencepiece) and gives exact
    counts; without it a token is a quarter of a character run, one at least.
    """
    if vocabulary is None:
        return rows.withColumn(out, token_estimate(F.coalesce(F.col(text_col), F.lit(""))))
    where = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            counts = [count(t or "") for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, LongType())]))


def _counter(vocabulary: str) -> Callable[[str], int]:
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda text: len(model.encode(text))
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(vocabulary)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: len(whole.encode(text, add_special_tokens=False))


def prefix_budget(rows: DataFrame, group: str, order: list, budget: int, text_col: str = "text") -> DataFrame:
    """Rows of each group in order until their tokens exceed the budget."""
    run = F.sum(token_estimate(text_col)).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_tokens", run).where(F.col("running_tokens") <= budget)


def trim_bundle(parts: DataFrame, tier: str = "COMPLEX") -> DataFrame:
    """Parts ``(kind, place, text)`` of a context bundle within the tier's budget: episodes go first, then graph, then memories."""
    keep = F.when(F.col("kind") == "memory", 0).when(F.col("kind") == "graph", 1).otherwise(2)
    run = ordered.running_sum(parts.withColumn("__keep", keep), ["__keep", "place"], token_estimate("text", 0), "running_tokens")
    return run.where(F.col("running_tokens") <= BUNDLE_BUDGETS.get(tier, BUNDLE_BUDGETS["COMPLEX"])).drop("__keep")
