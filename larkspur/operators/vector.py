"""Vector search: exact nearest neighbours by distance or cosine, thresholds, groups, novelty, suppression.

A query is a literal array, so a search is one scan, a projection and ``TakeOrderedAndProject``; filters stand below the
top-k.  Many queries against many rows go through ``knn_join``, which multiplies blocks in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import col
from ..session import written


class Embedder(Protocol):
    """Turns texts into vectors; given by the caller, as no model is bundled."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Deterministic bag-of-words vectors, for tests and as a default."""
    import zlib

    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            row[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def _in_time(embedder: Embedder, texts: list[str], patience: float) -> np.ndarray | None:
    """What the embedder returns, or None where it takes too long; its thread is left behind and ends by itself."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(embedder, texts).result(patience)
    except TimeoutError:
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def embed(df: DataFrame, text_col: str, embedder: Embedder = hashing_embedder, out_col: str = "embedding", batch: int = 256, patience: float | None = None, fallback: Embedder | None = None) -> DataFrame:
    """Add vectors of a text column in Arrow batches.

    A batch that takes longer than ``patience`` seconds gets the vectors of ``fallback``, or null ones without it.
    """
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [t or "" for t in part.column(where).to_pylist()]
                vectors = embedder(texts) if patience is None else _in_time(embedder, texts, patience)
                if vectors is None and fallback is not None:
                    vectors = fallback(texts)
                made = [None] * len(texts) if vectors is None else list(vectors.astype(np.float32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.float32()))], [*part.schema.names, out_col])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{out_col} array<float>"]))


def live(memories: DataFrame) -> DataFrame:
    """Rows neither deprecated nor suppressed; absent flags count as false."""
    for flag in ("deprecated", "suppressed"):
        if flag in memories.columns:
            memories = memories.where(~F.coalesce(F.col(flag), F.lit(False)))
    return memories


def of_source(memories: DataFrame, source: str | None, column: str = "source") -> DataFrame:
    """Rows of one source; a null source counts as ``memory``."""
    return memories if source is None else memories.where(F.coalesce(F.col(column), F.lit("memory")) == source)


def knn(rows: DataFrame, query: list[float], k: int = 5, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """The ``k`` rows nearest by squared distance, with ``d2`` and ``score``; ties by id."""
    near = rows.withColumn("d2", scores.squared_l2(vector_col, scores.doubles(query)))
    return near.orderBy("d2", id_col).limit(max(k, 0)).withColumn("score", F.round(scores.similarity("d2"), 4))


def knn_scored(rows: DataFrame, query: list[float], k: int = 5, vector_col: str = "embedding", id_col: str = "row_id", behaviour_col: str = "behaviour_score") -> DataFrame:
    """``knn`` with the blend of similarity and behaviour; the order stays by distance."""
    return knn(rows, query, k, vector_col, id_col).withColumn("combined", scores.combined("d2", behaviour_col))


def knn_cosine(rows: DataFrame, query: list[float], k: int = 5, vector_col: str = "embedding", id_col: str = "row_id", least: float | None = None) -> DataFrame:
    """The ``k`` rows of highest cosine, above ``least`` where given."""
    scored = rows.withColumn("cosine", scores.cosine(vector_col, scores.doubles(query)))
    if least is not None:
        scored = scored.where(F.col("cosine") > least)
    return scored.orderBy(F.desc("cosine"), id_col).limit(k)


def knn_inner(rows: DataFrame, query: list[float], k: int = 5, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    return rows.withColumn("inner", scores.dot(vector_col, scores.doubles(query))).orderBy(F.desc("inner"), id_col).limit(k)


def knn_per_group(rows: DataFrame, query: list[float], group_col: str, k: int = 5, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """The ``k`` nearest of every group; Catalyst limits each task's groups before the shuffle."""
    near = rows.withColumn("d2", scores.squared_l2(vector_col, scores.doubles(query)))
    place = F.row_number().over(Window.partitionBy(group_col).orderBy("d2", id_col))
    return near.withColumn("place", place).where(F.col("place") <= k)


def knn_distinct(rows: DataFrame, query: list[float], k: int, key_cols: list[str], weight_col: str, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """Of the ``2k`` nearest the best of every key, scored by similarity times weight, in order of distance."""
    near = knn(rows, query, 2 * k, vector_col, id_col)
    first = F.row_number().over(Window.partitionBy(*key_cols).orderBy("d2", id_col))
    kept = near.withColumn("first", first).where("first = 1").drop("first")
    return kept.withColumn("vector_score", scores.similarity("d2") * F.coalesce(F.col(weight_col), F.lit(1.0))).orderBy("d2", id_col).limit(k)


#: Queries multiplied with a block of rows at a time, and numbers of exact distances held at once.
SLICE, EXACT = 128, 1 << 22


def _nearest(table: pa.Table, k: int) -> pa.Table:
    """The ``k`` rows (side 1) nearest to each query (side 0) of one pair of blocks."""
    side, ids = table["side"].to_numpy(), table["id"].to_numpy()
    vectors = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = b[np.argsort(ids[b], kind="stable")]
    held, size = vectors[b], (vectors[b] ** 2).sum(1)
    most = np.nan_to_num(size).max(initial=0)
    out: list[list] = [[], [], []]
    for at in range(0, len(a) if len(b) and k > 0 else 0, SLICE):
        some = vectors[a[at : at + SLICE]]
        own = (some**2).sum(1)
        d2 = some @ held.T
        d2 *= -2
        d2 += size
        d2 += own[:, None]
        d2[np.isnan(d2)] = np.inf
        last = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(some), np.inf)
        i, j = np.nonzero(d2 <= (last + 1e-9 * (np.nan_to_num(own) + most))[:, None])
        del d2
        step = max(1, EXACT // max(1, some.shape[1]))
        exact = np.concatenate([np.cumsum((some[i[x : x + step]] - held[j[x : x + step]]) ** 2, axis=1)[:, -1] for x in range(0, len(i), step)])
        order = np.lexsort((j, exact, i))
        first = np.searchsorted(i, np.arange(len(some)))  # ``i`` ascends
        keep = order[np.arange(len(i)) - first[i] < k]
        for x, y in zip(out, (ids[a[at + i[keep]]], ids[b[j[keep]]], exact[keep]), strict=True):
            x.append(y)
    whole = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.table({"query_id": pa.array(whole[0].astype(np.int64)), "row_id": pa.array(whole[1].astype(np.int64)), "d2": pa.array(whole[2].astype(np.float64))})


def knn_join(queries: DataFrame, rows: DataFrame, k: int, vector_col: str = "embedding", id_col: str = "row_id", query_id: str = "query_id", block: int = 2048) -> DataFrame:
    """``(query_id, row_id, d2, place)``: the ``k`` nearest rows of every query, ties by id.

    Both sides are cut into blocks by a hash of their ids and every pair of blocks is multiplied in one task, some queries at
    a time, which keeps ``k`` per query; a window then keeps ``k`` over all blocks.  A product only says which rows may be among
    the ``k``: those have their distances summed exactly, so copies of a vector tie.  A task holds two blocks and one slice of
    their product, whatever the number of rows.  Copies of a block grow with the other side's blocks.
    """
    n_queries = -(-max(1, queries.count()) // block)
    n_rows = -(-max(1, rows.count()) // (8 * block))
    kind = "array<float>" if {df.schema[vector_col].dataType.simpleString() for df in (queries, rows)} == {"array<float>"} else "array<double>"
    left = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.lit(0).alias("side"), F.pmod(F.xxhash64(query_id), F.lit(n_queries)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"))
    right = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), F.pmod(F.xxhash64(id_col), F.lit(n_rows)).cast("int").alias("r"))
    both = left.select("q", "r", "side", "id", "v").unionByName(right.select("q", "r", "side", "id", "v"))

    found = both.groupBy("q", "r").applyInArrow(lambda table: _nearest(table, k), "query_id long, row_id long, d2 double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "row_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


#: Pivots of a join within a radius at most, and rows and queries of one block.
PIVOTS, NEAR_ROWS, NEAR_QUERIES = 1024, 16_384, 2048


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)[None]
    return np.sqrt(np.maximum(d2, 0))


def near_join(queries: DataFrame, rows: DataFrame, radius: float, vector_col: str = "embedding", id_col: str = "row_id", query_id: str = "query_id") -> DataFrame:
    """``(query_id, row_id, d2)``: all pairs no further apart than ``radius``, without looking at all pairs.

    Rows are listed under the nearest of some pivots, which are rows themselves, and within a list by rings of their distance
    to it.  By the triangle inequality a row near a query lies in a ring within ``radius`` of the query's own distance to the
    pivot, and under a pivot that is no more than twice the radius further from the query than the nearest.  Only those
    rings are looked at, in blocks of bounded size on both sides.  Null vectors are near nothing.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    number = int(min(PIVOTS, max(1, round(held.count() ** 0.5))))
    found = [r["v"] for r in held.orderBy(F.xxhash64("id"), "id").limit(number).select("v").collect()]  # PIVOTS vectors at most
    if not found:
        return spark.createDataFrame([], "query_id long, row_id long, d2 double")
    pivots, slack = np.array(found, np.float64), 1e-6
    width = max(radius / 2, slack)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                far = _distances(np.array(part.column(1).to_pylist(), np.float64), pivots)
                best = far.argmin(1)
                ring = np.floor(far[np.arange(len(best)), best] / width)
                yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(ring.astype(np.int32)), part.column(0), part.column(1)], ["list", "ring", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                far = _distances(np.array(part.column(1).to_pylist(), np.float64), pivots)
                low = np.floor(np.maximum(far - radius - slack, 0) / width).astype(np.int32)
                high = np.floor((far + radius + slack) / width).astype(np.int32)
                q, c = np.nonzero(far <= far.min(1)[:, None] + 2 * radius + slack)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(low[q, c]), pa.array(high[q, c]), part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q))], ["list", "low", "high", "id", "v"])

    placed = written(held.mapInArrow(place, "list int, ring int, id long, v array<double>"), "placed")
    sizes = placed.groupBy("list", "ring").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / NEAR_ROWS).cast("int"))
    # a query goes to the rings that have rows
    probes = asked.mapInArrow(probe, "list int, low int, high int, id long, v array<double>").select("list", F.explode(F.sequence("low", "high")).alias("ring"), "id", "v")
    wanted = written(probes.join(sizes, ["list", "ring"]).select("list", "ring", "blocks", "id", "v"), "probes")
    parts = wanted.groupBy("list", "ring").agg(F.ceil(F.count("*") / NEAR_QUERIES).cast("int").alias("parts"))
    left = wanted.join(parts, ["list", "ring"]).select("list", "ring", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"), F.lit(0).alias("side"), "id", "v")
    both = sizes.join(parts, ["list", "ring"])
    right = placed.join(both, ["list", "ring"]).select("list", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("r"), F.lit(1).alias("side"), "id", "v")

    def near(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        vectors = np.array(table["v"].to_pylist(), np.float64)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[list] = [[], [], []]
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            i, j = np.nonzero(_distances(vectors[some], vectors[b]) <= radius + slack) if len(b) else (np.zeros(0, int), np.zeros(0, int))
            exact = ((vectors[some][i] - vectors[b][j]) ** 2).sum(1)
            keep = exact <= radius * radius
            for x, y in zip(out, (ids[some][i][keep], ids[b][j][keep], exact[keep]), strict=True):
                x.append(y)
        whole = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(whole[0].astype(np.int64)), "row_id": pa.array(whole[1].astype(np.int64)), "d2": pa.array(whole[2].astype(np.float64))})

    return left.unionByName(right).groupBy("list", "ring", "q", "r").applyInArrow(near, "query_id long, row_id long, d2 double")


def _radius(above: float) -> float:
    """How far apart vectors of at least that similarity are."""
    return float(np.sqrt(2 * max(1 - above, 0))) * (1 + 1e-9)


def novel(candidates: DataFrame, store: DataFrame, above: float = scores.NOVEL_ABOVE, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """Candidates that no stored vector but their own row is more similar to than ``above``."""
    near = near_join(candidates.withColumnRenamed(id_col, "query_id"), store, _radius(above), vector_col, id_col)
    known = near.where((scores.similarity("d2") > above) & (F.col("query_id") != F.col("row_id"))).select(F.col("query_id").alias(id_col)).distinct()
    return candidates.join(known, id_col, "left_anti")


def suppressed_by(candidates: DataFrame, store: DataFrame, above: float = scores.SUPPRESS_ABOVE, k: int = 5, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """``(row_id, by, similarity)``: stored rows to suppress as near-copies of a new one, which may be stored itself.

    Among a candidate's ``k`` nearest other rows, those more similar than ``above``, unless they were found automatically
    and are at least as important as the candidate.
    """
    near = near_join(candidates.withColumnRenamed(id_col, "query_id"), store, _radius(above), vector_col, id_col).where("query_id <> row_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "row_id"))
    top = near.withColumn("similarity", scores.similarity("d2")).where(F.col("similarity") > above).withColumn("place", place).where(F.col("place") <= k)
    new = candidates.select(F.col(id_col).alias("query_id"), F.col("importance").alias("new_importance"))
    old = store.select(F.col(id_col).alias("row_id"), "importance", "source")
    found = top.join(new, "query_id").join(old, "row_id")
    spared = (F.coalesce(F.col("source"), F.lit("")) == "auto_discovery") & (F.col("importance") >= F.col("new_importance"))
    return found.where(~spared).select("row_id", F.col("query_id").alias("by"), "similarity")


def greedy_novel(candidates: DataFrame, group_col: str, above: float = scores.NOVEL_ABOVE, vector_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """Ids kept when rows of a group arrive in id order and each must be novel against those kept before it."""

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        vectors, ids, kept = np.array(table[vector_col].to_pylist(), np.float64), table[id_col].to_pylist(), []
        for i in range(len(ids)):
            if not kept or (1 - ((vectors[kept] - vectors[i]) ** 2).sum(1) / 2).max() <= above:
                kept.append(i)
        return pa.table({id_col: pa.array([ids[i] for i in kept], pa.int64())})

    return candidates.select(group_col, F.col(id_col).cast("long").alias(id_col), vector_col).groupBy(group_col).applyInArrow(keep, f"{id_col} long")


def similarity_column(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """The distance or similarity of two vector columns by name: ``l2`` (squared), ``cosine`` or ``inner``."""
    return {"l2": scores.squared_l2, "cosine": scores.cosine, "inner": scores.dot}[metric](col(a), col(b))
