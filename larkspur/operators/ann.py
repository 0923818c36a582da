"""Approximate nearest neighbours: inverted lists around centroids, exact distances within the lists that a search reads.

Centroids are fitted on at most ``SAMPLE`` vectors (smallest hashes of their ids); every row is indexed.  How many lists a
search must read for the wanted recall is measured against brute force on the sample, and is stored with the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector

SAMPLE = 20_000
MOST_LISTS = 4_096
QUERIES = 200
ROUNDS = 8


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids of every vector, nearest first."""
    return np.argsort((centroids**2).sum(1)[None] - 2 * vectors @ centroids.T, axis=1, kind="stable")


def _fit(sample: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(sample, centroids)[:, 0]
        for c in np.unique(own):
            centroids[c] = sample[own == c].mean(axis=0)
    return centroids


def _probes(sample: np.ndarray, centroids: np.ndarray, target: float, k: int) -> int:
    """Lists to read so that on average ``target`` of the ``k`` nearest of a sampled query are in them."""
    queries = sample[: min(QUERIES, len(sample))]
    own, order = _nearest(sample, centroids)[:, 0], _nearest(queries, centroids)
    rank = np.argsort(order, axis=1)
    d2 = (sample**2).sum(1)[None] - 2 * queries @ sample.T
    near = np.argsort(d2, axis=1, kind="stable")[:, : min(k, len(sample))]
    need = np.take_along_axis(rank, own[near], axis=1)
    recall = [(need <= p).mean() for p in range(len(centroids))]
    return next(p for p, r in enumerate(recall, 1) if r >= target)


class AnnIndex:
    """An index in a folder: rows with their list, sorted by it, and one row of centroids and probes."""

    def __init__(self, spark: SparkSession, path: str, vector_col: str = "embedding", id_col: str = "row_id") -> None:
        self.spark, self.path, self.vector_col, self.id_col = spark, path.rstrip("/"), vector_col, id_col
        self._meta: tuple[np.ndarray, int] | None = None

    @classmethod
    def build(cls, rows: DataFrame, path: str, vector_col: str = "embedding", id_col: str = "row_id", target: float = 0.97, k: int = 10) -> AnnIndex:
        """Index every row of ``rows`` whose vector is not null; all columns stay for filters."""
        index, spark = cls(rows.sparkSession, path, vector_col, id_col), rows.sparkSession
        known = rows.where(F.col(vector_col).isNotNull())
        drawn = known.select(F.col(vector_col).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h"), id_col).orderBy("h", id_col).limit(SAMPLE)
        sample = np.array([r["v"] for r in drawn.collect()], np.float64)  # SAMPLE rows at most
        centroids, probes = np.zeros((1, 1)), 1
        if len(sample):
            centroids = _fit(sample, max(1, min(MOST_LISTS, int(known.count() ** 0.5))))
            probes = _probes(sample, centroids, target, k)
        meta = spark.createDataFrame([(centroids.tolist(), probes)], "centroids array<array<double>>, probes int")
        meta.write.mode("overwrite").parquet(f"{index.path}/meta")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = np.array(batch.column(batch.schema.get_field_index(vector_col)).to_pylist(), np.float64)
                lists = _nearest(vectors, centroids)[:, 0] if len(vectors) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32())], [*batch.schema.names, "__list"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
        listed = known.mapInArrow(assign, f"{fields}, __list int")
        listed.repartitionByRange("__list", id_col).sortWithinPartitions("__list", id_col).write.mode("overwrite").parquet(f"{index.path}/rows")
        return index

    def _loaded(self) -> tuple[np.ndarray, int]:
        if self._meta is None:
            row = self.spark.read.parquet(f"{self.path}/meta").first()
            self._meta = np.array(row["centroids"], np.float64), row["probes"]
        return self._meta

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, query: list[float], k: int = 5, where: Column | None = None) -> DataFrame:
        """The ``k`` nearest rows found, of those that satisfy ``where``: it is applied before the top-k.

        Where the lists read hold fewer than ``k`` such rows, all rows are searched.
        """
        centroids, probes = self._loaded()
        rows = self.rows() if where is None else self.rows().where(where)
        if centroids.shape[1] == len(query):
            lists = _nearest(np.array([query], np.float64), centroids)[0, :probes].tolist()
            some = rows.where(F.col("__list").isin(lists))
            if some.limit(k).count() == k:
                rows = some
        return vector.knn(rows.drop("__list"), query, k, self.vector_col, self.id_col)
