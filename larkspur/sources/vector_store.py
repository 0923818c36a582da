"""A vector store: appended rows, an overlay log of score updates and tombstones, and compaction.

Point changes are rows of small logs that reads fold in; ``compact`` writes them into the base rows once the dead share
or the log calls for it.  A row's vector, metadata and flags stay together, so nothing is joined by position, and a
``row_id`` names the same row for ever: it is never numbered anew.  Rows, logs and the cleanup queue change in one commit
(``commits.Stores``), so a crash leaves no log that is folded in but still there, or gone but not folded in; what is logged
while a compaction runs stays in the log.
"""

from __future__ import annotations

import datetime as dt
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory, vector
from ..schemas import CLEANUP, MEMORIES
from ..session import written
from .commits import Change, State, Stores

_UPDATES = "row_id long, score double, seq timestamp"
_MARKS = "row_id long, kind string, reason string, similarity double, at timestamp"


class VectorStore(Protocol):
    """What a backend offers."""

    def add(self, rows: DataFrame) -> None: ...
    def search(self, query: list[float], k: int = 5, source: str | None = None) -> DataFrame: ...
    def search_with_scores(self, query: list[float], k: int = 5, source: str | None = None) -> DataFrame: ...
    def update_behaviour_score(self, row_id: int, score: float, at: dt.datetime) -> None: ...
    def deprecate(self, row_ids: list[int], at: dt.datetime) -> None: ...
    def suppress(self, row_id: int, reason: str, similarity: float, at: dt.datetime) -> None: ...


class ExactStore:
    """Exact search by squared distance over all live rows."""

    metric = "l2"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.stores = Stores(spark, root, {"rows": (MEMORIES, "row_id"), "updates": (_UPDATES, "row_id"), "marks": (_MARKS, "row_id"), "cleanup": (CLEANUP, "entry_id")})
        self.base, self.updates, self.marks, self.queue = map(self.stores.store, ("rows", "updates", "marks", "cleanup"))

    def add(self, rows: DataFrame) -> None:
        """Append rows; absent columns are null, an absent source is ``memory``."""
        schema = self.spark.createDataFrame([], MEMORIES).schema
        self.base.append(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit("memory" if f.name == "source" else None)).cast(f.dataType).alias(f.name) for f in schema]))

    def rows(self, state: State | None = None) -> DataFrame:
        """All rows with updates and marks folded in, as of one version."""
        state = state or self.stores.state()
        base, updates, logged = (self.stores.read(name, state) for name in ("rows", "updates", "marks"))
        last = memory.latest_scores(base, updates)
        marks = logged.groupBy("row_id").agg(
            F.max(F.col("kind") == "deprecated").alias("__dead"), F.max(F.col("kind") == "suppressed").alias("__hidden"), F.max_by("reason", F.when(F.col("kind") == "suppressed", F.col("at"))).alias("__reason"), F.max(F.when(F.col("kind") == "suppressed", F.col("at"))).alias("__at"),
        )
        out = last.join(marks, "row_id", "left")
        out = out.withColumn("deprecated", F.coalesce("deprecated", F.lit(False)) | F.coalesce("__dead", F.lit(False)))
        out = out.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)) | F.coalesce("__hidden", F.lit(False)))
        out = out.withColumn("suppress_reason", F.coalesce("__reason", "suppress_reason")).withColumn("suppressed_at", F.coalesce("__at", "suppressed_at"))
        return out.select(*self.stores.columns["rows"])

    def _live(self, source: str | None) -> DataFrame:
        return vector.of_source(vector.live(self.rows()), source)

    def search(self, query: list[float], k: int = 5, source: str | None = None) -> DataFrame:
        return vector.knn(self._live(source), query, k).drop("embedding")

    def search_with_scores(self, query: list[float], k: int = 5, source: str | None = None) -> DataFrame:
        return vector.knn_scored(self._live(source), query, k).drop("embedding")

    def update_behaviour_score(self, row_id: int, score: float, at: dt.datetime) -> None:
        self.updates.append(self.spark.createDataFrame([(row_id, float(score), at)], _UPDATES))

    def deprecate(self, row_ids: list[int], at: dt.datetime) -> None:
        self.marks.append(self.spark.createDataFrame([(i, "deprecated", "", None, at) for i in row_ids], _MARKS))

    def suppress(self, row_id: int, reason: str, similarity: float, at: dt.datetime) -> None:
        """Hide a row and queue it for cleanup."""
        mark = self.spark.createDataFrame([(row_id, "suppressed", reason, float(similarity), at)], _MARKS)
        item = self.base.read().where(F.col("row_id") == row_id).select(F.col("row_id").cast("string").alias("entry_id"), F.lit("vectors").alias("store"), "importance", F.lit(at).alias("suppressed_at"), F.lit(float(similarity)).alias("similarity"))
        self.stores.commit({"marks": Change(mark), "cleanup": Change(item)})

    def dead_share(self) -> DataFrame:
        return memory.dead_share(self.rows())

    def compact(self) -> None:
        """Fold the logs into the rows: dead rows go, and their entries in the cleanup queue; the others keep their ids."""

        def change(state: State) -> dict[str, Change]:
            kept = written(vector.live(self.rows(state)), "kept")
            waiting = self.stores.read("cleanup", state).join(kept.select(F.col("row_id").cast("string").alias("entry_id")), "entry_id", "left_semi")
            return {"rows": Change(kept, whole=True), "updates": Change(whole=True), "marks": Change(whole=True), "cleanup": Change(waiting, whole=True)}

        self.stores.commit(change)

    def cleanup(self, at: dt.datetime, n: int = 50) -> DataFrame:
        """Delete the ``n`` queued rows of highest priority for good, with all that is logged of them; compact where too many are dead."""
        popped = []

        def change(state: State) -> dict[str, Change]:
            popped[:] = [written(memory.pop_batch(memory.cleanup_queue(self.stores.read("cleanup", state), F.lit(at)), n)[0], "cleanup")]
            gone = popped[0].select(F.col("entry_id").alias("path"))
            return {name: Change(None, gone) for name in ("rows", "updates", "marks", "cleanup")}

        self.stores.commit(change)
        if self.dead_share().first()["rebuild"]:
            self.compact()
        return popped[0]


class CosineStore(ExactStore):
    """The same store searched by cosine, highest first."""

    metric = "cosine"

    def search(self, query: list[float], k: int = 5, source: str | None = None) -> DataFrame:
        return vector.knn_cosine(self._live(source), query, k).drop("embedding")


BACKENDS = {"exact": ExactStore, "cosine": CosineStore}


def vector_store(spark: SparkSession, root: str, backend: str = "exact") -> ExactStore:
    if backend not in BACKENDS:
        raise ValueError(f"backend must be one of {sorted(BACKENDS)}: {backend}")
    return BACKENDS[backend](spark, root)
