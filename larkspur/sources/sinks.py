"""Sinks: versioned tables, event logs, manifests, snapshots, metrics.

A table is a folder of versions; a write makes the next version and then moves the pointer, so readers see whole versions
only and a failed write leaves the old one in place.  Folders are reached through Spark's file systems alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..session import written
from .commits import Change, Store, Stores


class Table:
    """A versioned Parquet table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.root, self.schema, self.partition_by = spark, root.rstrip("/"), schema, partition_by

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Complete versions: those whose write has ended with its marker."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in done if self._fs(f"{self.root}/{n}/_SUCCESS")[0].exists(self._fs(f"{self.root}/{n}/_SUCCESS")[1]))

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{version if version is not None else have[-1]}")

    def overwrite(self, df: DataFrame) -> int:
        """Write the next version; the current one may be among the inputs."""
        fs, p = self._fs(self.root)
        taken = [int(n[1:]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("v") and n[1:].isdigit()] if fs.exists(p) else []
        version = max(taken, default=0) + 1
        writer = df.write.option("compression", "zstd")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.root}/v{version}")
        return version

    def replace(self, gone: DataFrame, rows: DataFrame | None = None, on: str = "file") -> None:
        """The next version: rows whose ``on`` is in ``gone(path)`` go, ``rows`` come."""
        left = self.read().join(gone.select(F.col("path").alias(on)).distinct(), on, "left_anti")
        columns = self.spark.createDataFrame([], self.schema).columns
        self.overwrite((left if rows is None else left.unionByName(rows, allowMissingColumns=True)).select(*columns))

    def append(self, df: DataFrame) -> None:
        """Add files to the current version, for logs that only grow: who reads it meanwhile may see some of them."""
        have = self.versions()
        if not have:
            self.overwrite(df)
            return
        df.write.option("compression", "zstd").mode("append").parquet(f"{self.root}/v{have[-1]}")

    def vacuum(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.root}/v{v}")
            fs.delete(p, True)


class BucketStore(Store):
    """A store of its own, in buckets by a hash of its key column: changing some keys rewrites their buckets only, all at once."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "file") -> None:
        super().__init__(Stores(spark, root, {"rows": (schema, key)}, buckets=16), "rows")


def add_memories(table: Table, rows: DataFrame) -> None:
    """Append vectors with their metadata; absent columns are null."""
    columns = table.spark.createDataFrame([], table.schema).columns
    table.append(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]))


def log_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").option("compression", "zstd").parquet(path)


def rotate_events(stores: Stores, events: str = "events", archive: str = "archive", stream: str | None = None, number: int | None = None, **options) -> int:
    """Move the oldest events to the archive store once the cap is reached, in one commit; how many went.

    Both stores have the events' columns, and the events' key is ``id``.  A batch of a stream that is run again moves nothing.
    """
    moved = [0]

    def change(state) -> dict[str, Change]:
        old = written(memory.rotate(stores.read(events, state), **options)[1], "rotated")
        moved[0] = old.count()
        return {events: Change(None, old.select(F.col("id").alias("path"))), archive: Change(old)} if moved[0] else {}

    before = stores.versions()[-1:]
    return moved[0] if [stores.commit(change, stream, number)] != before else 0


def manifest(files: DataFrame) -> DataFrame:
    """One row: what an index consists of and a hash over it, which does not depend on the order of rows."""
    each = F.sha2(F.concat_ws("\x1f", "path", "sha256"), 256)
    total = F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("h"))), ""), 256)
    grouped = files.withColumn("h", each).groupBy(F.substring("h", 1, 2).alias("p")).agg(total.alias("h"), F.count("*").alias("n"))
    return grouped.agg(F.sum("n").alias("files"), total.alias("sha256"))


def verify(files: DataFrame, stored: DataFrame) -> bool:
    return manifest(files).exceptAll(stored.select("files", "sha256")).isEmpty()


def snapshot(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def append_exchange(turns: DataFrame, conv_id: int, user: str, assistant: str) -> DataFrame:
    """Turns with one more exchange at the end of a conversation."""
    spark = turns.sparkSession
    last = turns.where(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("last"))
    new = spark.createDataFrame([(conv_id, 1, "user", user), (conv_id, 2, "assistant", assistant)], "conv_id long, step long, role string, text string")
    rows = new.crossJoin(F.broadcast(last)).select("conv_id", (F.col("last") + F.col("step")).alias("turn"), "role", "text")
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)
