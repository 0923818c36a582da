"""Shared plumbing: tables in the shared folder, connected components, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``, which every contract here calls white space.
SPACES = " \t\n\x0b\x0c\r"


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _LOCAL.get(spark.sparkContext.applicationId)
        if not folder:
            local = tempfile.mkdtemp(prefix="larkspur-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = _LOCAL[spark.sparkContext.applicationId] = f"file://{local}"
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def tables() -> int:
    """How many tables ``materialise`` has written so far: a mark for ``clear``."""
    return len(_WRITTEN)


def clear(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables that ``materialise`` wrote from mark ``since`` to mark ``until``, once no plan reads them any more."""
    for path in _WRITTEN[since:until]:
        delete(spark, path)
    _WRITTEN[since:until] = []


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing will read it again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/larkspur-" in path:
            delete(df.sparkSession, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Every round takes the smallest label among the neighbours and then jumps to the label of that label,
    so labels travel a distance that doubles each round.  Each round is a table in the shared folder.
    Nodes without an edge are absent; an empty edge table gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, "edges")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"), F.lit(True).alias("moved")),
        "labels",
    )
    while not labels.where("moved").isEmpty():
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("low"))
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        after = lower.join(jump, "low").select("node", F.least("low", "lower").alias("new"), "label")
        following = materialise(after.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = following
    return labels.select("node", F.col("label").alias("component"))


_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, such as a tokenizer.  It keeps one thing: another operator's goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        trim()
        _KEPT[key] = make()
    return _KEPT[key]


def trim() -> None:
    """Give freed memory back to the system, as workers outlive their tasks and share an executor's limit with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


class Forest:
    """Union-find over 64-bit ids that keeps the smallest id as the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = [x for x in self.parent if self.parent[x] != x]
        return np.array(nodes, np.int64), np.array([self.find(x) for x in nodes], np.int64)


#: Runs up to ``SHORT`` rows are compared side by side; longer ones ``WIDE`` rows at a time against the run.
SHORT, WIDE = 24, 256


def link_runs(first: np.ndarray, ids: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], forest: Forest) -> None:
    """Link all rows of a run that are near: ``first`` marks where runs start, ``near`` compares rows by their indices."""
    edges = np.append(np.flatnonzero(first), len(first))
    lengths = np.diff(edges)
    for start, stop in zip(edges[:-1][lengths > SHORT].tolist(), edges[1:][lengths > SHORT].tolist(), strict=True):
        _link_run(np.arange(start, stop), ids, near, forest)
    left = np.flatnonzero(np.repeat((lengths <= SHORT) & (lengths > 1), lengths))
    end = np.repeat(edges[1:], lengths)
    for step in range(1, SHORT):
        left = left[left + step < end[left]]
        if not len(left):
            break
        close = left[near(left, left + step)]
        for a, b in set(zip(ids[close].tolist(), ids[close + step].tolist(), strict=True)):
            forest.link(a, b)


def _link_run(rows: np.ndarray, ids: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], forest: Forest) -> None:
    """One long run: pairs where they are few, else breadth-first from each row not yet reached, so a row is expanded once."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    budget = 8 * len(rows)
    for at in range(0, len(rows), WIDE):
        a, b = np.nonzero(near(rows[at : at + WIDE, None], rows[None, at:]))
        a, b = a[a < b], b[a < b]
        budget -= len(a)
        if budget < 0:
            break
        found.append((rows[at + a], rows[at + b]))
    else:
        for a, b in found:
            for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
                forest.link(x, y)
        return
    while len(rows) > 1:
        seed, frontier, rows = int(ids[rows[0]]), rows[:1], rows[1:]
        while len(frontier) and len(rows):
            reached = near(frontier[:WIDE, None], rows[None, :]).any(axis=0)
            for x in ids[rows[reached]].tolist():
                forest.link(seed, x)
            frontier, rows = np.concatenate((frontier[WIDE:], rows[reached])), rows[~reached]


def edge_batch(forest: Forest) -> pa.RecordBatch:
    a, b = forest.edges()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def pieces(batch: pa.RecordBatch, column: int, budget: int = 4 << 20):
    """Cut a batch into slices whose ``column`` holds about ``budget`` bytes, so Python copies stay small."""
    array = batch.column(column)
    sizes = np.diff(np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32)[array.offset : array.offset + len(array) + 1]) if len(array) else np.zeros(0, int)
    start = 0
    held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
