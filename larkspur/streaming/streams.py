"""Structured Streaming: change feeds, incremental indexing, co-edit state, usefulness windows, sessions, retention."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import node_id
from ..operators import graph, indexing, memory
from ..session import written
from ..sources.commits import Change, State, Stores
from ..sources.files import with_language

CHANGES = "path string, action string, time timestamp, content binary"
EDITS = "session string, file string, time timestamp"


def changes(spark: SparkSession, folder: str, schema: str = CHANGES, per_trigger: int = 100) -> DataFrame:
    """File changes (create, modify, delete) that a watcher writes as Parquet to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def listing_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, action)`` from two listings ``(path, sha256)``, deletions included, which file sources cannot see."""
    joined = before.withColumnRenamed("sha256", "old").join(now.withColumnRenamed("sha256", "new"), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "modify")
    return joined.select("path", action.alias("action")).where("action is not null")


def reindex(stores: Stores, caches=(), embed=None, stream: str = "files"):
    """A ``foreachBatch`` function: parse files that changed and bring every store up to date, drop those deleted from all.

    ``stores`` holds ``files`` (key ``path``) and ``symbols`` (key ``file``), and where they are wanted ``words`` (postings),
    ``vectors`` (``embed`` makes them of symbols; without it those of changed files just go), ``nodes`` (key ``id``) and ``edges``
    (key ``src``) of the graph, and ``events`` (key ``id``): episodes that name a deleted file are marked as stale.  A batch is one
    commit, with its number: whatever fails before leaves all stores as they were, and a batch that is run again after it does
    nothing.  The last change of a path in a batch decides; content that is already indexed is skipped.  ``caches`` are cleared.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = written(rows.groupBy("path").agg(F.max_by(F.struct("action", "content"), "time").alias("x")).select("path", "x.*"), "changes")

        def change(state: State) -> dict[str, Change]:
            read = lambda name: stores.read(name, state)
            fresh = indexing.changed(with_language(last.where("action <> 'delete'")), read("files"))
            parsed = written(indexing.parse(fresh), "parsed")
            deleted = last.where("action = 'delete'").select("path")
            gone = written(deleted.unionByName(parsed.select("path")).distinct(), "gone")
            if gone.isEmpty():
                return {}
            found = indexing.symbols(parsed)
            out = {
                "files": Change(parsed.select("path", "sha256", "language", F.lit(1.0).alias("weight"), F.lit(None).cast("timestamp").alias("indexed_at")), gone),
                "symbols": Change(found, gone),
                "words": Change(indexing.word_index(found), gone),
                "vectors": Change(embed(found) if embed else None, gone),
            }
            if "nodes" in stores.tables:
                old, seq = read("nodes"), F.unix_micros(F.current_timestamp())
                of_file, itself = (old.join(gone, old[c] == gone["path"], "left_semi").select(F.col("id").alias("path")) for c in ("file", "id"))
                dead = written(of_file.unionByName(itself).distinct(), "dead")
                new = graph.symbol_edges(found).withColumn("purpose", F.lit(None).cast("string")).withColumn("seq", seq)
                into = read("edges").join(dead, F.col("dst") == F.col("path"), "left_semi").select(F.col("src").alias("path"))
                # sources whose edges change: dead ones, and those with an edge into a dead one, which keep their others
                sources = written(dead.unionByName(into).distinct(), "sources")
                kept = read("edges").join(sources, F.col("src") == F.col("path"), "left_semi").join(dead, F.col("src") == F.col("path"), "left_anti").join(dead, F.col("dst") == F.col("path"), "left_anti")
                out["edges"] = Change(kept.unionByName(new, allowMissingColumns=True), sources, "src")
                own = found.select(node_id("type", "name", "file").alias("id"), "type", "file", F.col("start_line").alias("line")).where(F.col("id").contains("::"))
                named = parsed.select(F.col("path").alias("id"), F.lit("FILE").alias("type"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"))
                out["nodes"] = Change(own.unionByName(named).dropDuplicates(["id"]).withColumn("weight", F.lit(1.0)).withColumn("seq", seq), dead, "id")
            if "events" in stores.tables and not deleted.isEmpty():
                marked = written(memory.newly_stale(read("events"), deleted), "stale")
                out["events"] = Change(marked, marked.select(F.col("id").alias("path")), "id")
            return {name: c for name, c in out.items() if name in stores.tables}

        before = stores.versions()[-1:]
        version = stores.commit(change, stream, number)
        if [version] != before and stores.changed(version):
            for cache in caches:
                cache.clear()

    return batch


def coedit_pairs(edits: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(session, file_a, file_b, n)`` as edits arrive: the state of a session is the set of files it has touched.

    A session's state goes once the watermark, ``late`` behind the latest edit, is ``idle`` past its own last edit; edits older than
    the watermark are dropped.  Time is that of the edits, so a stream that runs once for all that is there comes to an end.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["time", "file"])
        seen = list(state.get[0]) if state.exists else []
        counts: dict[tuple[str, str], int] = {}
        for file in rows["file"]:
            for other in seen:
                if other != file:
                    for pair in ((file, other), (other, file)):
                        counts[pair] = counts.get(pair, 0) + 1
            if file not in seen:
                seen.append(file)
        state.update((seen,))
        state.setTimeoutTimestamp(max(int(rows["millis"].max()), state.getCurrentWatermarkMs()) + pause)
        yield pd.DataFrame([(key[0], a, b, n) for (a, b), n in counts.items()], columns=["session", "file_a", "file_b", "n"])

    timed = edits.withColumn("millis", F.unix_millis("time")).withWatermark("time", late)
    return timed.groupBy("session").applyInPandasWithState(step, "session string, file_a string, file_b string, n long", "files array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def useful_window(queries: DataFrame, edits: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Queries joined with edits by the same user within the window; watermarks bound the state."""
    q = queries.withWatermark("query_ts", late).alias("q")
    e = edits.withWatermark("edit_ts", late).alias("e")
    within = F.col("e.edit_ts").between(F.col("q.query_ts"), F.col("q.query_ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return q.join(e, (F.col("q.user_id") == F.col("e.user_id")) & within).select("q.query_id", "q.user_id", "q.query_ts", "e.edit_ts", "e.file")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity per user, closed by an idle gap."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def event_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per type in tumbling or sliding windows (an extension: nothing needs it, streams make it cheap)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def novel_only(rows: DataFrame, seconds: int = 300, key: str = "query") -> DataFrame:
    """A row per key and ``seconds``: what a result cache with a lifetime lets through."""
    return rows.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def periodic(df: DataFrame, batch, checkpoint: str, every: str | None = None):
    """Run ``batch`` on what is new, at an interval or once for all that is there; restarts go on from the checkpoint."""
    writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def prune_batch(stores: Stores, as_of, aggressive: bool = False, memories: str = "memories", archive: str = "archive", stream: str = "prune"):
    """A ``foreachBatch`` function for retention: pruned memories go to the archive store, in the commit that takes them away.

    Memories have a key; a batch that is run again does nothing.
    """
    key = stores.tables[memories][1]

    def batch(_: DataFrame, number: int) -> None:
        def change(state: State) -> dict[str, Change]:
            gone = written(memory.prune(stores.read(memories, state), as_of, aggressive)[1], "pruned")
            return {memories: Change(None, gone.select(F.col(key).alias("path"))), archive: Change(gone)}

        stores.commit(change, stream, number)

    return batch


def memory_probe(most: float = 0.9):
    """A probe that fails while more than a share of the system's memory is in use."""

    def probe() -> bool:
        with open("/proc/meminfo") as read:
            kb = {line.split(":")[0]: int(line.split()[1]) for line in read}
        return 1 - kb["MemAvailable"] / kb["MemTotal"] <= most

    return probe


def storage_probe(spark: SparkSession, folder: str):
    """A probe that fails while a folder cannot be reached."""

    def probe() -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        try:
            return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))
        except Py4JJavaError:
            return False

    return probe


class Busy(RuntimeError):
    """What a caller gets whom the gate turns away."""


class Gate:
    """Lets ``most`` calls run at a time and ``waiting`` more wait, ``patience`` seconds each; others are turned away at once."""

    def __init__(self, most: int = 4, waiting: int = 16, patience: float = 30.0) -> None:
        self.slots, self.patience = threading.Semaphore(most), patience
        self.places, self.shed = threading.Semaphore(most + waiting), 0
        self._lock = threading.Lock()

    @contextmanager
    def __call__(self) -> Iterator[None]:
        if not self.places.acquire(blocking=False):
            self._turn_away("too many calls")
        try:
            if not self.slots.acquire(timeout=self.patience):
                self._turn_away("no call ended in time")
            try:
                yield
            finally:
                self.slots.release()
        finally:
            self.places.release()

    def _turn_away(self, why: str) -> None:
        with self._lock:
            self.shed += 1
        raise Busy(why)


class Breaker:
    """Closed, open and half-open guard of a driver's calls: opens on a failed probe, tries again after a pause."""

    def __init__(self, probes, cooldown: float = 30.0) -> None:
        self.probes, self.cooldown, self.state, self.since = list(probes), cooldown, "CLOSED", 0.0

    def allow(self, now: float) -> bool:
        if self.state == "OPEN":
            if now - self.since < self.cooldown:
                return False
            self.state = "HALF_OPEN"
        if all(p() for p in self.probes):
            self.state = "CLOSED"
            return True
        self.state, self.since = "OPEN", now
        return False
