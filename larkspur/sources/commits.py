"""One commit over several stores.

A store is a set of Parquet folders, each with the rows of one bucket of the store's key.  A commit stages the new folders of
all stores that it changes, which nobody sees, and then publishes one small file that lists every store's folders; readers
take the newest.  So readers see all of a commit or nothing, and a crash at any point leaves the stores as they were.

A commit says which folders it drops and which it adds, against the version that it was computed from.  If another commit
came first, it is laid over that one as long as no folder that it drops has gone; otherwise it is computed again.  A stream
gives its name and batch number, which the file keeps: a batch that is run again finds itself done.

Changing some keys rewrites the buckets that hold them; an append adds a folder.  The number of buckets grows with the bytes
of a store, so what one key's change rewrites does not.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a bucket beyond which a rewrite doubles the number of buckets, and folders of a bucket beyond which it is merged.
BUCKET_BYTES, MOST_FOLDERS = 128 << 20, 24
RETRIES = 20


class Conflict(RuntimeError):
    """Another commit changed what this one was computed from."""


@dataclass(frozen=True)
class Change:
    """What a commit does to one store: rows whose ``on`` (the key, if not said) is in ``gone(path)`` go, or all with ``whole``; ``rows`` come."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    on: str | None = None
    whole: bool = False


@dataclass
class Layout:
    """A store's folders as ``[bucket, path, bytes]``, and its number of buckets."""

    buckets: int
    folders: list[list] = field(default_factory=list)

    def of(self, buckets: set[int]) -> list[list]:
        return [f for f in self.folders if f[0] in buckets]


@dataclass
class State:
    version: int
    stores: dict[str, Layout]
    batches: dict[str, int]

    def dump(self) -> str:
        return json.dumps({"stores": {n: [s.buckets, s.folders] for n, s in self.stores.items()}, "batches": self.batches})

    @classmethod
    def load(cls, version: int, text: str) -> State:
        raw = json.loads(text)
        return cls(version, {n: Layout(b, f) for n, (b, f) in raw["stores"].items()}, raw["batches"])


@dataclass
class _Delta:
    buckets: int
    dropped: list[list]
    added: list[list]


class Stores:
    """Stores below ``root``: ``tables`` maps a name to its schema and its key column (None: one bucket); ``buckets`` to begin with."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str | None]], buckets: int = 1) -> None:
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        self.columns = {n: spark.createDataFrame([], schema).columns for n, (schema, _) in tables.items()}

    # ── files ───────────────────────────────────────────────────────────────────────────────────────────────────────

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list:
        fs, p = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._names(f"{self.root}/_commits"))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def state(self, version: int | None = None) -> State:
        """A version's state, the newest if none is named; of stores that no commit has touched, none."""
        if version is None:
            have = self.versions()
            if not have:
                return State(0, {}, {})
            version = have[-1]
        fs, p = self._fs(f"{self.root}/_commits/{version:012d}.json")
        stream = fs.open(p)
        try:
            return State.load(version, self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Make a file with its whole text at once; false if there is one."""
        fs, aside = self._fs(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), never)
            return True
        except Py4JJavaError as failed:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(failed.java_exception):
                return False
            raise

    # ── reading ─────────────────────────────────────────────────────────────────────────────────────────────────────

    def layout(self, name: str, state: State) -> Layout:
        return state.stores.get(name) or Layout(self.buckets if self.tables[name][1] else 1)

    def _rows(self, name: str, folders: list[list]) -> DataFrame:
        schema = self.tables[name][0]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f[1]}" for f in folders])

    def read(self, name: str, version: int | State | None = None) -> DataFrame:
        state = version if isinstance(version, State) else self.state(version)
        return self._rows(name, self.layout(name, state).folders)

    def _bucket(self, name: str, buckets: int) -> Column:
        key = self.tables[name][1]
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0)

    # ── writing ─────────────────────────────────────────────────────────────────────────────────────────────────────

    def commit(self, changes: dict[str, Change] | Callable[[State], dict[str, Change]], stream: str | None = None, number: int | None = None) -> int:
        """Publish changes of several stores at once; returns the version in which they are.

        Changes that depend on what the stores hold are given as a function of the state, which may be called again.
        """
        for _ in range(RETRIES):
            base = self.state()
            if stream is not None and base.batches.get(stream, -1) >= number:
                return base.version
            made = changes(base) if callable(changes) else changes
            deltas = {n: d for n, c in made.items() if (d := self._stage(base, n, c)) is not None}
            if not deltas and stream is None:
                return base.version
            try:
                return self._publish(base, deltas, stream, number)
            except Conflict:
                continue
        raise Conflict(f"gave up after {RETRIES} times: other commits keep changing the same folders")

    def _publish(self, base: State, deltas: dict[str, _Delta], stream: str | None, number: int | None) -> int:
        while True:
            head = self.state()
            if stream is not None and head.batches.get(stream, -1) >= number:
                return head.version
            stores = dict(head.stores)
            for name, d in deltas.items():
                now, then = self.layout(name, head), self.layout(name, base)
                gone = {f[1] for f in d.dropped}
                left = [f for f in now.folders if f[1] not in gone]
                if len(left) + len(gone) != len(now.folders) or now.buckets != then.buckets or (d.buckets != now.buckets and left):
                    raise Conflict(name)
                stores[name] = Layout(d.buckets, left + d.added)
            batches = head.batches if stream is None else head.batches | {stream: number}
            if self._create(f"{self.root}/_commits/{head.version + 1:012d}.json", State(head.version + 1, stores, batches).dump()):
                return head.version + 1

    def _write(self, name: str, rows: DataFrame, buckets: int) -> list[list]:
        """Stage rows in folders by bucket.  Small buckets share a task and large ones are split, by their size."""
        columns = self.columns[name]
        have = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], self.tables[name][0]).schema}
        typed = rows.select(*have).select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
        place = f"{name}/{uuid.uuid4().hex}"
        dealt = typed.withColumn("__bucket", self._bucket(name, buckets))
        if buckets > 1:
            dealt = dealt.hint("rebalance", "__bucket")
        dealt.write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{self.root}/{place}")
        out = []
        for entry in self._names(f"{self.root}/{place}"):
            folder = entry.getPath().getName()
            if folder.startswith("__bucket="):
                fs, p = self._fs(f"{self.root}/{place}/{folder}")
                out.append([int(folder.partition("=")[2]), f"{place}/{folder}", fs.getContentSummary(p).getLength()])
        return out

    def _stage(self, base: State, name: str, change: Change) -> _Delta | None:
        now = self.layout(name, base)
        if change.whole:
            added = self._write(name, change.rows, now.buckets) if change.rows is not None else []
            return _Delta(now.buckets, now.folders, added)
        if change.gone is None:
            if change.rows is None:
                return None
            full = {b for b, n in Counter(f[0] for f in now.folders).items() if n >= MOST_FOLDERS}
            merged = now.of(full)
            rows = change.rows if not full else change.rows.unionByName(self._rows(name, merged), allowMissingColumns=True)
            added = self._write(name, rows, now.buckets)
            return _Delta(now.buckets, merged, added) if added else None
        on = change.on or self.tables[name][1]
        kind = self._rows(name, []).schema[on].dataType
        gone = change.gone.select(F.col("path").cast(kind).alias(on)).distinct()
        candidates = now.folders
        if on == self.tables[name][1]:
            candidates = now.of({r[0] for r in gone.select(self._bucket(name, now.buckets)).distinct().collect()})  # at most the number of buckets
        hit = self._rows(name, candidates).join(gone, on, "left_semi").select(self._bucket(name, now.buckets)).distinct().collect() if candidates else []
        touched = now.of({r[0] for r in hit})
        buckets = now.buckets
        while self.tables[name][1] and sum(f[2] for f in now.folders) > BUCKET_BYTES * buckets:
            buckets *= 2
        if buckets != now.buckets:
            touched = now.folders
        left = self._rows(name, touched).join(gone, on, "left_anti") if touched else None
        rows = left if change.rows is None else change.rows if left is None else left.unionByName(change.rows, allowMissingColumns=True)
        if rows is None:
            return None
        added = self._write(name, rows, buckets)
        return _Delta(buckets, touched, added) if added or touched else None

    def changed(self, version: int) -> set[str]:
        """Names of the stores that a version changed."""
        new, old = self.state(version).stores, self.state(version - 1).stores if version - 1 in self.versions() else {}
        return {name for name in new if new[name] != old.get(name)}

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> None:
        """Delete folders that none of the last ``keep`` versions lists, once they are old enough that no commit may be staging them."""
        have = self.versions()
        used = {f[1].split("/")[1] for v in have[-keep:] for s in self.state(v).stores.values() for f in s.folders}
        limit = (time.time() - older_than) * 1000
        for name in self.tables:
            for entry in self._names(f"{self.root}/{name}"):
                if entry.getPath().getName() not in used and entry.getModificationTime() <= limit:
                    self._fs(str(entry.getPath()))[0].delete(entry.getPath(), True)
        for v in have[:-keep]:
            fs, p = self._fs(f"{self.root}/_commits/{v:012d}.json")
            fs.delete(p, False)

    def store(self, name: str) -> Store:
        return Store(self, name)


class Store:
    """One store of a group, each write a commit of its own."""

    def __init__(self, stores: Stores, name: str) -> None:
        self.stores, self.name, self.schema, self.spark = stores, name, stores.tables[name][0], stores.spark

    def read(self, version: int | None = None) -> DataFrame:
        return self.stores.read(self.name, version)

    def versions(self) -> list[int]:
        return self.stores.versions()

    def overwrite(self, rows: DataFrame) -> None:
        """Make the store hold ``rows`` alone; it may be among their inputs."""
        self.stores.commit({self.name: Change(rows, whole=True)})

    def append(self, rows: DataFrame) -> None:
        self.stores.commit({self.name: Change(rows)})

    def replace(self, gone: DataFrame, rows: DataFrame | None = None, on: str | None = None) -> None:
        """Rows whose ``on`` (the key, if not said) is in ``gone(path)`` go, ``rows`` come; only buckets that hold some are rewritten."""
        self.stores.commit({self.name: Change(rows, gone, on)})
