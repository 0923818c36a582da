"""A stream of what changes below a root: files that come, change and go.

An offset is the number of a listing.  Each look at the tree makes a listing, path to time and size; if it differs from the
last one it is kept as the next in the ``listings`` folder, and what a batch holds is the difference of the listings at its two
ends.  So deletions are seen, which Spark's own file source cannot, and a batch that is run again holds the same paths.  A file's
content is read when the batch runs, in tasks by some paths each; a file that has gone by then counts as deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import LANGUAGES, MAX_BYTES, SKIP_DIRS

CHANGES = "path string, action string, time timestamp, content binary"
#: Paths whose files one task reads.
PER_TASK = 256


class Part(InputPartition):
    def __init__(self, changes: list[tuple[str, str, int]]) -> None:
        self.changes = changes


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.listings = options["path"], options["listings"]
        self.extensions = tuple(x for x in options.get("extensions", ",".join(e for e, *_ in LANGUAGES)).split(",") if x)
        self.most, self.skip = int(options.get("max_bytes", MAX_BYTES)), frozenset(options.get("skip", " ".join(SKIP_DIRS)).split())

    def _open(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")

    def _look(self) -> dict[str, list[int]]:
        """Files of the tree now, skipped directories not entered."""
        store, base = self._open(self.root)
        found, waiting = {}, [base]
        while waiting:
            for info in store.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True)):
                if info.type == fs.FileType.Directory:
                    if info.base_name not in self.skip:
                        waiting.append(info.path)
                elif info.type == fs.FileType.File and info.size <= self.most and info.base_name.lower().endswith(self.extensions):
                    found[info.path[len(base) :].lstrip("/")] = [info.mtime_ns or 0, info.size]
        return found

    def _kept(self) -> list[int]:
        store, base = self._open(self.listings)
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _listing(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        store, base = self._open(self.listings)
        with store.open_input_stream(f"{base}/{number}.json") as read:
            return json.loads(read.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        kept = self._kept()
        last, now = kept[-1] if kept else 0, self._look()
        if now != self._listing(last):
            store, base = self._open(self.listings)
            store.create_dir(base, recursive=True)
            last += 1
            aside = f"{base}/{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(aside) as out:
                out.write(json.dumps(now, sort_keys=True).encode())
            store.move(aside, f"{base}/{last}.json")
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        changes = [(p, "create" if p not in old else "modify", new[p][0]) for p in sorted(new) if old.get(p) != new[p]]
        gone = max([t for t, _ in [*old.values(), *new.values()]], default=0)  # a deletion's own time is not known
        changes += [(p, "delete", gone) for p in sorted(old) if p not in new]
        return [Part(changes[i : i + PER_TASK]) for i in range(0, len(changes), PER_TASK)]

    def read(self, partition: Part) -> Iterator[tuple]:
        import datetime as dt

        store, base = self._open(self.root)
        for path, action, nanos in partition.changes:
            content = None
            if action != "delete":
                try:
                    with store.open_input_stream(f"{base}/{path}") as read:
                        content = read.read()
                except FileNotFoundError:
                    action = "delete"
            yield path, action, dt.datetime.fromtimestamp(nanos / 1e9, dt.UTC), content

    def commit(self, end: dict) -> None:
        """Listings before a batch that is done are needed no more."""
        store, base = self._open(self.listings)
        for number in self._kept():
            if number < end["listing"]:
                store.delete_file(f"{base}/{number}.json")


class FileChanges(DataSource):
    """``spark.readStream.format("file_changes")`` with ``path``, ``listings`` (a folder), ``extensions``, ``skip``, ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def file_changes(spark: SparkSession, root: str, listings: str, **options: str) -> DataFrame:
    """``(path, action, time, content)`` of files below ``root`` as they change; ``listings`` is a folder beside the checkpoint that driver and tasks share."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").options(path=root, listings=listings, **options).load()
