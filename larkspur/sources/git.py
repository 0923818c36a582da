"""Git history as data sources: ``git_log``, ``git_files``, ``git_patch`` and ``git_tracked``.

Each is a Python data source that runs git in the repository where it is read, one partition per repository.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SINCE = {"d": 1, "w": 7, "m": 30, "y": 365}


def since_days(text: str) -> int:
    """Days of a span such as ``7d``, ``2w``, ``3m`` or ``1y``; a week where it reads otherwise."""
    m = re.fullmatch(r"\s*(\d+)\s*([dwmy])\s*", text)
    return int(m[1]) * _SINCE[m[2]] if m else 7


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=False)
    return done.stdout if done.returncode == 0 else ""


class _Repo(InputPartition):
    def __init__(self, root: str) -> None:
        self.root = root


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = options["path"].split(",")
        self.most = str(int(options.get("max_commits", "120")))
        self.since = options.get("since")
        self.target = options.get("target", "")

    def partitions(self) -> list[InputPartition]:
        return [_Repo(r) for r in self.roots]

    def log(self, root: str, *args: str) -> str:
        span = [f"--since={since_days(self.since)} days ago"] if self.since else []
        return _git(root, "log", f"-n{self.most}", *span, *args, *(["--", self.target] if self.target else []))


class _Log(_Reader):
    def read(self, partition: _Repo) -> Iterator[tuple]:
        for record in self.log(partition.root, "--format=%H%x1f%an%x1f%at%x1f%s%x1f%b%x1e").split("\x1e"):
            parts = record.strip("\n").split("\x1f")
            if len(parts) == 5:
                yield partition.root, parts[0], parts[1], int(parts[2]), parts[3], parts[4].strip()


class _Files(_Reader):
    def read(self, partition: _Repo) -> Iterator[tuple]:
        for record in self.log(partition.root, "--name-only", "--format=%x1e%H%x1f%at").split("\x1e")[1:]:
            head, _, rest = record.partition("\n")
            sha, at = head.split("\x1f")
            for path in filter(None, rest.split("\n")):
                yield partition.root, sha, int(at), path


class _Patch(_Reader):
    def read(self, partition: _Repo) -> Iterator[tuple]:
        for record in self.log(partition.root, "-p", "--format=%x1e%H").split("\x1e")[1:]:
            sha, _, rest = record.partition("\n")
            for n, line in enumerate(rest.split("\n")):
                yield partition.root, sha, n, line


class _Tracked(_Reader):
    def read(self, partition: _Repo) -> Iterator[tuple]:
        for path in filter(None, _git(partition.root, "ls-files", "-z").split("\0")):
            yield partition.root, path


class GitLog(DataSource):
    kind, columns, reads = "git_log", "repo string, hash string, author string, at long, message string, body string", _Log

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options)


class GitFiles(GitLog):
    kind, columns, reads = "git_files", "repo string, hash string, at long, path string", _Files


class GitPatch(GitLog):
    kind, columns, reads = "git_patch", "repo string, hash string, n int, line string", _Patch


class GitTracked(GitLog):
    kind, columns, reads = "git_tracked", "repo string, path string", _Tracked


def read(spark: SparkSession, kind: str, root: str, **options: str) -> DataFrame:
    for source in (GitLog, GitFiles, GitPatch, GitTracked):
        spark.dataSource.register(source)
    rows = spark.read.format(kind).options(**options).load(root)
    return rows.withColumn("time", F.timestamp_seconds("at")) if "at" in rows.columns else rows


def log_chunks(log: DataFrame, n: int = 20) -> DataFrame:
    """``(repo, block, text)``: one-line messages, newest first, in blocks of ``n``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), "hash")) - 1
    rows = log.withColumn("pos", place).withColumn("line", F.concat_ws(" ", F.substring("hash", 1, 8), "message"))
    joined: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("repo", F.floor(F.col("pos") / n).alias("block")).agg(joined.alias("text"))
