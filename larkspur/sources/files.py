"""File sources: repositories, documents, manifests, session files, JSON stores."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import clean_package
from ..operators.text_search import numbered_lines

MAX_BYTES = 300_000
# Directories that are never indexed, by what makes them.
SKIP_DIRS = [
    ".git", ".svn", ".hg", "venv", ".venv", "env", "__pycache__", ".eggs", ".tox", ".nox", ".pytest_cache", ".mypy_cache", "htmlcov", "site-packages",
    "node_modules", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".cache", "storybook-static", ".gradle", "gradle", "out", "classes",
    "generated", "generated-sources", "gen", ".idea", "vendor", "third_party", "_output", "_artifacts", "staging", "bazel-bin", "bazel-out",
    "bazel-testlogs", "bazel-genfiles", "dist", "build", "target", "bin", "tmp", "temp", "logs", ".terraform", ".serverless", "__mocks__", "coverage",
    "zz_generated",
]
# Fixed values: (extension, language, label).
LANGUAGES = (
    (".py", "python", "Python"), (".pyi", "python", "Python"), (".js", "javascript", "JavaScript"), (".jsx", "javascript", "JavaScript"),
    (".ts", "typescript", "TypeScript"), (".tsx", "tsx", "TypeScript"), (".java", "java", "Java"), (".cpp", "cpp", "C++"), (".cc", "cpp", "C++"),
    (".h", "cpp", "C++"), (".hpp", "cpp", "C++"), (".go", "go", "Go"), (".rs", "rust", "Rust"), (".sh", "bash", "Shell"), (".bash", "bash", "Shell"),
    (".yml", "yaml", "YAML"), (".yaml", "yaml", "YAML"),
)
# Extensions by the language that a search asks for.
SEARCH_EXTENSIONS = {
    "python": (".py",), "javascript": (".js", ".jsx", ".mjs"), "typescript": (".ts", ".tsx"), "go": (".go",), "rust": (".rs",), "java": (".java",),
    "cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp"), "c": (".c", ".h"),
}


def search_extensions(language: str | None) -> list[str] | None:
    """Extensions of a language; none, which filters nothing, where it is unknown."""
    found = SEARCH_EXTENSIONS.get((language or "").lower())
    return list(found) if found else None


def extension(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), "extension string, language string, label string")


def with_language(files: DataFrame, only_known: bool = True) -> DataFrame:
    """Files with language and label; other extensions are dropped, or labelled by their own name."""
    rows = files.withColumn("extension", extension(F.col("path")))
    known = F.broadcast(languages(files.sparkSession))  # one row per extension
    if only_known:
        return rows.join(known, "extension")
    return rows.join(known, "extension", "left").withColumn("label", F.coalesce("label", F.upper(F.substring("extension", 2, 20))))


class _Files(InputPartition):
    def __init__(self, root: str, paths: list[str]) -> None:
        self.root, self.paths = root, paths


class _TreeReader(DataSourceReader):
    """Lists a tree on the driver without entering skipped directories; executors read the files."""

    def __init__(self, options: dict) -> None:
        self.root = re.sub(r"^file:/*", "/", options["path"])
        self.skip = set(options.get("skip", "").split("\x1f"))
        self.most = int(options.get("max_bytes", MAX_BYTES))

    def partitions(self) -> list[InputPartition]:
        known = tuple(e for e, _, _ in LANGUAGES)
        found = []
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if d not in self.skip)
            found += [os.path.relpath(os.path.join(folder, n), self.root) for n in sorted(names) if n.lower().endswith(known)]
        return [_Files(self.root, found[i : i + 200]) for i in range(0, len(found), 200)] or [_Files(self.root, [])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                full = os.path.join(partition.root, path)
                at = os.stat(full)
                if at.st_size <= self.most:
                    with open(full, "rb") as f:
                        yield path, at.st_size, int(at.st_mtime * 1e6), f.read()
            except OSError:  # a file that went away or cannot be read
                continue


class SourceTree(DataSource):
    """``source_tree``: files of a checkout on a file system that all executors mount.

    Spark's own file sources hide names that begin with an underscore, and with them every ``__init__.py``.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length long, modified_us long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def repository(spark: SparkSession, root: str, skip: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, length, modified, content, extension, language, label)`` of the supported files of a tree, paths relative
    to its root.  ``skip`` adds directory names.

    A root with another scheme than ``file`` is scanned as binary files, where names with a leading underscore stay hidden.
    """
    if re.match(r"^(file:|/)", root):
        spark.dataSource.register(SourceTree)
        rows = spark.read.format("source_tree").option("skip", "\x1f".join([*SKIP_DIRS, *skip])).option("max_bytes", max_bytes).load(root)
        return with_language(rows.withColumn("modified", F.timestamp_micros("modified_us")).drop("modified_us"))
    names = "|".join(re.escape(d) for d in [*SKIP_DIRS, *skip])
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    relative = F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit(""))
    rows = rows.withColumn("path", relative).where(~F.col("path").rlike(f"(^|/)({names})/"))
    return with_language(rows.withColumnRenamed("modificationTime", "modified"))


def tracked_only(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files that version control knows; all where it names none."""
    return files if tracked.isEmpty() else files.join(tracked, "path", "left_semi")


def documents(spark: SparkSession, roots: list[str], pattern: str = "*.{md,rst,txt}") -> DataFrame:
    """``(path, text)`` of documentation files under several roots, each file once."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    return rows.select("path", F.col("content").cast("string").alias("text")).dropDuplicates(["path"])


def lines(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """``(file, n, line)`` of text files: for comment and decision-record scans."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    return numbered_lines(rows.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text")), "file", "text")


def decision_records(docs: DataFrame) -> DataFrame:
    """``(path, title, decision)`` of architecture decision records: the first heading and the decision section."""
    title = F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)
    decision = F.regexp_extract("text", r"(?ims)^##\s*decision\b[^\n]*\n\s*(.*?)\s*(?=^##|\z)", 1)
    return docs.where(F.lower("path").rlike(r"(^|/)(adr|adrs|decisions)/|(^|/)adr[-_]?\d+")).select("path", title.alias("title"), decision.alias("decision")).where("title <> ''")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of JSON rows; damaged rows are left out, absent fields are null."""
    reader = spark.read.schema(f"{schema}, _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged")
    return reader.json(path).where("_damaged is null").drop("_damaged")


def sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Session files, one JSON document each; unreadable ones are left out."""
    reader = spark.read.schema(f"{schema}, _damaged string").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged")
    return reader.json(path).where("_damaged is null and session_id is not null").drop("_damaged")


def parse_manifest(name: str, text: str) -> list[str]:
    """Package names that a manifest depends on; none where it does not parse."""
    try:
        if name == "pyproject.toml":
            data = tomllib.loads(text)
            project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
            optional = [d for group in project.get("optional-dependencies", {}).values() for d in group]
            return [*project.get("dependencies", []), *optional, *(p for p in poetry.get("dependencies", {}) if p != "python")]
        if name == "Cargo.toml":
            data = tomllib.loads(text)
            return [p for section in ("dependencies", "dev-dependencies") for p in data.get(section, {})]
        if name == "package.json":
            data = json.loads(text)
            return [p for section in ("dependencies", "devDependencies") for p in data.get(section, {})]
        if name == "go.mod":
            return re.findall(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[\w./\-]+)\s+v", text)
        if name.startswith("requirements") and name.endswith(".txt"):
            return [m[1] for line in text.splitlines() if (m := re.match(r"\s*([A-Za-z0-9][\w.\-]*)", line))]
    except (ValueError, AttributeError, TypeError):
        pass
    return []


def manifest_packages(files: DataFrame) -> DataFrame:
    """Distinct ``(repo, package)`` from manifests ``(repo, name, text)``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [parse_manifest(n or "", t or "") for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["repo", "packages"])

    rows = files.select("repo", "name", "text").mapInArrow(run, "repo string, packages array<string>")
    return rows.select("repo", F.explode("packages").alias("package")).select("repo", clean_package("package").alias("package")).where("package <> ''").distinct()
