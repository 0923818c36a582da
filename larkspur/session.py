"""Sessions with the settings that the plans count on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Adaptive execution re-plans joins and splits skewed partitions; timestamps are UTC throughout.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(app: str = "larkspur", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; in local mode a temporary one where none is named."""
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


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving whatever tables ``written`` wrote inside: results must be collected or saved before that."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, and there for whoever lost an executor."""
    path = f"{shared_dir(df.sparkSession)}/larkspur-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and how many rows it wrote, counted on the way."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]
