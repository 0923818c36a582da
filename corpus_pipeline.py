"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.  Null, empty and very long texts, ties, repeated rows, empty
tables and further columns are what the operator of the stage says they are; every stage keeps further columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, exact_dedup, langid, mixing, simhash
from larkspur.llm.common import clear, delete, shared_dir, tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter go."""
    return langid.identify(docs, langid.samples(docs), keep=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal but for white space: its owner."""
    return exact_dedup.owners_only(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: the one with the smallest id, null last."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), their digest and that of the text decoded from them."""
    found = bpe.encode_decode(docs)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Once a stage is written, its predecessor's table goes, as does what its operator wrote on the way.  The last stage is
    left to the caller, so what it reads stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        mark = tables()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/larkspur-pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            clear(spark, mark)
            if before:
                delete(spark, before)
            before = path
    return docs


#: SQL cannot express the stages (cross-parsing, SimHash, BPE): tests/llm checks the rows that each keeps against brute force.
ORACLE_SQL = None
