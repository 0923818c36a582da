"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
(23, 12, 7).  A word whose nearest codeword is at distance 2 or less gives that codeword's index as its only key; at
distance 3 it gives the indices of all six codewords within distance 4.  Any two words that differ in one bit at most
then share a key.  Three differing bits spread over three segments either leave one segment untouched and one other
with at most one error, or put exactly one error in each segment, so seven key families find every pair:

* six of (exact segment, Golay key of another segment);
* one of (Golay key, Golay key) of the first two segments, with the parity pattern that one error in each implies.

Rows meet by key in a shuffle of distinct fingerprints, pairs are verified by XOR and bit count, and each task sends on
a spanning forest of the links it saw, never the pairs themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Forest, components, edge_batch, link_runs, materialise, pieces, trim

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of UTF-8 ``text`` (ASCII lower-cased); zero without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        starts, ends = [0], [len(b" ".join(words))]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: -shingle])).tolist()
        ends = (ends[shingle - 1 :] - 1).tolist()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["id", "fp"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what turns a word into each codeword to use as a key (six columns, -1 where unused); all codewords."""
    data = np.arange(4096, dtype=np.int64) << 11
    codewords = data | _syndrome(data)
    heavy = [int(c) for c in codewords if int(c).bit_count() == 7]
    errors = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
    table = np.full((2048, 6), -1, np.int64)
    for error, at in zip(errors, _syndrome(np.array(errors)).tolist(), strict=True):
        table[at, 0] = error
        if error.bit_count() == 3:
            table[at, 1:] = [error ^ w for w in heavy if w & error == error]
    return table, codewords


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key indices of 23-bit ``words`` as an (n, 6) array, and where they are valid."""
    change = golay_tables()[0][_syndrome(words)]
    return (words.astype(np.int64)[:, None] ^ change) >> 11, change >= 0


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` pairs for unsigned fingerprints, by the seven families."""
    segments = [((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    keys = [golay_keys(s) for s in segments]
    rows, out = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                index, valid = keys[j]
                r, c = np.nonzero(valid)
                rows.append(r)
                out.append(((3 * i + j) << 36) | (segments[i][r] << 12) | index[r, c])
    odd = [np.bitwise_count(s.astype(np.uint64)).astype(np.int64) & 1 for s in segments]
    pattern = (odd[0] ^ odd[1]) << 1 | (odd[1] ^ odd[2])
    (ia, va), (ib, vb) = keys[0], keys[1]
    r, a, b = np.nonzero(va[:, :, None] & vb[:, None, :])
    rows.append(r)
    out.append((9 << 36) | (pattern[r] << 24) | (ia[r, a] << 12) | ib[r, b])
    return np.concatenate(rows), np.concatenate(out)


def _verify(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, forest: Forest) -> None:
    """Verify all pairs that share a key; the arrays are sorted by key and hold whole runs."""
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    link_runs(first[: len(keys)], nodes, lambda i, j: np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS, forest)


def links(distinct: DataFrame) -> DataFrame:
    """Spanning forests ``(a, b)`` of the links among distinct fingerprints ``(fp)``, each its own node."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                rows, keys = fuzzy_keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest = Forest(), None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            _verify(now[0][:cut], now[1][:cut], now[1][:cut].view(np.uint64), forest)
            rest = [x[cut:] for x in now]
            if len(forest.parent) > 500_000:
                yield edge_batch(forest)
                forest = Forest()
        if rest is not None:
            _verify(*rest, rest[1].view(np.uint64), forest)
        yield edge_batch(forest)

    keyed = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def components_of(printed: DataFrame) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint of ``printed(fp, ...)``: equal roots are one component."""
    distinct = materialise(printed.select("fp").distinct(), "distinct")
    joined = components(links(distinct))
    return distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    Rows with equal fingerprints share a component, as do fingerprints linked at ``MAX_BITS`` or fewer differing bits.
    ``component_id`` is the smallest id reachable.  A null text counts as empty; empty texts have fingerprint zero and are
    linked like any other; whole texts count, however long.  Rows whose id is null take part through their fingerprint;
    where a component has no id at all ``component_id`` is null.  Ids may repeat: rows are linked by fingerprints alone,
    never by a shared id.  Repeated rows stay repeated.  Other columns are ignored.  An empty table gives an empty result.
    """
    printed = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = components_of(printed)
    owners = printed.groupBy("fp").agg(F.min("id").alias("low")).join(roots, "fp")
    owners = materialise(owners, "owners")
    lowest = owners.groupBy("root").agg(F.min("low").alias("component_id"))
    # as a table of its own, so the join below may split a fingerprint that many rows share
    labels = materialise(owners.join(lowest, "root").select("fp", "component_id"), "labels")
    return printed.join(labels, "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, all columns unchanged: the smallest id, null last, and of rows with equal ids the first.

    Rows are told apart by a number given when they are written with their fingerprint, so null and repeated ids, repeated
    rows and clashing column names do not matter.  Null, empty and long texts count as in ``near_duplicates``; an empty table
    gives an empty result.
    """
    fp, row = (f"__{name}_{uuid.uuid4().hex}" for name in ("fp", "row"))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, where):
                fps = np.array([fingerprint(x.encode() if x else None) for x in batch.column(where).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, fp])
        trim()

    printed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    printed = materialise(printed.withColumn(row, F.monotonically_increasing_id()), "printed")
    slim = printed.select(F.col(id_col).cast("long").alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    # the first row of a fingerprint, then of a component
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    owners = slim.groupBy("fp").agg(first.alias("first")).join(components_of(slim), "fp")
    chosen = owners.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return printed.join(chosen, row, "left_semi").select(*docs.columns)
