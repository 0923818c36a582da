"""Embedding near-dedup by lattice hashing.

Each of several random projections maps unit vectors to eight dimensions, scaled by a width, and decodes them to the
nearest point of the E8 lattice.  A vector goes to its own cell and to the ``PROBES`` neighbouring cells nearest to it
(E8 points have 240 neighbours).  Width and number of tables follow from the number of distinct vectors (``LADDER``), so that
the rows of a cell do not grow with the corpus; on every rung a pair at cosine 0.9 meets with probability 0.999 or more.

What travels to cells is a node number and a signature of 256 sign bits, not the vector.  Vectors that meet and whose
signatures differ in at most ``MAX_BITS`` bits (a pair at cosine 0.9 exceeds that once in 30,000) are candidates; cells pass
on spanning forests, not pairs.  Each component of candidates then gets its vectors once and verifies by cosine in double
precision; a component over ``BLOCK`` vectors is verified cell by cell instead.  Links never leave a component of verified
links, so each such component counts its members' links exactly, which also restores links of pairs that met in no cell.
Equal vectors are one node throughout.  Cells and components over ``BLOCK`` rows are cut into blocks whose pairs are spread
over tasks, so none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, edge_batch, link_runs, materialise

THRESHOLD = 0.9
PROBES = 7
#: (distinct vectors at most, width, tables).
LADDER = ((200_000, 1.5, 3), (2_000_000, 1.2, 6), (10_000_000, 1.0, 11), (100_000_000, 0.75, 33), (1 << 62, 0.6, 100))
#: 64-bit words of a signature, and bits in which the signatures of a candidate pair differ at most.
WORDS = 4
MAX_BITS = 59
BLOCK = 4096
SEED = 20
_DOT_ROWS = 1024


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(y)
    rows = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    gap = y[rows] - r[rows]
    k = np.abs(gap).argmax(axis=1)
    r[rows, k] += np.where(gap[np.arange(len(rows)), k] >= 0, 1.0, -1.0)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of every row: the nearer of the two cosets of the even integer points."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def rung(n: int) -> tuple[float, int]:
    """Width and number of tables for ``n`` distinct vectors."""
    return next((width, tables) for most, width, tables in LADDER if n <= most)


@lru_cache(8)
def _projections(dim: int, width: float, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    return rng.normal(size=(tables, dim, 8)) / width, rng.uniform(0, 64, size=(tables, 8))


@lru_cache(8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED - 1).normal(size=(dim, 64 * WORDS))


def cells(unit: np.ndarray, width: float, tables: int) -> np.ndarray:
    """64-bit cell keys ``(rows, tables * (PROBES + 1))``; a row's keys in a table start with its own cell."""
    planes, shifts = _projections(unit.shape[1], width, tables)
    out = np.empty((len(unit), tables, PROBES + 1), np.int64)
    mix = np.random.default_rng(SEED).integers(1, 1 << 62, size=(tables, 9), dtype=np.int64) | 1
    for t in range(tables):
        y = unit @ planes[t] + shifts[t]
        own = decode(y)
        near = np.argpartition(-((y - own) @ neighbours().T), PROBES, axis=1)[:, :PROBES]
        points = np.concatenate((own[:, None], own[:, None] + neighbours()[near]), axis=1)
        twice = np.rint(2 * points).astype(np.int64)
        with np.errstate(over="ignore"):
            key = (twice * mix[t, :8]).sum(axis=2) + mix[t, 8]
            key ^= key >> 29
            key *= np.int64(0x2545F4914F6CDD1D)
            key ^= key >> 32
        out[:, t] = key
    return out.reshape(len(unit), -1)


def signatures(unit: np.ndarray) -> np.ndarray:
    """Signs of random projections as ``(rows, WORDS)`` 64-bit words."""
    return np.packbits(unit @ _planes(unit.shape[1]) >= 0, axis=1).view(np.int64)


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision from raw ones of equal length."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(lists: pa.Array, kind: str) -> list[bytes | None]:
    """Vectors as bytes, null where one is null, empty, zero, or holds null or non-finite components."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy().astype(kind)

    def upto(what: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(what)))

    finite, other = upto(np.isfinite(flat)), upto(flat != 0)
    good = (finite[ends] - finite[starts] == lengths) & (other[ends] > other[starts])
    body, width = flat.tobytes(), np.dtype(kind).itemsize
    return [body[s * width : e * width] if ok else None for s, e, ok in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True)]


def raw_vectors(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """``(id, dim, raw, digest)``: vectors as bytes, null where one links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _usable(batch.column(1), kind)
            digests = [None if b is None else xxhash.xxh128_digest(b) for b in raw]
            dims = [None if b is None else len(b) // np.dtype(kind).itemsize for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())], ["id", "dim", "raw", "digest"])

    cast = "array<float>" if kind == "<f4" else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(cast).alias("v")).mapInArrow(run, "id long, dim int, raw binary, digest binary")


def _close(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left @ right.T >= THRESHOLD


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal leading key columns (group, left, right) from a sorted stream."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != now:
                if rows:
                    yield now, rows
                now, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield now, rows


def in_blocks(rows: DataFrame, counts: DataFrame, group: str, owner: str) -> DataFrame:
    """``rows`` with ``left, right, block``: every group of ``counts(group, count)`` over ``BLOCK`` rows is cut into blocks,
    with one copy of a row for each pair of blocks it belongs to.  Other groups are one block and are not copied."""
    large = counts.where(F.col("count") > BLOCK).select(F.col(group), F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))
    cut = rows.join(large, group, "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(owner), F.col("k")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = cut.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    return cut.repartition(group, "left", "right").sortWithinPartitions(group, "left", "right")


_SIGNATURE = [f"s{i}" for i in range(WORDS)]


def _emit(kind: str, width: float, tables: int):
    """Cell keys of every vector, with its node and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, dims, raw = part.column(0).to_numpy(zero_copy_only=False), np.array(part.column(1).to_pylist()), part.column(2).to_pylist()
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    unit = _unit([raw[i] for i in rows], kind)
                    keys = cells(unit, width, tables)
                    signs = np.repeat(signatures(unit), keys.shape[1], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node[rows], keys.shape[1])), *(pa.array(s) for s in signs.T.copy())], ["cell", "node", *_SIGNATURE])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the candidates in every cell, from rows sorted by cell and block pair."""
    forest, rest = Forest(), None

    def verify(keys: np.ndarray, node: np.ndarray, signs: np.ndarray) -> None:
        words = np.ascontiguousarray(signs.T).view(np.uint64)
        first = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        link_runs(first, node, lambda i, j: sum(np.bitwise_count(words[:, k][i] ^ words[:, k][j]).astype(np.int16) for k in range(WORDS)) <= MAX_BITS, forest)

    for batch in batches:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4 + WORDS)])
        if rest is not None:
            now = np.concatenate((rest, now), axis=1)
        if not now.shape[1]:
            continue
        same = (now[:3] == now[:3, -1:]).all(axis=0)
        cut = now.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            verify(now[:3, :cut], now[3, :cut], now[4:, :cut])
        rest = now[:, cut:]
        if len(forest.parent) > 500_000:
            yield edge_batch(forest)
            forest = Forest()
    if rest is not None and rest.shape[1]:
        verify(rest[:3], rest[3], rest[4:])
    yield edge_batch(forest)


def _link(kind: str):
    """Spanning forests of the links in every group, each vector expanded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for _, rows in _grouped(batches):
            for size in {len(r[1]) for r in rows}:
                of = [r for r in rows if len(r[1]) == size]
                if len(of) < 2:
                    continue
                ids, unit = np.array([r[0] for r in of], np.int64), _unit([r[1] for r in of], kind)
                waiting = np.arange(len(ids))
                if len(ids) <= 64:  # one product says whether there is anything to link
                    if np.count_nonzero(unit @ unit.T >= THRESHOLD) <= len(ids):
                        continue
                while len(waiting) > 1:
                    seed, frontier, waiting = int(ids[waiting[0]]), waiting[:1], waiting[1:]
                    while len(frontier) and len(waiting):
                        near = _close(unit[frontier[:_DOT_ROWS]], unit[waiting]).any(axis=0)
                        for x in ids[waiting[near]].tolist():
                            forest.link(seed, x)
                        frontier, waiting = np.concatenate((frontier[_DOT_ROWS:], waiting[near])), waiting[~near]
            if len(forest.parent) > 500_000:
                yield edge_batch(forest)
                forest = Forest()
        yield edge_batch(forest)

    return run


def _count(kind: str):
    """Links of every member of a component within a pair of blocks, equal vectors counted as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, left, right), rows in _grouped(batches):
            for size in {len(r[1]) for r in rows}:
                of = [r for r in rows if len(r[1]) == size]
                ids, times, side = (np.array([r[i] for r in of], np.int64) for i in (0, 2, 3))
                unit, sums = _unit([r[1] for r in of], kind), np.zeros(len(of), np.int64)
                a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
                for at in range(0, len(a), _DOT_ROWS):
                    part = a[at : at + _DOT_ROWS]
                    near = _close(unit[part], unit[b])
                    if left == right:
                        near[np.arange(len(part)), np.arange(at, at + len(part))] = False
                    else:
                        sums[b] += times[part] @ near
                    sums[part] += near @ times[b]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], ["node", "n"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id)`` for every row of ``vectors``.

    Vectors link at cosine 0.9 or more.  ``n_links`` counts the other rows linked directly, equal vectors included;
    ``component_id`` is the smallest id reachable.  Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, as do vectors of different lengths; ids may repeat, each row counting; a null id takes no
    part.  An empty table gives an empty result.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    units = raw_vectors(vectors, id_col, vector_col, kind)
    valid = units.where("raw is not null and id is not null")
    distinct = valid.groupBy("digest", "dim", "raw").agg(F.min("id").alias("low"), F.count("*").alias("times"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    width, tables = rung(distinct.count())
    schema = ", ".join(f"{c} long" for c in ("cell", "node", *_SIGNATURE))
    keys = materialise(distinct.select("node", "dim", "raw").mapInArrow(_emit(kind, width, tables), schema), "cells")
    dealt = in_blocks(keys, keys.groupBy("cell").count(), "cell", "node")
    near = components(dealt.select("cell", "left", "right", "node", *_SIGNATURE).mapInArrow(_meet, "a long, b long"))
    sizes = near.groupBy("component").count()
    groups = near.join(sizes.where(F.col("count") <= BLOCK), "component").select(F.col("component").alias("group"), "node")
    large = near.join(sizes.where(F.col("count") > BLOCK), "component", "left_semi")
    if not large.isEmpty():
        groups = groups.unionByName(keys.join(large, "node", "left_semi").select(F.col("cell").alias("group"), "node"))
    groups = materialise(groups, "groups")
    dealt = in_blocks(groups.join(distinct.select("node", "raw"), "node"), groups.groupBy("group").count(), "group", "node")
    linked = components(dealt.select("group", "left", "right", "node", "raw").mapInArrow(_link(kind), "a long, b long"))
    members = distinct.join(linked, "node")
    dealt = in_blocks(members, linked.groupBy("component").count(), "component", "node")
    links = dealt.select("component", "left", "right", "node", "raw", "times", "block").mapInArrow(_count(kind), "node long, n long")
    links = links.groupBy("node").agg(F.sum("n").alias("n"))
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "component").join(links, "node", "left").select("node", "component_id", "n")
    known = distinct.select("digest", "node", "low", "times").join(linked, "node", "left")
    known = known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    alone = units.where("raw is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return valid.join(known, "digest").select("id", "n_links", "component_id").unionByName(alone)
