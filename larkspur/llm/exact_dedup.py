"""Exact dedup by Patricia-trie owners.

Texts are normalised (white space deleted) and dealt to partitions by length and content hash.  Each task first folds
the copies it reads itself, so a text that fills a third of the corpus crosses the shuffle a few times per map task,
not once per row.  The receiving task inserts the full byte strings into a compressed radix trie; the terminal node of a
text holds its owner: most code points in the original text, then smallest id.  When a trie outgrows its budget a subtree
moves to a scratch file, from the node below which no branch holds half of the trie any more, so what its texts have in
common stays behind and is written once.  A work list finishes such files one after another, each in a trie of its own.
Scratch files lie in the executor's own block manager folder, like Spark's spill, and a retried task makes its own.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, pieces, trim

#: Bytes of distinct text a map task holds before it sends them on, and bytes a trie holds before it spills a subtree.
FOLD_BYTES = 24 << 20
TRIE_BYTES = 96 << 20
_DELETE = SPACES.encode()
_HEAD = struct.Struct("<qqqqqqq")
_SHA = 40  # SHA-256 and the length in bytes
_FOLDED = "n_bytes long, hash long, sha binary, body binary, chars long, id long, copies long, raw long, alike long"
_CLASSES = "sha binary, n_bytes long, keep_id long, keep_raw long, group_size long, alike long"
#: Bytes that a scratch file's writer holds back.
_WRITE_BYTES = 1 << 16
#: A spilled node keeps an edge up to this length; of a longer one it keeps the first byte and the file the rest.
_LONG_EDGE = 1 << 12
#: What a node weighs beside its edge.
_NODE_BYTES = 300


def normalise(text: bytes | None) -> bytes:
    return (text or b"").translate(None, _DELETE)


class Owner:
    """What a terminal node stores: the owner of a text, how many rows have the text, and how many of them are ``alike``,
    that is have the owner's id and original text too.  ``raw`` is a hash of the original text."""

    __slots__ = ("alike", "chars", "copies", "id", "raw", "sha")

    def __init__(self, chars: int, id: int | None, copies: int, raw: int, sha: bytes, alike: int = 1) -> None:
        self.chars, self.id, self.copies, self.raw, self.sha, self.alike = chars, id, copies, raw, sha, alike

    def rank(self) -> tuple:
        return -self.chars, self.id is None, self.id or 0, self.raw

    def merge(self, other: Owner) -> None:
        self.copies += other.copies
        mine, theirs = self.rank(), other.rank()
        if theirs == mine:
            self.alike += other.alike
        elif theirs < mine:
            self.chars, self.id, self.raw, self.alike = other.chars, other.id, other.raw, other.alike


class Node:
    __slots__ = ("edge", "kept", "kids", "out", "owner", "weight")

    def __init__(self, edge: bytes, owner: Owner | None = None) -> None:
        self.edge, self.owner, self.kids, self.weight = edge, owner, {}, len(edge) + _NODE_BYTES
        #: Number of the scratch file that takes every text ending at or below this node, if it has been spilled.
        self.out: int | None = None
        #: Whether the edge stays in memory and is not weighed.
        self.kept = False


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving slices."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Scratch:
    """Numbered files of texts and owners in one folder, written through small buffers so that none stays open."""

    def __init__(self, folder: str) -> None:
        self.folder, self.held, self.next = folder, {}, 0

    def start(self) -> int:
        self.next += 1
        self.held[self.next] = bytearray()
        return self.next

    def add(self, number: int, key: bytes, owner: Owner | int) -> None:
        """A text and its owner, or the number of the file that already takes all texts from ``key`` on."""
        if isinstance(owner, int):
            owner = Owner(0, 0, -owner, 0, bytes(_SHA))
        held = self.held[number]
        held += _HEAD.pack(len(key), owner.chars, owner.id is None, owner.id or 0, owner.copies, owner.raw, owner.alike) + owner.sha + key
        if len(held) > _WRITE_BYTES:
            self._flush(number)

    def _flush(self, number: int) -> None:
        with open(f"{self.folder}/{number}", "ab") as out:
            out.write(self.held[number])
        self.held[number] = bytearray()

    def take(self, number: int) -> Iterator[tuple[bytes, Owner | int]]:
        """What a file holds; the file goes."""
        self._flush(number)
        del self.held[number]
        with open(f"{self.folder}/{number}", "rb") as read:
            os.unlink(f"{self.folder}/{number}")
            while head := read.read(_HEAD.size):
                size, chars, none, id, copies, raw, alike = _HEAD.unpack(head)
                sha, key = read.read(_SHA), read.read(size)
                yield key, Owner(chars, None if none else id, copies, raw, sha, alike) if copies > 0 else -copies


class PatriciaTrie:
    """Compressed radix trie over byte strings with owners at terminal nodes; subtrees spill to scratch files.

    ``weight`` of a node is what its subtree holds in memory; a spilled node weighs nothing.
    """

    def __init__(self, budget: int, scratch: Scratch) -> None:
        self.root, self.budget, self.scratch = Node(b""), budget, scratch
        self.spilled: list[int] = []
        #: Whether an edge that outweighs all else has been kept beyond the budget: one may, so every file makes headway.
        self.kept = False

    def insert(self, key: bytes, owner: Owner | int) -> None:
        """Add a text, or the number of a file that takes all texts from ``key`` on; such numbers come before texts."""
        node, at, path = self.root, 0, []
        while True:
            path.append(node)
            if node.out is not None:
                self.scratch.add(node.out, key[at:], owner)
                return
            if at == len(key):
                if node.owner is None:
                    node.owner = owner
                else:
                    node.owner.merge(owner)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = leaf = Node(key[at:])
                if isinstance(owner, int):
                    leaf.out, leaf.weight = owner, 0
                    self.spilled.append(owner)
                else:
                    leaf.owner = owner
                self._add(path, leaf.weight)
                while self.root.weight > self.budget and self._spill():
                    pass
                return
            if key.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            cut, before = _common(kid.edge, key, at), kid.weight
            upper = Node(kid.edge[:cut])
            if kid.kept:
                upper.kept, upper.weight = True, _NODE_BYTES
            node.kids[key[at]] = upper
            kid.edge, kid.weight = kid.edge[cut:], 0 if kid.kept else max(0, kid.weight - cut)
            upper.kids[kid.edge[0]] = kid
            upper.weight += kid.weight
            self._add(path, upper.weight - before)
            node, at = upper, at + cut

    @staticmethod
    def _add(path: list[Node], weight: int) -> None:
        for node in path:
            node.weight += weight

    def _spill(self) -> bool:
        """Move out the subtree below the deepest node that holds half of the trie, or the heaviest branch of the root."""
        path = [self.root]
        while path[-1].kids:
            kid = max(path[-1].kids.values(), key=lambda k: k.weight)
            if not kid.weight or len(path) > 1 and 2 * kid.weight < self.root.weight:
                break
            path.append(kid)
        node, above = path[-1], path[:-1]
        if not above:
            return False
        self._add(above, -node.weight)
        alone = 10 * self.root.weight < node.weight and not self.kept
        node.weight = 0
        if alone:
            self.kept = node.kept = True
            if not node.kids:
                return True
        prefix = b""
        if not node.kept and (not node.kids or len(node.edge) > _LONG_EDGE):
            node.edge, prefix = node.edge[:1], node.edge[1:]
        number = self.scratch.start()
        moved = set()
        for below, key in self._walk(node, prefix):
            if below.out is not None:
                moved.add(below.out)
                self.scratch.add(number, key, below.out)
        for below, key in self._walk(node, prefix):
            if below.owner is not None:
                self.scratch.add(number, key, below.owner)
        self.spilled = [n for n in self.spilled if n not in moved] + [number]
        node.out, node.kids, node.owner = number, {}, None
        return True

    @staticmethod
    def _walk(top: Node, prefix: bytes) -> Iterator[tuple[Node, bytes]]:
        """Nodes from ``top`` down, with what leads to them after ``prefix``."""
        stack = [(top, prefix)]
        while stack:
            node, prefix = stack.pop()
            yield node, prefix
            stack += [(kid, prefix + kid.edge) for kid in node.kids.values()]

    def owners(self) -> Iterator[Owner]:
        """Every owner; spilled subtrees are rebuilt one after another, each in a trie of its own."""
        waiting: list[int] = []
        trie = self
        while True:
            stack = [trie.root]
            while stack:
                node = stack.pop()
                if node.owner is not None:
                    yield node.owner
                stack += node.kids.values()
            trie.root = Node(b"")
            waiting += trie.spilled
            if not waiting:
                return
            trie = PatriciaTrie(self.budget, self.scratch)
            for key, owner in self.scratch.take(waiting.pop()):
                trie.insert(key, owner)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(len(body), int.from_bytes(sha[:8], "little", signed=True), sha, body, o.chars, o.id, o.copies, o.raw, o.alike) for sha, (body, o) in held.items()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["n_bytes", "hash", "sha", "body", "chars", "id", "copies", "raw", "alike"])

    for whole in batches:
        for batch in pieces(whole, 1):
            for id, text, chars, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                body = normalise(text)
                owner = Owner(chars, id, 1, raw, hashlib.sha256(body).digest())
                if (known := held.get(owner.sha)) is not None and known[0] == body:
                    known[1].merge(owner)
                    continue
                held[owner.sha] = [body, owner]
                size += len(body)
                if size > FOLD_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
    if held:
        yield flush()
    held.clear()
    trim()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folder = tempfile.mkdtemp(prefix="tries-", dir=os.environ["SPARK_LOCAL_DIRS"].split(",")[0])
    try:
        yield from _classes(PatriciaTrie(TRIE_BYTES, Scratch(folder)), batches)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        trim()


def _classes(trie: PatriciaTrie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, 1):
            for sha, body, chars, id, copies, raw, alike in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(body, Owner(chars, id, copies, raw, sha + struct.pack("<q", len(body)), alike))
    rows: list[tuple] = []

    def send() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["sha", "n_bytes", "keep_id", "keep_raw", "group_size", "alike"])

    for o in trie.owners():
        rows.append((o.sha[:32], struct.unpack("<q", o.sha[32:])[0], o.id, o.raw, o.copies, o.alike))
        if len(rows) == 20_000:
            yield send()
            rows.clear()
    if rows:
        yield send()


def raw_hash(text: Column) -> Column:
    """Tells apart texts of one group that differ in white space."""
    return F.xxhash64(text.cast("string"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("t"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), raw_hash(text).alias("raw"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: ``sha, n_bytes, keep_id, keep_raw, group_size, alike``; ``keep_raw`` is the
    ``raw_hash`` of the text that stays, ``alike`` the number of rows that have its id and that very text."""
    folded = _rows(docs, id_col, text_col).mapInArrow(_fold, _FOLDED)
    return folded.repartition("n_bytes", "hash").select("sha", "body", "chars", "id", "copies", "raw", "alike").mapInArrow(_own, _CLASSES)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, raw, sha, n_bytes)`` of every row's normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                bodies = [normalise(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()), pa.array([len(b) for b in bodies], pa.int64())],
                    ["id", "raw", "sha", "n_bytes"],
                )

    return _rows(docs, id_col, text_col).select("id", "t", "raw").mapInArrow(run, "id long, raw long, sha binary, n_bytes long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, sha)`` for every row of ``docs``.

    Texts are equal when identical after deleting white space; null counts as empty, and all empty texts are one group.
    The owner is the row with most code points in the original text, then smallest id; a null id owns only where no other
    row does, and between originals that differ in white space alone a hash of theirs decides.  Of repeated rows (same id,
    same text) one is kept.  Whole texts are compared, however long.  Other columns are ignored, and an empty table gives an
    empty result.
    """
    owned = materialise(classes(docs, id_col, text_col), "owners")
    rows = materialise(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    repeated = owned.where("alike > 1").select("sha", "n_bytes", F.col("keep_id").alias("id"), F.col("keep_raw").alias("raw"))
    if repeated.isEmpty():
        owned = owned.withColumn("first", F.lit(None).cast("long"))
    else:
        same = rows["id"].eqNullSafe(repeated["id"]) & (rows["raw"] == repeated["raw"]) & (rows["sha"] == repeated["sha"]) & (rows["n_bytes"] == repeated["n_bytes"])
        firsts = rows.join(repeated, same, "left_semi").groupBy("sha", "n_bytes").agg(F.min("row").alias("first"))
        # a table of its own, so that the join below is one of two shuffles and may split a hot group
        owned = materialise(owned.join(firsts, ["sha", "n_bytes"], "left"), "owners")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw")) & (F.col("row") == F.coalesce("first", "row"))
    return rows.join(owned, ["sha", "n_bytes"]).select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("sha"))


def owners_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that own their text, all columns unchanged; of repeated rows, one.

    Nulls, ties, empty and long texts as in ``exact_duplicates``; clashing column names do not matter.
    """
    id, raw = (f"__{name}_{uuid.uuid4().hex}" for name in ("id", "raw"))
    owned = materialise(classes(docs, id_col, text_col).select(F.col("keep_id").alias("id"), F.col("keep_raw").alias("raw"), "alike"), "owners")
    rows = docs.withColumn(id, F.col(id_col).cast("long")).withColumn(raw, raw_hash(F.col(text_col)))

    def mine(owned: DataFrame) -> DataFrame:
        owned = owned.select(F.col("id").alias("own_id"), F.col("raw").alias("own_raw")).distinct()
        return rows.join(owned, rows[id].eqNullSafe(owned["own_id"]) & rows[raw].eqNullSafe(owned["own_raw"]), "left_semi")

    once = mine(owned.where("alike = 1"))
    again = owned.where("alike > 1")
    if not again.isEmpty():
        once = once.unionByName(mine(again).dropDuplicates([id, raw]))
    return once.select(*docs.columns)
