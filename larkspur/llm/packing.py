"""Packing by power-of-two decomposition: no sequence crosses documents and none needs padding.

A document's tokens are cut into whole sequences of the longest length and then by the binary digits of what is left, so
every piece has a length that is a power of two and is a sequence of its own.  Pieces of one length form a bucket: their
sequences carry numbers without a gap, the longest bucket first, so a batch is a range of numbers of one bucket.

1. Each task tokenises its documents once, through a word cache of bounded size, and writes pieces with their ids and
   their number within (task, length).
2. Counts by task and length, at most one row per length for each task, give every task's first number in each bucket.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialise, pieces, trim
from .words import PLAIN, WordTokenizer, default_path

#: Characters of text that are cut into words at a time.
PART = 1 << 20
#: Bytes of ids in one batch.
SEND_BYTES = 4 << 20
#: Characters and ids in one generation of a worker's word cache, each entry counting ``ENTRY`` more.
GENERATION, ENTRY = 80 << 20, 150
#: Packs so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class WordIds:
    """Ids of a word as little-endian 32-bit integers, in a cache of two generations of bounded size."""

    def __init__(self, path: str) -> None:
        self.cut, self.now, self.old, self.held = WordTokenizer(path), {}, {}, 0

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = [e.ids for e in self.cut.one.encode_batch_fast(words, add_special_tokens=False)]
        special = self.cut.special
        return [(PACK[len(x)] if len(x) < len(PACK) else struct.Struct(f"<{len(x)}I").pack)(*x) if w not in special else PACK[1](special[w]) for w, x in zip(words, found, strict=True)]

    def _keep(self, word: str, ids: bytes) -> bytes:
        size = len(word) + len(ids) + ENTRY
        if self.held + size > GENERATION:
            self.old, self.now, self.held = self.now, {}, 0
        if size <= GENERATION:
            self.now[word] = ids
            self.held += size
        return ids

    def _known(self, word: str) -> bytes:
        """One word's ids, where a generation ended amid its text."""
        ids = self.now.get(word)
        if ids is None:
            ids = self.old.get(word)
            ids = self._keep(word, self._encoded([word])[0] if ids is None else ids)
        return ids

    def _words(self, words: list[str]) -> bytes:
        """Ids of words, those that are new to the cache encoded in one go."""
        new = set(filterfalse(self.now.__contains__, words))
        if new:
            old = self.old
            again = [w for w in new if w in old]
            for word, ids in zip(again, [old[w] for w in again], strict=True):
                self._keep(word, ids)
            if unknown := list(new.difference(again)):
                for word, ids in zip(unknown, self._encoded(unknown), strict=True):
                    self._keep(word, ids)
        try:
            return b"".join(map(self.now.__getitem__, words))
        except KeyError:
            return b"".join(map(self._known, words))

    def _split(self, part: str) -> list[str]:
        """Words of a part; one of Latin-1 characters alone, without a special string, needs no further look."""
        try:
            part.encode("latin-1")
        except UnicodeEncodeError:
            return self.cut.words(part)
        return self.cut.words(part) if "<|" in part else PLAIN(part.lower())

    def of(self, text: str | None) -> bytes:
        """Ids of a whole text.  No word holds a space, so long texts are cut there and their words come part by part."""
        start, found, text = 0, [], text or ""
        while start < len(text):
            stop = text.find(" ", start + PART)
            part = text if start == 0 and stop < 0 else text[start : stop if stop >= 0 else len(text)]
            found.append(self._words(self._split(part)))
            start += len(part)
        return found[0] if len(found) == 1 else b"".join(found)


def lengths(tokens: int, longest: int) -> list[int]:
    """Whole sequences first, then the binary digits of the rest from the highest down."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cut(path: str, longest: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        words, task = kept(("word ids", path), lambda: WordIds(path)), TaskContext.get().partitionId()
        last = struct.pack("<I", end)
        seen = dict.fromkeys((1 << k for k in range(longest.bit_length())), 0)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "start", "length", "doc_tokens", "task", "nth", "ids"])

        for whole in batches:
            for batch in pieces(whole, 1):
                for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = words.of(text) + last
                    start, tokens = 0, len(ids) // 4
                    for length in lengths(tokens, longest):
                        rows.append((id, start, length, tokens, task, seen[length], ids[4 * start : 4 * (start + length)]))
                        seen[length] += 1
                        start += length
                        size += 4 * length + 64
                        if size > SEND_BYTES:
                            yield send()
                            rows, size = [], 0
        if rows:
            yield send()
        rows = []
        trim()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, longest: int = 4096, end: int = 2) -> DataFrame:
    """``(id, start, length, doc_tokens, ids, sequence_id, offset)`` for every piece; ``ids`` as little-endian 32-bit integers.

    A document is its text's ids (the library's, with ``add_special_tokens=False``) and the id ``end``.  ``longest`` is a
    power of two.  A piece is a whole sequence, so ``offset`` is 0 and sequences hold no padding.  A null text counts as
    empty and gives one piece, the end; ids of documents may be null; repeated rows are documents of their own; texts of
    any length are cut whole, words of any length too; other columns are ignored; an empty table gives an empty result.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    cut = rows.mapInArrow(_cut(path or default_path(), longest, end), "id long, start long, length long, doc_tokens long, task int, nth long, ids binary")
    table = materialise(cut, "pieces")
    counts = table.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("size"))
    # one row per length
    buckets = sizes.select("length", F.coalesce(F.sum("size").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # one row per task within a length; as a table its size is known, so the planner broadcasts it only where it is small
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = materialise(counts.select("length", "task", before.alias("before")).join(buckets, "length").select("length", "task", (F.col("base") + F.col("before")).alias("first")), "first-numbers")
    numbered = table.join(firsts, ["task", "length"])
    return numbered.select("id", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
