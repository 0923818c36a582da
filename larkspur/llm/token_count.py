"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

First tier: token lengths of the frequent pre-tokens, as one compact table.  Which are frequent comes from a pass over
every text: each task keeps a mergeable frequency summary of at most ``SUMMARY`` entries, a tree of tasks merges the
summaries (one blob each), and the result, of bounded size, is broadcast.  Second tier: pre-tokens outside the table are
encoded once per worker and kept in a two-generation cache of bounded size.  Neither tier changes a count.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, pieces
from .words import WordTokenizer, default_path, tokenizer

SUMMARY = 1 << 15
FAN_IN = 16
#: Longest pre-token in the broadcast table, which so holds at most ``SUMMARY * LONGEST`` characters.
LONGEST = 128
#: Characters of text that a task counts before it lets go of pre-tokens over ``LONGEST``.
FRESH = 32 << 20
#: Characters of pre-tokens in one generation of a worker's cache, each entry counting ``ENTRY`` more.
GENERATION = 40 << 20
ENTRY = 100


def _shrink(counts: Counter, size: int = SUMMARY) -> Counter:
    """Keep ``size`` entries, less the count of the first one cut: the summary of Misra and Gries, which merges."""
    if len(counts) <= size:
        return counts
    ranked = counts.most_common(size + 1)
    least = ranked[-1][1]
    return Counter({w: n - least for w, n in ranked[:-1] if n > least})


def _short(counts: Counter) -> Counter:
    return Counter({w: n for w, n in counts.items() if len(w) <= LONGEST})


def _pack(counts: Counter) -> bytes:
    return zlib.compress(json.dumps(counts).encode(), 1)


def frequent(docs: DataFrame, text_col: str, path: str) -> list[str]:
    """At most ``SUMMARY`` pre-tokens, with all that make up more than one in ``SUMMARY`` of the corpus."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts, fresh = tokenizer(path), Counter(), 0
        for whole in batches:
            for batch in pieces(whole, 0):
                for text in batch.column(0).to_pylist():
                    counts.update(cut.words(text))
                    fresh += len(text or "")
                if len(counts) > 8 * SUMMARY or fresh > FRESH:
                    counts, fresh = _shrink(_short(counts)), 0
        counts = _short(counts)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(_shrink(counts))], pa.binary())], ["summary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                counts.update(json.loads(zlib.decompress(blob)))
                counts = _shrink(counts)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(counts)], pa.binary())], ["summary"])

    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    tasks = max(1, texts.rdd.getNumPartitions())
    summaries = texts.mapInArrow(gather, "summary binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        summaries = summaries.repartition(tasks).mapInArrow(merge, "summary binary")
    counts: Counter = Counter()
    for row in summaries.toLocalIterator():
        counts.update(json.loads(zlib.decompress(row[0])))
        counts = _shrink(counts)
    return [w for w, _ in counts.most_common()]


class Lengths(dict):
    """Token length of a pre-token: the broadcast table first, then a cache of two generations, bounded in characters."""

    def __init__(self, table: dict[str, int], cut: WordTokenizer) -> None:
        super().__init__(table)
        self.table, self.cut, self.old, self.held = table, cut, {}, 0

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.cut.length(word)
        self.held += len(word) + ENTRY
        if self.held > GENERATION:
            self.old, self.held = {w: n for w, n in self.items() if w not in self.table}, 0
            self.clear()
            self.update(self.table)
        if len(word) + ENTRY <= GENERATION:
            self[word] = n
        return n

    def total(self, words: list[str]) -> int:
        return sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row.

    Tokens are those of the library for the vocabulary at ``path``, without added special tokens.  A null text counts as
    empty: no bytes, no tokens.  Ids may be null; repeated rows are counted each; whole texts count, of any length, and words of
    any length; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    path = path or default_path()
    words = frequent(docs, text_col, path)
    cut = tokenizer(path)
    table = dict(zip(words, (len(x) for x in cut.encode(words)), strict=True)) if words else {}
    shared, corpus = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = kept(("lengths", path, corpus), lambda: Lengths(shared.value, WordTokenizer(path)))
        cut = lengths.cut
        for whole in batches:
            for batch in pieces(whole, 1):
                counts = [lengths.total(cut.words(t)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
