"""BPE encoding and decoding through a table of distinct words.

1. Each task cuts its documents into blocks and lists the distinct words of a block, by falling frequency class and then
   by bucket, a hash of the word.  Documents become positions in that order.  Both go to a table in the shared folder.
2. Word lists are shuffled by bucket, so all spellings of a bucket meet in one task, which encodes each distinct word
   once and answers every block with the ids in the order of its list.
3. Answers and documents meet by block; ids are joined back by position.  Decoding joins ids to pieces.

Blocks hold ``BLOCK_BYTES`` of text and rows travel compressed, so a task's memory does not depend on the corpus, and a
word that fills a third of the corpus is one entry per block.  Frequent words have small positions, so the high bytes of
positions, stored apart, compress to little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, trim
from .words import default_path, tokenizer

BLOCK_BYTES = 24 << 20
#: Positions in one row (a document is never cut), and bytes of encoded output in one batch.
GROUP = 1 << 18
SEND_BYTES = 4 << 20
#: Buckets of words at most: a block sends one row to each, so their number must not grow with the blocks without end.
BUCKETS = 4096
#: Distinct words whose ids a bucket's task keeps at a time.
KEPT_WORDS = 1 << 20
#: Partitions of blocks at most: a task's blocks come sorted, one after another, so it holds one at a time.
JOINED = 1 << 15
#: Frequency classes: a word's is the number of bits of its count in the block.
CLASSES = 33
_ROWS = "kind int, bucket int, block string, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "block", "body"])


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes, each after its length, compressed together."""
    flat = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(f) for f in flat], np.uint64).tobytes() + b"".join(flat))


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = 8 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint64, n)))).astype(np.int64)
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _block_rows(words: list[str], ids: list[int | None], docs: list[np.ndarray], block: str, buckets: int) -> Iterator[tuple]:
    """Rows of kind 1 (a bucket's words) and kind 2 (documents as positions) of one block."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    counts = np.bincount(flat, minlength=len(words))
    kind = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
    by_word = np.empty(len(words), np.int64)
    by_word[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((by_word, bucket, -kind))
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    for b in np.unique(bucket).tolist():
        mine = order[bucket[order] == b]
        sizes = np.bincount(CLASSES - 1 - kind[mine], minlength=CLASSES).astype(np.uint32)
        yield 1, b, block, _pack(sizes, "\n".join(words[i] for i in mine.tolist()).encode("utf-8", "surrogatepass"))
    start, held = 0, 0
    for stop in range(1, len(docs) + 1):
        held += len(docs[stop - 1])
        if held >= GROUP or stop == len(docs):
            positions = place[np.concatenate(docs[start:stop])] if held else np.zeros(0, np.uint32)
            planes = [(positions >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8) for k in range(4)]
            none = np.array([i is None for i in ids[start:stop]], np.uint8)
            yield 2, None, block, _pack(np.array([i or 0 for i in ids[start:stop]], np.int64), none, np.array([len(x) for x in docs[start:stop]], np.uint32), *planes)
            start, held = stop, 0


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task = tokenizer(path), TaskContext.get()
        order: dict[str, int] = {}
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        size, block = 0, 0

        def end() -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for row in _block_rows(list(order), ids, docs, f"{task.partitionId()}.{block}", buckets):
                held.append(row)
                if len(held) == 32:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

        for whole in batches:
            for batch in pieces(whole, 1):
                for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = cut.words(text)
                    docs.append(np.fromiter((order.setdefault(w, len(order)) for w in words), np.uint32, len(words)))
                    ids.append(id)
                    size += len(text or "") + 16
                    if size > BLOCK_BYTES:
                        yield from end()
                        order, ids, docs, size, block = {}, [], [], 0, block + 1
        if docs:
            yield from end()
        del order, docs, ids
        trim()

    return run


def _encode(path: str):
    """Encode each distinct word of a bucket once and answer every block: rows of kind 1 with lengths and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, table = tokenizer(path), {}
        wide = np.uint16 if len(cut.pieces) <= 65536 else np.uint32
        for batch in batches:
            for bucket, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, text = _unpack(body, 2)
                words = text.decode("utf-8", "surrogatepass").split("\n")
                new = [w for w in words if w not in table]
                if len(table) + len(new) > KEPT_WORDS:
                    table, new = {}, words
                table.update(zip(new, (np.array(x, wide) for x in cut.encode(new)), strict=True))
                found = [table[w] for w in words]
                yield _batch([(1, bucket, block, _pack(sizes, np.fromiter(map(len, found), np.uint32, len(found)), np.concatenate(found)))])
        del table
        trim()

    return run


def _table(answers: dict[int, bytes], piece: list[bytes], wide) -> tuple[list[bytes], list[bytes]]:
    """Ids and decoded pieces of a block's words in the order of positions: by class, then bucket."""
    parts: list[tuple[int, int, list[bytes], list[bytes]]] = []
    for bucket, body in answers.items():
        sizes, lengths, flat = _unpack(body, 3)
        values = np.frombuffer(flat, wide)
        raw, each = values.astype("<u4").tobytes(), [piece[i] for i in values.tolist()]
        ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64).tolist()
        starts = [0, *ends[:-1]]
        ids = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
        text = [b" ".join(each[a:b]) for a, b in zip(starts, ends, strict=True)]
        at = 0
        for kind, n in enumerate(np.frombuffer(sizes, np.uint32).tolist()):
            if n:
                parts.append((kind, bucket, ids[at : at + n], text[at : at + n]))
                at += n
    parts.sort(key=lambda p: p[:2])
    return [x for p in parts for x in p[2]], [x for p in parts for x in p[3]]


def _join(path: str):
    """Put ids and decoded pieces in the places of words; answers of a block come before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = [p.encode() for p in tokenizer(path).pieces]
        wide = np.uint16 if len(piece) <= 65536 else np.uint32
        now, answers, ids_of, text_of = None, {}, [], []
        rows: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n_tokens", "ids", "decoded"])

        for batch in batches:
            for kind, bucket, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, answers, ids_of, text_of = block, {}, [], []
                if kind == 1:
                    answers[bucket] = body
                    continue
                if answers:
                    ids_of, text_of = _table(answers, piece, wide)
                    answers = {}
                ids, none, lengths, *planes = _unpack(body, 7)
                positions = sum(np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes)).tolist()
                start = 0
                for id, null, n in zip(np.frombuffer(ids, np.int64).tolist(), none, np.frombuffer(lengths, np.uint32).tolist(), strict=True):
                    mine = positions[start : start + n]
                    start += n
                    encoded = b"".join(map(ids_of.__getitem__, mine))
                    decoded = b" ".join(map(text_of.__getitem__, mine))
                    rows.append((None if null else id, len(encoded) // 4, encoded, decoded.decode()))
                    size += len(encoded) + len(decoded)
                    if size > SEND_BYTES:
                        yield send()
                        rows.clear()
                        size = 0
        if rows:
            yield send()
        del rows, ids_of, text_of
        trim()

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` for every row: ids as little-endian unsigned 32-bit integers, decoded text from those ids.

    Encoding is the library's with ``add_special_tokens=False``, decoding its ``decode(ids, skip_special_tokens=False)``.
    A null text counts as empty: no ids, empty text.  Repeated rows stay repeated; ids may be null; other columns are ignored.
    Whole texts are encoded, and words of any length; an empty table gives an empty result.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    buckets = min(BUCKETS, max(16, 2 * rows.rdd.getNumPartitions()))
    table = materialise(rows.mapInArrow(_blocks(path, buckets), _ROWS), "bpe")
    answers = table.where("kind = 1").select("bucket", "block", "body").repartition(buckets, "bucket").mapInArrow(_encode(path), _ROWS)
    both = answers.unionByName(table.where("kind = 2"))
    # a partition for every block, as long as the shuffle can bear their number
    blocks = table.where("kind = 2").agg(F.count_distinct("block")).first()[0]
    joined = both.repartition(min(JOINED, max(1, blocks)), "block").sortWithinPartitions("block", "kind")
    return joined.mapInArrow(_join(path), "id long, n_tokens long, ids binary, decoded string")
