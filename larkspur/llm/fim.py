"""Fill-in-middle transformation by a table-driven automaton over the bytes of a text.

A unit is a run of ASCII letters or any other single code point.  The automaton (``STEP``) reads a byte's class and knows
from its state whether the byte goes on a UTF-8 character, begins a unit or ends one of the sentinels ``<P>``, ``<S>`` and
``<M>``.  Two bytes lead to one state from any other (but for ``WHOLE``, which goes on like ``SINGLE``), so the table is
applied to whole arrays of bytes, and a scan can start anywhere.

1. One scan of all bytes counts transitions by block of ``BLOCK`` bytes: units, characters and sentinels that begin there.
   The counts give the number of units, and with the hash of the id the units at which the text is cut.
2. A second pass finds each cut: sums of the counts name its block, and the automaton reads that block again.

Documents never leave their task, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, trim

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes counted together, and bytes scanned at a time.
BLOCK, CHUNK = 1024, 1 << 20
#: Bytes of output in one batch.
SEND_BYTES = 4 << 20

#: Classes of bytes: a character's later bytes, ``<``, ``>``, a sentinel's letter, other letters, all others.
MORE, LESS, GREATER, MARK, LETTER, OTHER = range(6)
CLASSES = 6
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = MORE
CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
CLASS[[ord("P"), ord("S"), ord("M")]] = MARK
CLASS[ord("<")], CLASS[ord(">")] = LESS, GREATER

#: States: after a single character or at the start; in a run of letters; after ``<``; after ``<`` and a sentinel's letter;
#: after a whole sentinel.
SINGLE, RUN, OPENED, NAMED, WHOLE = range(5)
STATES = 5
STEP = np.full((STATES, CLASSES), SINGLE, np.uint8)
STEP[:, LESS] = OPENED
STEP[:, [MARK, LETTER]] = RUN
STEP[OPENED, MARK] = NAMED
STEP[NAMED, GREATER] = WHOLE
#: The state that two classes lead to, from whatever state.
AFTER = STEP[STEP[SINGLE][:, None], np.arange(CLASSES)]
#: What a transition (state, class) counts: a unit begins, a character begins, a sentinel ends.
UNIT = np.ones((STATES, CLASSES), np.uint8)
UNIT[:, MORE] = 0
UNIT[np.ix_([RUN, NAMED], [MARK, LETTER])] = 0
CHARACTER = np.ones((STATES, CLASSES), np.uint8)
CHARACTER[:, MORE] = 0
SENTINEL = (STEP == WHOLE).astype(np.uint8)


def transitions(data: np.ndarray, start: int, stop: int, heads: np.ndarray) -> np.ndarray:
    """The transition, ``state * CLASSES + class``, that each byte from ``start`` to ``stop`` makes; texts begin at ``heads``."""
    back = min(start, 2)
    classes = CLASS[data[start - back : stop]]
    before = np.full((2, stop - start), OTHER, np.uint8)
    for i in (1, 2):
        known = classes[max(0, back - i) : len(classes) - i]
        before[i - 1, stop - start - len(known) :] = known
    # nothing stands before a text
    for i in (0, 1):
        at = heads + i
        at = at[(at >= start) & (at < stop)] - start
        before[1, at] = OTHER
        if i == 0:
            before[0, at] = OTHER
    return AFTER[before[1], before[0]] * np.uint8(CLASSES) + classes[back:]


class Scan:
    """Counts of the blocks of some texts, which lie one after another in ``data``; text ``k`` ends at ``ends[k + 1]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.ends = data, ends
        self.heads = ends[:-1][np.diff(ends) > 0]
        blocks = -(-np.diff(ends) // BLOCK)
        self.first = np.concatenate(([0], np.cumsum(blocks)))
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], blocks)
        self.starts = np.repeat(ends[:-1], blocks) + BLOCK * within
        self.stops = np.minimum(self.starts + BLOCK, np.repeat(ends[1:], blocks))
        counts = np.zeros((3, len(self.starts) + 1), np.int64)
        at = 0
        while at < len(self.starts):
            upto = max(at + 1, int(np.searchsorted(self.stops, self.starts[at] + CHUNK, "right")))
            low, high = int(self.starts[at]), int(self.stops[upto - 1])
            made = transitions(data, low, high, self.heads)
            for row, table in enumerate((UNIT, CHARACTER, SENTINEL)):
                counts[row, at + 1 : upto + 1] = np.add.reduceat(table.reshape(-1)[made], self.starts[at:upto] - low, dtype=np.int64)
            at = upto
        self.units, self.characters, self.sentinels = counts.cumsum(axis=1)

    def total(self, counts: np.ndarray) -> np.ndarray:
        """What a running count says of each text."""
        return np.diff(counts[self.first])

    def cut(self, text: int, unit: int) -> tuple[int, int]:
        """Bytes and characters of a text before its ``unit``-th unit."""
        a, b = int(self.first[text]), int(self.first[text + 1])
        begin = int(self.ends[text])
        if unit >= self.units[b] - self.units[a]:
            return int(self.ends[text + 1]) - begin, int(self.characters[b] - self.characters[a])
        wanted = int(self.units[a]) + unit
        block = a + int(np.searchsorted(self.units[a : b + 1], wanted, "right")) - 1
        low = int(self.starts[block])
        made = transitions(self.data, low, int(self.stops[block]), self.heads[np.searchsorted(self.heads, low - 1) :][:2])
        here = int(np.flatnonzero(UNIT.reshape(-1)[made])[wanted - int(self.units[block])])
        characters = int(self.characters[block] - self.characters[a]) + int(CHARACTER.reshape(-1)[made[:here]].sum())
        return low + here - begin, characters


def _transform(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for whole in batches:
            for batch in pieces(whole, 1):
                texts = batch.column(1)
                ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                held = texts.buffers()[2]
                data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
                scan = Scan(data, ends - ends[0])
                n, marked = scan.total(scan.units).tolist(), scan.total(scan.sentinels).tolist()
                for k, (id, h1, h2, h3, h4) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True)):
                    text = data[scan.ends[k] : scan.ends[k + 1]].tobytes()
                    if not text or marked[k] or h3 % 100 >= rate:
                        rows.append((id, n[k], "plain", None, None, text))
                    else:
                        first, second = sorted((h1 % (n[k] + 1), h2 % (n[k] + 1)))
                        (a, before), (b, upto) = scan.cut(k, first), scan.cut(k, second)
                        prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
                        form, parts = ("spm", (suffix, prefix, middle)) if h4 % 100 < spm else ("psm", (prefix, suffix, middle))
                        rows.append((id, n[k], form, before, upto - before, b"".join(parts)))
                    size += len(text)
                    if size > SEND_BYTES or len(rows) >= 10_000:
                        yield send()
                        rows, size = [], 0
                del data, held, texts, scan
        if rows:
            yield send()
        rows = []
        trim()

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row.

    ``n`` units are cut in three by two hashes of ``seed:id``; ``form`` is ``psm`` or, for ``spm`` in a hundred, ``spm``.  A
    text stays ``plain``, as it is, where it is empty, holds a sentinel, or falls outside ``rate`` in a hundred.  The output
    reads back (``restored``).  A null text counts as empty; a null id hashes as an empty number; repeated rows give the
    same output each; whole texts of any length are transformed, in blocks; other columns are ignored; an empty table
    gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), *hashes)
    made = rows.mapInArrow(_transform(rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``fill_in_middle`` transformed: no part of a cut text holds a sentinel, so the output splits at them."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))
