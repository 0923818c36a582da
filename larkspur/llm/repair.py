"""Conversation structure repair by a min-plus matrix scan.

A repaired conversation's roles spell ``(s?(ua)+)?``: an automaton of four states (nothing yet, after the system turn, after
a user turn, after an assistant turn).  A turn is a 4x4 matrix: entry (i, j) is the cheapest way to get from state i to j by
inserting turns (the closure of insertion) and then keeping, re-roling or deleting this turn, as (cost, audit), audit being
the initials of the edits.  Costs add, audits join, and of equal costs the ASCII-least audit stays.  That product is
associative: ways through the same turns that cost the same never are one the start of the other, since what follows could
only be insertions, which cost.  So turns are multiplied in any grouping:

1. Faults come from plain expressions; the first row of every (role, text) is found by an aggregate, not a window.
2. Rows, without texts, are dealt by range of (conversation, turn), so a long conversation spreads over many tasks.  Each task
   multiplies the turns of a conversation, halves first; equal short runs are multiplied once.
3. Conversations that touch the edge of a range are reduced in a tree, ``FAN`` neighbouring ranges at a time.
4. Audits go back to the turns and the repaired turns follow from them in order.

An audit has a character an edit, so one row of the result grows with its conversation; before step 4, that is all that any
task holds of a conversation, times the few entries of a matrix that differ.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, pieces

FAN = 16
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; and where a role's initial leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: The role that a re-roled or inserted turn takes in a state.
FORCED = ("user", "user", "assistant", "user")
#: Turns multiplied as one run, and longest run and number of runs that a task remembers.
RUN, SHORT, REMEMBERED = 4096, 8, 50_000

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]

#: Kinds of turns: one that must go; or a role's initial (``-`` for any other role), and its other form where the text is cut off.
GONE, CUT_OFF = "x", dict(zip("sua-", "SUA_", strict=True))


def _better(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None else a if b is None else min(a, b)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        made = []
        for j in range(4):
            ways = [(x[0] + y[0], x[1], y[1]) for x, line in zip(row, b, strict=True) if x is not None and (y := line[j]) is not None]
            if not ways:
                made.append(None)
                continue
            least = min(w[0] for w in ways)
            made.append((least, min(x + y for cost, x, y in ways if cost == least)))
        out.append(tuple(made))
    return tuple(out)


def _closure() -> Matrix:
    """Any number of insertions."""
    reach: list[list[tuple[int, str] | None]] = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        state = i
        for n in (1, 2, 3):
            state = NEXT[state][FORCED[state][0]]
            reach[i][state] = _better(reach[i][state], (n * INSERT, "I" * n))
    return tuple(map(tuple, reach))


CLOSURE = _closure()


def _turn(initial: str | None, extra: int = 0) -> Matrix:
    """Insertions, then one edit of a turn; ``None``: the turn must go."""
    edits: list[list[tuple[int, str] | None]] = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if initial is not None:
        for i in range(4):
            if (j := NEXT[i].get(initial)) is not None:
                edits[i][j] = _better(edits[i][j], (KEEP + extra, "K"))
            j = NEXT[i][FORCED[i][0]]
            edits[i][j] = _better(edits[i][j], (REROLE + extra, "R"))
    return multiply(CLOSURE, tuple(map(tuple, edits)))


TURNS = {GONE: _turn(None)} | {kind: _turn(kind) for kind in CUT_OFF} | {cut: _turn(kind, OPEN) for kind, cut in CUT_OFF.items()}


class Products:
    """Products of runs of turns, remembering those of short runs."""

    def __init__(self) -> None:
        self.known: dict[str, Matrix] = dict(TURNS)

    def of(self, kinds: str) -> Matrix:
        if (found := self.known.get(kinds)) is not None:
            return found
        half = 1 << ((len(kinds) - 1).bit_length() - 1)
        made = multiply(self.of(kinds[:half]), self.of(kinds[half:]))
        if len(kinds) <= SHORT and len(self.known) < REMEMBERED:
            self.known[kinds] = made
        return made


class Segment:
    """What is known of some neighbouring turns of a conversation; segments join in order."""

    __slots__ = ("first", "last", "low", "high", "turns", "illegal", "faults", "stack")

    def __init__(self) -> None:
        self.first = self.last = self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0]
        self.stack: list[tuple[int, Matrix]] = []

    def push(self, size: int, matrix: Matrix) -> None:
        """Matrices of neighbouring runs, the earlier ones over more turns: so what is copied grows with n log n."""
        self.stack.append((size, matrix))
        while len(self.stack) > 1 and self.stack[-2][0] <= self.stack[-1][0]:
            (n, b), (m, a) = self.stack.pop(), self.stack.pop()
            self.stack.append((m + n, multiply(a, b)))

    def product(self) -> Matrix | None:
        while len(self.stack) > 1:
            (n, b), (m, a) = self.stack.pop(), self.stack.pop()
            self.stack.append((m + n, multiply(a, b)))
        return self.stack[0][1] if self.stack else None

    def add(self, initial: str, turn: int | None, fault: int) -> None:
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and (self.high is None or turn != self.high):
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if fault:
            self.faults[fault - 1] += 1

    def join(self, other: Segment) -> None:
        if other.last is not None:
            if self.last is None:
                self.first = other.first
            else:
                self.illegal += self.last + other.first not in ("su", "ua", "au")
            self.last = other.last
        self.illegal += other.illegal
        if other.low is not None:
            self.turns += other.turns - (self.high is not None and self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        for size, matrix in other.stack:
            self.push(size, matrix)

    def pack(self) -> bytes:
        size = sum(n for n, _ in self.stack)
        return zlib.compress(json.dumps([self.first, self.last, self.low, self.high, self.turns, self.illegal, self.faults, size, self.product()]).encode(), 1)

    @classmethod
    def unpack(cls, blob: bytes) -> Segment:
        out = cls()
        out.first, out.last, out.low, out.high, out.turns, out.illegal, out.faults, size, matrix = json.loads(zlib.decompress(blob))
        if matrix is not None:
            out.stack = [(size, tuple(tuple(None if x is None else (x[0], x[1]) for x in row) for row in matrix))]
        return out

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        whole = self.product()
        cost, audit = min(x for x in (multiply(whole, CLOSURE)[0][j] for j in FINAL) if x is not None) if whole else (0, "")
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return gaps, *self.faults, self.illegal, cost, audit


_SEGMENTS = "conv long, part int, whole boolean, body binary"
_RESULTS = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment per conversation of a range; all but those at the range's edges are whole conversations."""
    products, rows, now, begun, part = Products(), [], None, False, 0
    segment, kinds, first = Segment(), [], True

    def flush() -> None:
        if kinds:
            segment.push(len(kinds), products.of("".join(kinds)))
            kinds.clear()

    for batch in batches:
        for conv, turn, initial, kind, fault, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != now:
                if begun:
                    flush()
                    rows.append((now, part, not first, segment.pack()))
                    first = False
                    if len(rows) >= 1000:
                        yield _batch(rows, _SEGMENTS)
                        rows = []
                segment, now, begun = Segment(), conv, True
            segment.add(initial, turn, fault)
            kinds.append(kind)
            if len(kinds) >= RUN:
                flush()
    if begun:
        flush()
        rows.append((now, part, False, segment.pack()))
    if rows:
        yield _batch(rows, _SEGMENTS)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the segments of each (conversation, part), which come in order."""
    held: tuple | None = None
    segment = Segment()
    for batch in batches:
        for conv, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, part) != held:
                if held:
                    yield _batch([(*held, False, segment.pack())], _SEGMENTS)
                held, segment = (conv, part), Segment()
            segment.join(Segment.unpack(body))
    if held:
        yield _batch([(*held, False, segment.pack())], _SEGMENTS)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, 1):
            yield _batch([(conv, *Segment.unpack(body).result()) for conv, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _RESULTS)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` after faults that a hash of ``conv:turn`` plants; nulls in roles, texts and the hashed string are a space."""
    id, at = F.col(conv).cast("long"), F.col(turn).cast("long")
    said, name = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(at.cast("string"), F.lit(" "))).cast("binary")) % 20
    new = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    made = rows.select(id.alias("conv"), at.alias("turn"), F.when(draw == 4, F.lit("user")).otherwise(name).alias("role"), new.alias("text"), draw.alias("draw"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.where("draw <> 0").withColumn("copy", F.explode(copies)).drop("draw", "copy")


def turn_table(rows: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with their place in the order: ``(conv, turn, role, text, digest, row)``, as a table in the shared folder."""
    name, said = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    made = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), name.alias("role"), said.alias("text"))
    return materialise(made.withColumns({"digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "row": F.monotonically_increasing_id()}), "turns")


ORDER = ["conv", "turn", "digest", "row"]


def _kind(gone: Column, cut: Column) -> Column:
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("-"))
    return F.when(gone, F.lit(GONE)).when(cut, F.translate(plain, "".join(CUT_OFF), "".join(CUT_OFF.values()))).otherwise(plain)


def audits(turns: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for each conversation of a ``turn_table``."""
    firsts = turns.groupBy("conv", "digest").agg(F.min(F.struct("turn", "row")).alias("at")).select(F.col("at.row").alias("row"), F.lit(True).alias("first"))
    text = F.rtrim(F.col("text"), F.lit(SPACES))
    light = turns.select("conv", "turn", "digest", "row", F.substring("role", 1, 1).alias("initial"), "role", (text == "").alias("blank"), F.substring(text, -1, 1).isin(".", "!", "?").alias("closed"))
    seen = light.join(firsts, "row", "left")
    again = F.col("first").isNull()
    fault = F.when(F.col("blank"), 1).when(again, 2).when(~F.col("closed"), 3).otherwise(0)
    kind = _kind(F.col("blank") | again, ~F.col("closed"))
    dealt = seen.select(*ORDER, "initial", kind.alias("kind"), fault.alias("fault")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    segments = materialise(dealt.select("conv", "turn", "initial", "kind", "fault", F.spark_partition_id().alias("part")).mapInArrow(_scan, _SEGMENTS), "segments")
    edge = segments.where("not whole").select("conv", "part", "body")
    ranges = (edge.agg(F.max("part")).first()[0] or 0) + 1
    while ranges > 1:
        ranges = -(-ranges // FAN)
        grouped = edge.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).repartition("conv", "up").sortWithinPartitions("conv", "up", "part")
        edge = materialise(grouped.select("conv", "up", "body").mapInArrow(_reduce, _SEGMENTS), "segments").select("conv", "part", "body")
    return segments.where("whole").select("conv", "body").unionByName(edge.select("conv", "body")).mapInArrow(_results, _RESULTS)


def edited(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a conversation's repaired turns from its (role, text) rows in order."""
    state = 0
    for edit in audit:
        if edit == "I":
            role, text = FORCED[state], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = FORCED[state]
        state = NEXT[state][role[0]]
        yield edit, role, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """(conversation, audit, its rows); each conversation's audit comes before its rows."""

    def flat() -> Iterator[tuple]:
        for whole in batches:
            for batch in pieces(whole, 3):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    stream = flat()
    head = next(stream, None)
    while head is not None:
        conv, audit, after = head[0], head[1], []

        def rows(after=after) -> Iterator[tuple[str, str]]:
            for row in stream:
                if row[1] is not None:
                    after.append(row)
                    return
                yield row[2], row[3]

        mine = rows()
        yield conv, audit, mine
        for _ in mine:  # rows that a consumer left
            pass
        head = after[0] if after else None


def _in_order(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and turns by conversation, in order.  A digest needs a conversation's turns one after another, so they meet in one task and stream."""
    nothing = F.lit(None)
    first = found.select("conv", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("digest"), nothing.cast("long").alias("row"), "audit", nothing.cast("string").alias("role"), nothing.cast("string").alias("text"))
    then = turns.select("conv", F.lit(1).alias("kind"), "turn", "digest", "row", nothing.cast("string").alias("audit"), "role", "text")
    both = first.unionByName(then).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest", "row")
    return both.select("conv", "audit", "role", "text")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, place, edit, role, text)``: the repaired turns of every conversation, numbered from 0."""
    schema = "conv long, place long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for conv, audit, mine in _conversations(batches):
            for place, (edit, role, text) in enumerate(edited(mine, audit)):
                rows.append((conv, place, edit, role, text))
                size += len(text) + 64
                if size > 4 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return _in_order(turns, found).mapInArrow(run, schema)


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, sha)``: lowercase hex SHA-256 of the repaired turns as ``role:text``, joined by line feeds."""
    schema = "conv long, sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv, audit, mine in _conversations(batches):
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(edited(mine, audit)):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            rows.append((conv, digest.hexdigest()))
            if len(rows) >= 10_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return _in_order(turns, found).mapInArrow(run, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns of ``rows`` as a table and, for each conversation, ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``.

    ``repaired_turns`` and ``repaired_digests`` take both.  Turns go in the order of ``turn``, null first; ties by the digest of
    role and text, equal rows in any order.  Null roles and texts are one space, so such a text is blank; a role that begins
    with none of s, u and a, the empty role too, can be re-roled or deleted only.  A null conversation is one conversation.
    Repeated rows are duplicates; texts and conversations may be of any length; other columns are ignored; an empty table
    gives empty results.
    """
    turns = turn_table(rows, conv, turn, role, text)
    return turns, materialise(audits(turns), "audits")
