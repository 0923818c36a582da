"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text per language.  A text is parsed greedily into the
longest phrases that occur in a language's sample; the number of phrases, times the bits to point at one and over the
length of the text, is its cross-parsing entropy there.  The language needing fewest normalised phrases wins.

Automata are dense transition tables in which a missing transition leads to where the phrase restarts and carries one
count, so parsing is one table lookup per character, done for many windows of text at once.  Every letter of a language's
own sample has a code there: the most frequent ones a column of its dense table, the others an entry in a sorted list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialise, pieces, trim

#: Bounds of the labelled sample: documents considered per language (smallest hashes first), characters taken from one
#: document (at a hashed place) and kept per language, and characters kept of all languages together.  Every label is
#: learned; where there are so many that the last bound tells, each has an equal share, and ``LEAST_CHARS`` at least.
SAMPLE_DOCS = 96
PIECE_CHARS = 2_000
SAMPLE_CHARS = 40_000
TOTAL_CHARS = 64 * SAMPLE_CHARS
LEAST_CHARS = 200
#: Letters of a language with a column in its dense table; rarer ones are searched for.
ALPHABET = 60
WINDOW = 256
#: Bytes of text parsed at a time.
PIECE_BYTES = 2 << 20
UNKNOWN = "und"
#: Codes of what is no letter, and of letters that are in no sample.
_GAP, _RARE = 0, 1


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def suffix_automaton(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of ``codes``: a table ``(states, width)``, -1 where there is none, and for codes
    from ``width`` on sorted keys ``state << 16 | code`` and the states they lead to."""
    n = 2 * len(codes) + 2
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    assert len(nxt) <= n
    table = np.full((len(nxt), width), -1, np.int32)
    more: list[tuple[int, int]] = []
    for state, moves in enumerate(nxt):
        for c, to in moves.items():
            if c < width:
                table[state, c] = to
            else:
                more.append((state << 16 | c, to))
    keys, ends = np.array(sorted(more), np.int64).reshape(-1, 2).T
    return table, np.ascontiguousarray(keys), ends.astype(np.int32)


class Automaton:
    """One language: entry ``[state, code]`` is twice the next state, plus one where a phrase ended."""

    def __init__(self, codes: np.ndarray, n_codes: int) -> None:
        counts = np.bincount(codes, minlength=n_codes)
        counts[[_GAP, _RARE]] = 0
        own = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        #: From the codes of all languages to this one's: its own letters by falling frequency, any other is _RARE.
        self.local = np.full(n_codes, _RARE, np.min_scalar_type(len(own) + 1))
        self.local[_GAP] = _GAP
        self.local[own] = np.arange(2, len(own) + 2)
        self.width = min(len(own), ALPHABET) + 2
        table, self.keys, self.ends = suffix_automaton(self.local[codes].tolist(), self.width)
        # where the phrase restarts, by code; every letter of the sample leads somewhere from the first state
        self.root = np.zeros(len(own) + 2, np.int32)
        self.root[: self.width] = np.maximum(table[0], 0)
        first = self.keys < 1 << 16
        self.root[self.keys[first]] = self.ends[first]
        missing = table < 0
        table *= 2
        np.copyto(table, 2 * self.root[None, : self.width] + 1, where=missing)
        self.table = table.reshape(-1)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        codes = self.local[codes]
        if not len(self.keys):
            return self.table[state * self.width + codes]
        moved = self.table[state * self.width + np.minimum(codes, self.width - 1)]
        at = np.flatnonzero(codes >= self.width)
        if len(at):
            rare = codes[at]
            key = state[at].astype(np.int64) << 16 | rare
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            moved[at] = np.where(self.keys[place] == key, 2 * self.ends[place], 2 * self.root[rare] + 1)
        return moved


class Model:
    """The automata of all languages, and the codes of all their letters."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        counts: dict[str, int] = {}
        for lang in self.langs:
            for ch in samples[lang].lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(counts, key=lambda ch: (-counts[ch], ch))
        self.code = {ord(ch): i + 2 for i, ch in enumerate(letters)}
        self._lookup = np.zeros(0x110000, np.min_scalar_type(len(letters) + 1))
        self._known = np.zeros(0x110000, bool)
        self.bits = np.array([np.log2(len(samples[lang]) + 2) for lang in self.langs])
        self.automata = [Automaton(self.codes(samples[lang]), len(letters) + 2) for lang in self.langs]

    def codes(self, text: str) -> np.ndarray:
        """Codes of a text: lower case, letters by the alphabet, each run of anything else one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if new := [c for c in np.unique(points[~self._known[points]]).tolist()]:
            for c in new:
                self._lookup[c] = self.code.get(c, _RARE if chr(c).isalpha() else _GAP)
            self._known[new] = True
        out = self._lookup[points]
        return out[(out != _GAP) | np.concatenate(([False], out[:-1] != _GAP))]

    def lettered(self, text: str | None) -> bool:
        return bool(text) and bool((self.codes(text) != _GAP).any())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language, windows parsed side by side."""
        windows, owner = [], []
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), WINDOW):
                windows.append(codes[at : at + WINDOW])
                owner.append(i)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not windows:
            return out
        lengths = np.array([len(w) for w in windows])
        order = np.argsort(-lengths, kind="stable")
        lengths, owner = lengths[order], np.array(owner)[order]
        grid = np.zeros((WINDOW, len(windows)), self._lookup.dtype)
        for column, i in enumerate(order.tolist()):
            grid[: len(windows[i]), column] = windows[i]
        active = np.searchsorted(-lengths, -np.arange(WINDOW), "left")
        for k, automaton in enumerate(self.automata):
            state = np.zeros(len(windows), np.int32)
            count = np.ones(len(windows), np.int32)
            for step in range(int(lengths[0])):
                n = active[step]
                moved = automaton.step(state[:n], grid[step, :n])
                count[:n] += moved & 1
                state[:n] = moved >> 1
            np.add.at(out[:, k], owner, count)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and a score in [0, 1]: how much cheaper the winner is than the runner-up, halved and raised by a half."""
        codes = [self.codes(t) if t else np.zeros(0, self._lookup.dtype) for t in texts]
        lettered = [bool((c != _GAP).any()) for c in codes]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = self.phrases(codes) * self.bits[None, :]
        best = cost.argmin(axis=1)
        ranked = np.sort(cost, axis=1)
        gap = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered, strict=True)]
        return langs, [0.5 + 0.5 * g if ok else 0.0 for g, ok in zip(gap.tolist(), lettered, strict=True)]


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Training text per label, from documents in the order of a hash of their id until the bounds above are reached.

    One pass counts labels; a second takes, by hash, the few documents expected to have the smallest ones and cuts a piece
    of each.  Null texts, null labels and held-out documents teach nothing.  An id counts once, however often it repeats;
    other columns are ignored; an empty table gives no label.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull())
    key = F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0))
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).cast("string").alias("t"))
    labels = materialise(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("first")), "labels")
    each = min(SAMPLE_CHARS, max(LEAST_CHARS, TOTAL_CHARS // max(1, labels.count())))
    most, long = min(SAMPLE_DOCS, each), min(PIECE_CHARS, each)
    # four times as many as needed are expected below the limit; the first is taken whatever its hash
    low = F.pmod("key", F.lit(1 << 40)) < (1 << 40) * F.least(F.lit(1.0), 4.0 * most / F.col("n"))
    start = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.length("t") - long + 1)).cast("int") + 1
    some = rows.join(labels, "lang").where(low | (F.col("key") == F.col("first"))).groupBy("lang", "key").agg(F.min(F.substring(F.col("t"), start, F.lit(long))).alias("t"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 40)), "key"))
    chosen = some.withColumn("place", place).where(F.col("place") <= most).orderBy("lang", "place")
    out: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for lang, text in chosen.select("lang", "t").toLocalIterator():
        if size.get(lang, 0) < each:
            out.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
    return {lang: "\n".join(texts)[:each] for lang, texts in out.items()}


def _model(learned: dict[str, str]) -> Model:
    return kept(("language", hash(tuple(sorted(learned.items())))), lambda: Model(learned))


def identify(docs: DataFrame, learned: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``(id, lang_pred, score)`` for every row, or with ``keep`` the rows whose language is known, all columns unchanged.

    The text alone decides.  A null text, or one without a letter, is ``und`` with score 0, as is any text where nothing
    was learned; ``keep`` then keeps those with a letter.  Whole texts are parsed, in windows.  Ids may be null or repeat, as
    may rows; other columns are ignored or, with ``keep``, passed on whatever their names.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for whole in batches:
            for batch in pieces(whole, batch_text(whole), PIECE_BYTES):
                langs, scores = model.predict(batch.column(batch_text(batch)).to_pylist())
                if keep:
                    texts = batch.column(batch_text(batch)).to_pylist()
                    yield batch.filter(pa.array([x != UNKNOWN if model.langs else model.lettered(t) for x, t in zip(langs, texts, strict=True)]))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])
        trim()

    if keep:
        where = docs.columns.index(text_col)
        batch_text = lambda _: where
        return docs.mapInArrow(run, docs.schema)
    batch_text = lambda _: 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")
