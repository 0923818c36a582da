"""Keyword search: BM25 and BM25+ ranking, postings, symbol and word lookup, line search with context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..session import written

K1, B, DELTA = 1.5, 0.75, 1.0


def query_terms(query: str, unicode_words: bool = False) -> list[str]:
    """Terms of a query as the index has them; BM25 takes each once, BM25+ as often as it occurs."""
    import re

    if unicode_words:
        return [t for t in re.findall(r"\w+", query.lower()) if len(t) >= 3]
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))


def bm25(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of the ``k`` best documents by Okapi BM25; documents without a query term never rank.

    Texts are read and cut once, into a table of lengths and counts of the query's terms.  Its aggregate of one row gives
    the corpus statistics, and only matching documents take part in scoring.
    """
    terms = query_terms(query)
    counted = docs.select(F.col(id_col), T.bm25_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    tf = [_occurrences(w).alias(f"tf{i}") for i, w in enumerate(terms)]
    counted = written(counted.select(id_col, F.size("tokens").alias("dl"), *tf), "bm25")
    stats = counted.agg(
        F.count("*").cast("double").alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("int")).cast("double").alias(f"df{i}") for i in range(len(terms))],
    )
    joined = counted.where(_any([F.col(f"tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    length = F.when(F.col("avgdl") > 0, F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")).otherwise(F.lit(1.0))
    for i in range(len(terms)):
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}").cast("double")
        idf = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
        score = score + F.when(f > 0, idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * length)).otherwise(F.lit(0.0))
    ranked = joined.select(F.col(id_col), F.round(score, 6).alias("score"))
    return ranked.orderBy(F.desc("score"), id_col).limit(max(k, 0))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == term))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def bm25_plus(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` by BM25+: every document gets the lower bound of every query term, repeated terms count again."""
    terms = query_terms(query, unicode_words=True)
    distinct = list(dict.fromkeys(terms))
    counted = docs.select(F.col(id_col), T.episode_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    counted = counted.select(id_col, F.size("tokens").alias("dl"), *[_occurrences(w).alias(f"tf{i}") for i, w in enumerate(distinct)])
    counted = written(counted, "bm25")
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).cast("double").alias(f"df{i}") for i in range(len(distinct))])
    joined = counted.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, w in enumerate(distinct):
        df, f = F.col(f"df{i}"), F.col(f"tf{i}").cast("double")
        length = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")
        part = F.log((F.col("n") + F.lit(1.0)) / df) * (F.lit(DELTA) + f * F.lit(K1 + 1) / (F.lit(K1) * length + f))
        score = score + F.lit(float(terms.count(w))) * F.when(df > 0, part).otherwise(F.lit(0.0))
    ranked = joined.select(F.col(id_col), F.round(score, 6).alias("score")).where("score > 0")
    return ranked.orderBy(F.desc("score"), id_col).limit(max(k, 0))


#: Most ids in a row of postings, and the words after which a part begins another segment.
_LISTED, _HELD = 65_536, 8 << 20


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings ``(term, id, tf, dl)`` of documents ``(id, words)``, by segment in order of terms, the ids of a term in lists.

    The words of a text are joined by spaces, one space before each.  So the empty term is in every document once.
    """
    ids, sizes, coded, held = [], [], [], 0
    for batch in batches:
        words = pc.split_pattern(batch.column("words"), " ")
        ids.append(batch.column("id"))
        sizes.append(pc.list_value_length(words).to_numpy())
        coded.append(words.flatten().dictionary_encode())
        held += len(coded[-1])
        if held >= _HELD:
            yield from _segment(ids, sizes, coded)
            ids, sizes, coded, held = [], [], [], 0
    if held:
        yield from _segment(ids, sizes, coded)


def _segment(ids: list[pa.Array], sizes: list[np.ndarray], coded: list[pa.DictionaryArray]) -> Iterator[pa.RecordBatch]:
    """The segment of documents with their numbers of words and the words of all."""
    id_of, size, words = pa.chunked_array(ids).combine_chunks(), np.concatenate(sizes), pa.chunked_array(coded).unify_dictionaries()
    terms = words.chunk(0).dictionary
    by_term, by_id, n = pc.sort_indices(terms), pc.sort_indices(id_of), len(id_of)
    # a word's key: the place of its term, then that of its document
    rank, place = np.empty(len(terms), np.int64), np.empty(n, np.int64)
    rank[by_term], place[by_id] = np.arange(len(terms)), np.arange(n)
    keys = np.concatenate([rank[c.indices] for c in words.chunks])
    keys *= n
    keys += np.repeat(place, size)
    keys.sort()
    terms, id_of, length = terms.take(by_term), id_of.take(by_id), (size - 1)[by_id].astype(np.int32)
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    keys, tf = keys[ends - 1], np.diff(ends, prepend=0).astype(np.int32)
    for start in range(0, len(keys), _LISTED):
        term, doc = np.divmod(keys[start : start + _LISTED], n)
        rows = np.flatnonzero(np.diff(term, prepend=-1))
        cut = pa.array(np.append(rows, len(term)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, v) for v in (id_of.take(pa.array(doc)), pa.array(tf[start : start + _LISTED]), pa.array(length[doc]))]
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[rows])), *lists], names=["term", "id", "tf", "dl"])


class TextIndex:
    """A BM25 index in a folder: postings ``(term, id, tf, dl)`` in segments, document lengths, corpus statistics.

    It is built once and searched often.  Documents are dealt out by id, and each part writes the postings of its own documents
    in order of terms: a segment, or several one after another where it has very many words.  So a text is cut once, its terms
    are counted within its part, and nothing but texts is shuffled.  A row of a segment lists the documents of one term, so
    neither a build nor a search goes row by row over single postings.  A search reads, of every segment, the pages of the
    query's terms only.  Documents with their lengths are listed under the empty term, at the head of their segment.
    """

    def __init__(self, spark: SparkSession, path: str, unicode_words: bool = False) -> None:
        self.spark, self.path, self.unicode_words = spark, path.rstrip("/"), unicode_words

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", unicode_words: bool = False) -> TextIndex:
        """Index ``docs``; ids must be unique.  With ``unicode_words`` terms are those of BM25+."""
        index = cls(docs.sparkSession, path, unicode_words)
        cut = T.episode_tokens if unicode_words else T.bm25_tokens
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # a few segments per split of the input: they grow in number, not in size
        texts = texts.repartition(4 * max(1, docs.rdd.getNumPartitions()), "id")
        words = texts.select("id", F.array_join(F.concat(F.array(F.lit("")), cut("text")), " ").alias("words"))
        lists = [StructField(c, ArrayType(t)) for c, t in (("id", words.schema["id"].dataType), ("tf", IntegerType()), ("dl", IntegerType()))]
        postings = words.mapInArrow(_segments, StructType([StructField("term", StringType()), *lists]))
        postings.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{index.path}/postings")
        index.lengths().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{index.path}/stats")
        return index

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        return self._lists().where("term <> ''").select("term", F.inline(F.arrays_zip("id", "tf", "dl")))

    def lengths(self) -> DataFrame:
        return self._lists().where("term = ''").select(F.inline(F.arrays_zip("id", "dl")))

    def _found(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """Postings of the terms; beside each term its document frequency and the corpus statistics."""
        lists = self._lists().where(F.col("term").isin(terms)) if terms else self._lists().limit(0)
        # as many rows as the query has terms, and one row
        df = lists.groupBy("term").agg(F.sum(F.size("id")).cast("double").alias("df"))
        return lists.select("term", F.inline(F.arrays_zip("id", "tf", "dl"))), df.crossJoin(F.broadcast(self.spark.read.parquet(f"{self.path}/stats")))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """``(id, score)`` of the ``k`` best by Okapi BM25, as ``bm25`` gives them."""
        length = F.when(F.col("avgdl") > 0, F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")).otherwise(F.lit(1.0))
        idf = F.log((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0))
        part = idf * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * length)
        found, terms = self._found(query_terms(query, self.unicode_words))
        scored = found.join(F.broadcast(terms), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(max(k, 0))

    def search_plus(self, query: str, k: int = 10) -> DataFrame:
        """``(id, score)`` by BM25+, as ``bm25_plus`` gives them: documents without a term have the lower bound alone."""
        terms = query_terms(query, self.unicode_words)
        times = F.lit(0)
        for term in dict.fromkeys(terms):
            times = F.when(F.col("term") == term, F.lit(terms.count(term))).otherwise(times)
        idf = times * F.log((F.col("n") + F.lit(1.0)) / F.col("df"))
        found, weights = self._found(list(dict.fromkeys(terms)))
        weights = weights.withColumn("idf", idf)
        least = weights.agg(F.coalesce(F.sum("idf") * DELTA, F.lit(0.0)).alias("least"))
        length = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")
        more = F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.lit(K1) * length + F.col("tf"))
        hits = found.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(more).alias("more"))
        rest = self.lengths().select("id").join(hits, "id", "left_anti").orderBy("id").limit(max(k, 0)).withColumn("more", F.lit(0.0))
        both = hits.unionByName(rest).crossJoin(F.broadcast(least)).select("id", F.round(F.col("least") + F.col("more"), 6).alias("score"))
        return both.where("score > 0").orderBy(F.desc("score"), "id").limit(max(k, 0))


def postings(docs: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """Distinct ``(word, key...)``."""
    return docs.select(F.explode(F.array_distinct(T.text_terms(text_col))).alias("word"), *key_cols).distinct()


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored form of a BM25 index: ``(term, id, tf)``."""
    return docs.select(F.col(id_col), F.explode(T.bm25_tokens(text_col)).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))


def lookup(symbols: DataFrame, name: str, name_col: str = "name", ignore_case: bool = False) -> DataFrame:
    """Rows of one symbol, by exact name, or whatever the case where no exact one exists and ``ignore_case`` is set."""
    exact = symbols.where(F.col(name_col) == name)
    if ignore_case and exact.isEmpty():
        return symbols.where(F.lower(F.col(name_col)) == name.lower())
    return exact


def lookup_word(index: DataFrame, symbols: DataFrame, word: str) -> DataFrame:
    """``(file, line)`` of a word, else of the symbol of that name."""
    found = index.where(F.col("word") == word.lower()).select("file", "line")
    if found.isEmpty():
        found = symbols.where(F.col("name") == word).select("file", F.col("start_line").alias("line"))
    return found.orderBy("file", "line")


def reverse_index(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", "file", F.col("start_line").alias("line"))


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def grep(docs: DataFrame, query: str, around: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, line, context)`` of lines that hold ``query`` in any case, with the lines around them.

    Documents without a match are dropped before lines are split, and context is cut from the document's own array of
    lines, so nothing is shuffled.
    """
    low = query.lower()
    hits = docs.where(F.lower(text_col).contains(low)).select(id_col, F.split(text_col, "\n").alias("lines"))
    each = hits.select(id_col, "lines", F.posexplode("lines").alias("at", "line")).where(F.lower("line").contains(low))
    start = F.greatest(F.col("at") - around, F.lit(0))
    context = F.array_join(F.slice("lines", start + 1, F.col("at") + around + 1 - start), "\n")
    return each.select(id_col, (F.col("at") + 1).alias("n"), "line", context.alias("context"))


def window_around(docs: DataFrame, line: Column, around: int = 15, text_col: str = "text") -> Column:
    """The lines around a line of a text, joined again."""
    start = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(F.split(text_col, "\n"), start, line + around + 1 - start), "\n")


def keyword_match(rows: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Rows whose text holds any word of the query."""
    words = F.array(*[F.lit(w) for w in query.lower().split()]) if query.split() else F.array().cast("array<string>")
    return rows.where(F.exists(words, lambda w: F.contains(F.lower(F.col(text_col)), w)))


def fast_path(docs: DataFrame, index: DataFrame, word: str, path_col: str = "file") -> DataFrame:
    """Documents that the index names for a word, each once."""
    return docs.join(index.where(F.col("name") == word).select(F.col("file").alias(path_col)).distinct(), path_col, "left_semi")


def containing_symbol(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol around each ``(file, line)``: greatest start at or before it, with an end at or after it.

    A symbol's lines are cut into blocks of a power of two, at most two of each size, and a block keeps the innermost of
    its symbols; a line lies in one block of each size.  So lines and symbols of a file never meet in pairs: a line looks
    up one row per size of block that there is, thirty at most.
    """
    others = [c for c in symbols.columns if c not in ("file", "start_line", "end_line", "name")]
    rank = F.struct((-F.col("start_line")).alias("before"), "end_line", "name", "start_line", *others)
    sized = symbols.where("end_line >= start_line").withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(30))))
    sized = sized.withColumn("low", F.expr("shiftright(cast(start_line as bigint) + shiftleft(1L, size) - 1, size)")).withColumn("high", F.expr("shiftright(cast(end_line as bigint) + 1, size)"))
    # a block stands where it lies within the symbol and the block twice its size does not
    ends = F.array(F.when(F.col("low") % 2 != 0, F.col("low")), F.when(F.col("high") % 2 != 0, F.col("high") - 1))
    blocks = sized.where("low < high").select("file", "size", rank.alias("symbol"), F.explode(F.array_compact(ends)).alias("block"))
    best = written(blocks.groupBy("file", "size", "block").agg(F.min("symbol").alias("symbol")), "blocks")
    sizes = [r["size"] for r in best.select("size").distinct().collect()]  # 31 at most
    each = lines.dropDuplicates(["file", "line"])
    keys = each.select("file", "line", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("size"))
    keys = keys.withColumn("block", F.expr("shiftright(cast(line as bigint), size)"))
    found = keys.join(best, ["file", "size", "block"]).groupBy("file", "line").agg(F.min("symbol").alias("symbol"))
    return each.join(found, ["file", "line"]).select(*lines.columns, *[F.col(f"symbol.{c}").alias(c) for c in symbols.columns if c != "file"])
