"""Chunks of documents and sources, as column expressions: cut a text, pack what is too fine, keep what is worth it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# Where documents and sources are cut, and the lengths of chunks.
HEADING = r"(?m)^#{2,}\s+"
PARAGRAPH = r"\n{2,}"
CODE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".rs", ".rb")
CODE_CUT = r"(?m)^(?=(?:def |class |func |function |public |private |protected ))"
PROSE_EXTENSIONS = (".md", ".rst", ".txt")
PROSE_CUT = r"(?m)^(?=#{1,3} |\n{2,})"
MARKDOWN_MOST, MARKDOWN_LEAST, MARKDOWN_CHUNKS = 1800, 60, 30
SOURCE_WIDTH, SOURCE_MOST, SOURCE_LEAST, SOURCE_CHUNKS = 800, 1200, 60, 40


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def packed(parts: Column, most: int, glue: str = "\n\n") -> Column:
    """Neighbouring parts glued together as long as a pack has ``most`` characters at most; longer parts stay whole."""
    none = F.array().cast("array<string>")

    def add(packs: Column, part: Column) -> Column:
        last = F.element_at(packs, -1)
        fits = (F.size(packs) > 0) & (F.length(last) + len(glue) + F.length(part) <= most)
        alone = F.concat(packs, F.array(part))
        return F.when(fits, F.concat(F.slice(packs, 1, F.size(packs) - 1), F.array(F.concat(last, F.lit(glue), part)))).otherwise(alone)

    # element_at of an empty array is never looked at but must not fail
    seeded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), add)
    return F.when(F.size(parts) > 0, seeded).otherwise(none)


def pieces(text: Column, width: int) -> Column:
    """A text in pieces of ``width`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    return F.transform(starts, lambda at: F.substr(text, at + 1, F.lit(width)))


def _worth(chunks: Column, least: int, count: int | None) -> Column:
    kept = F.filter(chunks, lambda c: F.length(c) >= least)
    return kept if count is None else F.slice(kept, 1, count)


def markdown(text: Column | str, source: Column | str | None = None, most: int = MARKDOWN_MOST, least: int = MARKDOWN_LEAST, count: int | None = MARKDOWN_CHUNKS) -> Column:
    """Sections below second-level headings, those over ``most`` characters packed from their paragraphs.

    Chunks under ``least`` characters are left out; the first ``count`` of a document stay, or all where it is None.
    """
    sections = F.transform(F.split(F.coalesce(col(text), F.lit("")), HEADING), stripped)
    fine = lambda s: F.filter(F.transform(F.split(s, PARAGRAPH), stripped), lambda p: p != "")
    return _worth(F.flatten(F.transform(sections, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(packed(fine(s), most)))), least, count)


def source(text: Column | str, path: Column | str, most: int | None = SOURCE_MOST, least: int = SOURCE_LEAST, count: int | None = SOURCE_CHUNKS) -> Column:
    """Pieces of a file, cut by what its extension says: at definitions, at headings and gaps, or every 800 characters.

    ``most`` cuts chunks off, ``count`` keeps a file's first; None keeps all of either.
    """
    text, kind = F.coalesce(col(text), F.lit("")), F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))
    parts = F.when(kind.isin(*CODE_EXTENSIONS), F.split(text, CODE_CUT)).when(kind.isin(*PROSE_EXTENSIONS), F.split(text, PROSE_CUT)).otherwise(pieces(text, SOURCE_WIDTH))
    kept = _worth(F.transform(parts, stripped), least, count)
    return kept if most is None else F.transform(kept, lambda c: F.substring(c, 1, most))


def chunks(docs: DataFrame, how=markdown, source_col: str = "source", text_col: str = "text", **limits: int | None) -> DataFrame:
    """``(source, position, text)`` of every document by ``how``."""
    found = how(F.col(text_col).cast("string"), F.col(source_col).cast("string"), **limits)
    return docs.select(F.col(source_col).cast("string").alias("source"), F.posexplode(found).alias("position", "text"))
