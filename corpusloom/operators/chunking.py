"""Splitting documents into chunks by a recursive, overlapping character rule."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import chunk_header, content_hash
from corpusloom.session import small_batches, spread

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _joined(bounds: Sequence[int], low: int, high: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of pieces joined up to size; each begins with the last pieces of the one before, up to overlap. Pieces lie between bounds."""
    out, first = [], low
    while True:
        last = bisect_right(bounds, bounds[first] + size, first, high + 1) - 1
        out.append((bounds[first], bounds[last]))
        if last == high:
            return out
        first = min(last, bisect_left(bounds, max(bounds[last] - overlap, bounds[last + 1] - size), first, last))


def _spans(text: str, start: int, end: int, size: int, overlap: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """The first separator that occurs parts the text and stays with the part that follows; parts still too long go on with the next ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, start, end) >= 0), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    if not separator:
        return _joined(range(start, end + 1), 0, end - start, size, overlap)
    found = [m.start() for m in re.compile(re.escape(separator)).finditer(text, start, end)]
    bounds = [start, *(f for f in found if f > start), end]
    out: list[tuple[int, int]] = []
    low = 0
    for i in np.flatnonzero(np.diff(bounds) >= size).tolist():
        if i > low:
            out += _joined(bounds, low, i, size, overlap)
        out += _spans(text, bounds[i], bounds[i + 1], size, overlap, rest) if rest else [(bounds[i], bounds[i + 1])]
        low = i + 1
    if low < len(bounds) - 1:
        out += _joined(bounds, low, len(bounds) - 1, size, overlap)
    return out


def split_text(text: str, size: int = 500, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text, white space off their ends. Cut places are found once and chunks are slices between them."""
    parts = (text[a:b].strip() for a, b in _spans(text, 0, len(text), size, overlap, separators)) if text else ()
    return [p for p in parts if p]


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """chunk_id, parent_id, url, title, content_hash, chunk_index, total_chunks, page_content.

    docs: id, url, title, content, status and, for the header, category, date and source, each
    empty where it is null or lacks. A bare title, or a title and body of at most `size`
    characters, is one chunk; else the body is split and a header stands before each part, so
    that a chunk may exceed `size`. A document without status is chunked as any other.
    """
    small_batches(docs.sparkSession)
    held = set(docs.columns)
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in held else F.lit("")

    @F.pandas_udf("array<string>")
    def split(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [] if b is None else split_text(b, size, overlap))

    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    rows = spread(docs.select("id", "url", bare(given("title")).alias("title"), bare(given("content")).alias("content"), given("status").alias("status"),
                              given("category").alias("category"), given("date").alias("date"), given("source").alias("source")))
    whole = F.concat("title", F.lit("\n"), "content")
    one = (F.col("status") == "title_only") | (F.col("content") == "") | (F.col("content") == F.col("title")) | (F.length(whole) <= size)
    header: Column = chunk_header(F.col("category"), F.col("title"), F.col("date"), F.col("source"))
    # Bodies that stay whole reach the splitter as null, which costs it nothing.
    parts = split(F.when(~one, F.col("content")))
    cut = rows.withColumn("_parts", F.when(one, F.array(whole)).otherwise(F.transform(parts, lambda p: F.concat(header, F.lit("\n\n"), p))))
    chunks = cut.select("id", "url", "title", content_hash(F.col("title"), F.col("content")).alias("content_hash"), F.size("_parts").alias("total_chunks"), F.posexplode("_parts").alias("chunk_index", "page_content"))
    return chunks.select(
        F.concat("id", F.lit("_c"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("id").alias("parent_id"), "url", "title", "content_hash", "chunk_index", "total_chunks", "page_content"
    )
