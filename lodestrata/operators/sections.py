"""Sections and overlapping windows of narrative text, with offsets.

Finding boundaries is per-row work on one text; everything after it (numbering, filtering, keys) is columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headings of a filing's items and parts, and where a sentence ends.
HEADING = re.compile(r"^\s*(Item\s+\d+[A-Z]?\.?[^\n]{0,80}|PART\s+[IVX]+[^\n]{0,40})\s*$", re.IGNORECASE | re.MULTILINE)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def section_spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, heading) of the sections, which cover the text; what precedes the first heading has none."""
    starts = [(m.start(), m.group(1).strip()) for m in HEADING.finditer(text)]
    if not starts or starts[0][0] > 0:
        starts.insert(0, (0, None))
    ends = [s for s, _ in starts[1:]] + [len(text)]
    return [(s, e, name) for (s, name), e in zip(starts, ends, strict=True)]


def window_spans(text: str, start: int, end: int, target: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of windows of at most `target` characters that end with a sentence where one ends in time."""
    stops = [m.start() for m in SENTENCE_END.finditer(text, start, end)]
    spans, at, k = [], start, 0
    while at < end:
        to = min(at + target, end)
        if to < end:
            while k < len(stops) and stops[k] <= to:
                k += 1
            j = k
            if j and stops[j - 1] > at:
                to = stops[j - 1]
        spans.append((at, to))
        if to >= end:
            break
        at = to - overlap if to - overlap > at else to
        while k and stops[k - 1] > at:
            k -= 1
    return spans


def chunk_texts(texts: DataFrame, target: int = 1200, overlap: int = 150) -> DataFrame:
    """doc_id, ordinal, content, char_start, char_end, section; content is the text between its offsets, without outer white space.

    Windows do not cross sections; blank ones are dropped and the rest numbered from 0. Null and blank texts give no rows.
    """
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap below it")

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, text in pdf.itertuples(index=False, name=None):
                n = 0
                for s, e, name in section_spans(text or ""):
                    for a, b in window_spans(text or "", s, e, target, overlap):
                        piece = text[a:b]
                        a += len(piece) - len(piece.lstrip())
                        piece = piece.strip()
                        if piece:
                            rows.append((doc, n, piece, a, a + len(piece), name))
                            n += 1
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "content", "char_start", "char_end", "section"])

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *T._parse_datatype_string("ordinal int, content string, char_start int, char_end int, section string").fields])
    return texts.select("doc_id", "text").filter("text is not null").mapInPandas(cut, schema)


def misplaced(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks whose offsets do not give their content back."""
    both = chunks.join(texts.select("doc_id", "text"), "doc_id")
    return both.filter(F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("content")).drop("text")
