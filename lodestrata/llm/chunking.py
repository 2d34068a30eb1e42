"""Content-defined pieces of oversized texts.

Rolling-hash landmarks depend only on the characters just before them, so an edit moves the cuts near it and no others. Each
cut snaps from a landmark to the nearest natural boundary; where none lies within reach, the cut is forced at the landmark.
Consecutive pieces overlap by a given number of characters.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: U+0085 is no white space here: in stored texts it is a byte of a garbled letter, hardly ever a line break.
_SPACE = re.compile(r"[^\S\x85]+")
_BREAK = re.compile("[\n\r\v\f\x1c-\x1e\u2028\u2029]")
_WINDOW = 48


def boundaries(text: str) -> list[tuple[int, int]]:
    """(end of the piece before, start of the piece after) of every natural boundary, the ends of the text included.

    The white space of a boundary belongs to neither side.
    """
    n = len(text)
    found = [(0, len(text) - len(text.lstrip()))]
    for m in _SPACE.finditer(text):
        if found[-1][1] < m.start() and m.end() < n and (text[m.start() - 1] in ".!?" or _BREAK.search(m.group())):
            found.append((m.start(), m.end()))
    found.append((max(len(text.rstrip()), found[-1][1]), n))
    return found


def landmarks(text: str, mean: int) -> np.ndarray:
    """Positions whose preceding window's polynomial hash has its low bits zero, about one in `mean` characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) <= _WINDOW:
        return np.empty(0, np.int64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        rolling = np.zeros(len(codes) - _WINDOW + 1, np.uint64)
        for k in range(_WINDOW):  # the window's hash at every position at once
            rolling = rolling * base + mixed[k : k + len(rolling)]
    bits = max(1, int(np.log2(mean)))
    return np.nonzero((rolling >> np.uint64(64 - bits)) == 0)[0] + _WINDOW


def split(text: str, most: int = 1200, overlap: int = 150, least: int = 300) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of `text`, each of at most `most` characters.

    forced: the cut at the piece's end is at no natural boundary, which happens only where more than `most` characters lie between
    two neighbouring boundaries. The overlap shrinks, down to none, only where a stretch between two boundaries leaves no room
    for it. A text of at most `most` characters is one piece; an empty text gives none.
    """
    if len(text) <= most:
        return [(0, len(text), False)] if text else []
    edges = boundaries(text)
    ends = np.array([a for a, _ in edges[1:]])
    starts = np.array([b for _, b in edges[:-1]])
    last = int(ends[-1])
    marks = landmarks(text, 256)
    pieces: list[tuple[int, int, bool]] = []
    at = int(starts[0])  # where new text begins
    while True:
        begin = at if not pieces else max(pieces[-1][0] + 1, at - overlap)
        if last - begin > most:
            nearest = int(ends[np.searchsorted(ends, at, side="right")])
            if nearest - begin > most:  # a natural cut needs room beside the overlap: give up as much of it as that takes
                first = max(at, int(starts[np.searchsorted(ends, at, side="right")]))
                begin = nearest - most if nearest - first <= most else begin
        if last - begin <= most:
            pieces.append((begin, last, False))
            return pieces
        low, high = begin + least, begin + most
        inside = marks[(marks > max(low, at)) & (marks <= high)]
        target = int(inside[-1]) if len(inside) else high
        reach = ends[(ends > at) & (ends <= high)]
        if len(reach):
            good = reach[reach >= low] if (reach >= low).any() else reach[-1:]
            at = int(good[np.abs(good - target).argmin()])
        else:
            at = target
        pieces.append((begin, at, not len(reach)))


def forced_cut(text: str, most: int = 1200) -> bool:
    """Whether more than `most` characters lie between two neighbouring natural boundaries."""
    edges = boundaries(text)
    return any(b - a > most for (_, a), (b, _) in zip(edges, edges[1:], strict=False))


def split_oversized(chunks: DataFrame, most: int = 1200, overlap: int = 150) -> DataFrame:
    """Pieces of the chunks with more than `most` characters (code points as stored):
    chunk_id, piece, content, char_start, char_end, section, forced.

    char_start and char_end count from the chunk's own, or are null where that is. forced tells of the whole chunk whether some
    stretch between natural boundaries exceeds `most`. Null and shorter contents give no rows, repeated rows repeat.
    """
    long = chunks.filter(F.char_length("content") > most).select(F.col("id").alias("chunk_id"), "content", "char_start", "section")
    schema = "chunk_id long, piece int, content string, char_start int, char_end int, section string, forced int"

    def cut(batches):
        for pdf in batches:
            rows = []
            for cid, text, start, section in pdf.itertuples(index=False, name=None):
                pieces = split(text, most, overlap)
                forced = int(any(f for _, _, f in pieces))
                base = None if start is None or start != start else int(start)
                for k, (a, b, _) in enumerate(pieces):
                    rows.append((cid, k, text[a:b], None if base is None else base + a, None if base is None else base + b, section, forced))
            if rows:
                out = pd.DataFrame(rows, columns=["chunk_id", "piece", "content", "char_start", "char_end", "section", "forced"])
                yield out.astype({"char_start": "Int32", "char_end": "Int32"})

    return long.mapInPandas(cut, schema)
