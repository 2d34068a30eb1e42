"""Records decoded with the wrong character encoding: found, and restored where possible.

Adjacent character pairs are scored by their share of the corpus's mutual information, counted exactly over every distinct text. Runs of pairs that contribute next to nothing are isolated as maximum-scoring segments, and inverse byte mappings
are tried on the non-ASCII stretches inside such runs; a reading is taken if the corpus finds it more likely. Garbling so frequent
that its pairs look usual is found by its bytes: stretches that hold a misread UTF-8 sequence are read wherever they stand.
"""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import uuid
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.encoding import HIGH, WRONG_READERS, char_bytes, one_byte_readings, utf8_sequences
from lodestrata.session import cut

#: Pairs that the model holds in memory, the most frequent ones; where a corpus has more, all lie in files beside every executor.
MOST_PAIRS = 1 << 19
_CHARS = 0x110000
_START, _END = "\x02", "\x03"
#: Share of all pairs, the least telling ones first, that counts as improbable.
RARE_SHARE = 0.05
#: Log advantage that a one-byte reading needs over the text as it stands, unless its characters are RARE_CHAR times as usual.
MARGIN = 3.0
RARE_CHAR = 50.0


@cache
def _sure() -> dict[str, re.Pattern]:
    """Per wrong reader the misread sequences that no sound text holds: those of usual punctuation and signs, and accented letters
    whose second byte is read as a sign that follows no letter. Closing quotes, dashes, letters and frames may follow one."""
    signs = [chr(c) for a, b in ((0x2010, 0x2028), (0x2030, 0x2045), (0x20A0, 0x20C1), (0x2100, 0x2150), (0x2190, 0x2300)) for c in range(a, b)]
    found = {}
    for reader in WRONG_READERS:
        if reader == "gbk":  # the first two bytes of such punctuation and of full-width signs
            found[reader] = re.compile(r"[鈥锛銆][^\x00-\x7f]")
            continue
        read = {chr(i): c for i in range(128, 256) for c in [bytes([i]).decode(reader, "replace")] if c != "\ufffd"}
        if reader == "cp1252":
            read |= {chr(i): chr(i) for i in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
        wrong = ["".join(read.get(chr(b), "") for b in c.encode()) for c in signs]
        wrong = [w for w in wrong if len(w) == 3]
        for c in map(chr, range(0xA0, 0x100)):
            w = "".join(read.get(chr(b), "") for b in c.encode())
            if len(w) == 2 and not "\u2500" <= w[1] <= "\u259f" and (w[1] in "·¡¿§¶ªº" or unicodedata.category(w[1])[0] in "SNC"):
                wrong.append(w)
        found[reader] = re.compile("|".join(map(re.escape, wrong)))
    return found


@cache
def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every character up to U+FFFF the readers, as bits, that read it from a first byte of a UTF-8 sequence, and from a later one."""
    first, later = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for bit, reader in enumerate(r for r in WRONG_READERS if r != "gbk"):
        for i in range(0x80, 0xF5):
            char = bytes([i]).decode(reader, "replace")
            char = chr(i) if char == "\ufffd" and reader == "cp1252" else char
            if char != "\ufffd":
                (later if i < 0xC0 else first)[ord(char)] |= 1 << bit
    return first, later


def _hints(codes: np.ndarray) -> np.ndarray:
    """Which adjacent pairs may be misread UTF-8 by their bytes, or hold a replacement character."""
    first, later = _byte_kinds()
    low = np.minimum(codes, 0xFFFF)
    by_bytes = (first[low[:-1]] & later[low[1:]]) > 0
    return by_bytes | np.isin(low[:-1], [0xFFFD, *map(ord, "鈥锛銆")]) | (low[1:] == 0xFFFD)


def _codes(texts: list[str]) -> np.ndarray:
    joined = _START + (_END + _START).join(texts) + _END
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """One number per adjacent pair, exact."""
    return codes[:-1].astype(np.int64) << 21 | codes[1:].astype(np.int64)


def count_pairs(texts: DataFrame) -> DataFrame:
    """pair (first character << 21 | second), n among distinct texts, so that copies make nothing usual, and rows among all rows; nulls
    count for nothing. Every task hands on its distinct pairs."""

    def count(batches):
        known = np.empty(0, np.int64), np.empty((0, 2), np.int64)

        def merged(parts):
            pair, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            sums = np.zeros((len(pair), 2), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in parts]))
            return pair, sums

        waiting = []
        for pdf in batches:
            pdf = pdf[pdf.text.str.len() > 0]
            for start in range(0, len(pdf), 2000):
                text = pdf.text.iloc[start : start + 2000].tolist()
                codes = _codes(text)
                copies = np.repeat(pdf.copies.to_numpy()[start : start + 2000], [len(t) + 2 for t in text])[: len(codes) - 1]
                pair, at = np.unique(_pairs(codes), return_inverse=True)
                waiting.append((pair, np.stack([np.bincount(at), np.bincount(at, copies).astype(np.int64)], axis=1)))
                if sum(len(p) for p, _ in waiting) > 2_000_000:
                    known, waiting = merged([known, *waiting]), []
        pair, sums = merged([known, *waiting])
        yield pd.DataFrame({"pair": pair, "n": sums[:, 0], "rows": sums[:, 1]})

    each = texts.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return each.mapInPandas(count, "pair long, n long, rows long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def pair_model(texts: DataFrame) -> PairModel:
    """The model of all texts: counts are made over the whole corpus; into the driver's memory come at most MOST_PAIRS pairs, one row per
    character, and a histogram of counts by eighths of powers of two. Where there are more pairs, all are looked up in files."""
    counts = cut(count_pairs(texts))
    size = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy(size.alias("size")).agg(F.sum("n").alias("mass"), F.min("n").alias("least")).orderBy("size").toPandas()
    chars = counts.groupBy(F.shiftright("pair", 21).cast("int").alias("char")).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).toPandas()
    top = counts.orderBy(F.desc("n"), "pair").limit(MOST_PAIRS).toPandas()
    return PairModel(top, chars, histogram, _pair_files(counts) if len(top) == MOST_PAIRS else "")


#: The arrays of all pairs that are kept in files, each in the order of the pairs.
_KEPT = ("pair", "n", "rows")


def _pair_files(counts: DataFrame) -> str:
    """The name of three files, shipped to every executor, that hold all pairs and their counts; they pass through the driver a
    partition at a time."""

    def packed(batches):
        for pdf in batches:
            yield pd.DataFrame({c: [pdf[c].to_numpy(np.int64).tobytes()] for c in _KEPT})

    name, folder = f"pairs-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="lodestrata-")
    paths = [os.path.join(folder, f"{name}.{c}") for c in _KEPT]
    files = [open(p, "wb") for p in paths]  # noqa: SIM115
    for row in counts.orderBy("pair").select(*_KEPT).mapInPandas(packed, ", ".join(f"{c} binary" for c in _KEPT)).toLocalIterator():
        for file, data in zip(files, row, strict=True):
            file.write(data)
    for file, path in zip(files, paths, strict=True):
        file.close()
        counts.sparkSession.sparkContext.addFile(path)
    return name


class PairModel:
    """Log contribution of character pairs to the corpus's mutual information, and the level below which a pair is improbable.

    files: the name of the files of all pairs (see _pair_files), if `pairs` are not all."""

    def __init__(self, pairs: pd.DataFrame, chars: pd.DataFrame, histogram: pd.DataFrame, files: str = "") -> None:
        pairs = pairs.sort_values("pair")
        self.files, self._open = files, None
        self.total, self.row_total = max(1.0, float(chars.n.sum())), max(1.0, float(chars["rows"].sum()))
        self.codes = pairs.pair.to_numpy(np.int64)
        self.pairs = (pairs.n.to_numpy() / self.total).astype(np.float32)
        self.row_pairs = (pairs["rows"].to_numpy() / self.row_total).astype(np.float32)
        self.chars, self.row_chars = np.zeros(_CHARS, np.float32), np.zeros(_CHARS, np.float32)
        self.chars[chars.char], self.row_chars[chars.char] = chars.n / self.total, chars["rows"] / self.row_total
        mass = np.cumsum(histogram.mass.to_numpy(float)) / self.total
        usual = histogram.least.iloc[min(len(histogram) - 1, int(np.searchsorted(mass, RARE_SHARE)))] / self.total if len(histogram) else 1.0
        self.level = float(np.log(usual * 6.0 + 1e-12))

    def _shares(self, codes: np.ndarray, rows: bool = False) -> np.ndarray:
        """Share of every adjacent pair, 0 where the corpus lacks it."""
        if not len(self.codes):
            return np.zeros(max(0, len(codes) - 1), np.float32)
        pair = _pairs(codes)
        at = np.minimum(np.searchsorted(self.codes, pair), len(self.codes) - 1)
        held = self.codes[at] == pair
        shares = np.where(held, (self.row_pairs if rows else self.pairs)[at], np.float32(0.0))
        if self.files and not held.all():
            shares[~held] = self._rare_shares(pair[~held], rows)
        return shares

    def _rare_shares(self, pair: np.ndarray, rows: bool) -> np.ndarray:
        """The same, from the files, of which only the pages that are looked at come into memory."""
        if self._open is None:
            self._open = [np.memmap(SparkFiles.get(f"{self.files}.{c}"), np.int64, "r") for c in _KEPT]
        codes, n, row_n = self._open
        asked, back = np.unique(pair, return_inverse=True)
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        share = (row_n[at] / self.row_total if rows else n[at] / self.total).astype(np.float32)
        return np.where(codes[at] == asked, share, np.float32(0.0))[back]

    def contributions(self, codes: np.ndarray) -> np.ndarray:
        """log of p(ab) * log2(p(ab) / p(a)p(b)) of every adjacent pair; unseen pairs as if half seen."""
        p = np.maximum(self._shares(codes), 0.25 / self.total)
        single = np.maximum(self.chars[codes], 0.5 / self.total)
        mutual = np.log2(np.maximum(p / (single[:-1] * single[1:]), 1.5))
        return np.log(p * mutual)

    def likely(self, text: str, lead: str, trail: str, rows: bool = False) -> np.ndarray:
        """Log probability, among distinct texts or all rows, of every pair of `text` between its neighbours; unseen pairs as if a quarter seen."""
        codes = np.frombuffer((lead + text + trail).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.log(np.maximum(self._shares(codes, rows), 0.25 / (self.row_total if rows else self.total)))

    def rarest(self, text: str, rows: bool = False) -> float:
        """Share, among distinct texts or all rows, of the rarest character of `text`, as if a quarter seen where it is unseen."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, total = (self.row_chars, self.row_total) if rows else (self.chars, self.total)
        return float(np.maximum(chars[codes], 0.25 / total).min())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of all maximal scoring segments, in one pass over stretches of one sign."""
    if not len(scores):
        return []
    starts = np.concatenate([[0], np.nonzero((scores[1:] > 0) != (scores[:-1] > 0))[0] + 1])
    sums = np.add.reduceat(scores, starts).tolist()
    edges = [*starts.tolist(), len(scores)]
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total through
    total = 0.0
    for i, s in enumerate(sums):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (edges[i], edges[i + 1], before, total)
        while True:
            j = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < new[2]), None)
            if j is None or found[j][3] >= new[3]:
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
        found.append(new)
    return [(a, b) for a, b, _, _ in found]


def _cut_short(run: str, after: str) -> bool:
    """Whether a two-byte reader swallowed the start of a UTF-8 sequence and lost its end to a question mark."""
    data = char_bytes(run[-1], "gbk")
    return after == "?" and data is not None and len(data) == 2 and 0xE1 <= data[0] <= 0xEF and 0x80 <= data[1] <= 0xBF


def read_run(run: str, before: str, after: str, model: PairModel, usual: bool = False) -> tuple[str, bool]:
    """(what the run stood for, whether it is garbled); an unrestorable run is garbled and stays as it is.

    Misread UTF-8 is taken unless the corpus finds the reading far less likely; a two-byte reader and a mix-up of one-byte
    encodings, which nearly any text allows, only where the corpus finds it more likely. In a run of `usual` pairs misread UTF-8 too
    must be more likely, and one-byte encodings aren't tried. Sequences that no sound text holds are always taken.
    """
    if "�" in run:
        return run, True
    text = run
    for _ in range(3):
        best, gain = text, -100.0
        now = float(model.likely(text, before, after).mean())
        for reader in WRONG_READERS:
            other, fixed = utf8_sequences(text, reader)
            if not fixed:
                continue
            if "�" in other:
                return run, True
            better = float(model.likely(other, before, after).mean()) - now
            long = any(len(c.encode("utf-8")) > 2 for c in other if c not in text)
            least = -100.0 if _sure()[reader].search(text) else 0.0 if usual or reader == "gbk" else -6.0 if long or fixed > 1 else -2.5
            if better > least and better > gain:
                best, gain = other, better
        if best == text:
            break
        text = best
    if text != run:
        return text, True
    if usual:
        return run, False
    if _cut_short(run, after):
        return run, True
    # sound copies speak for a reading, garbled ones not for the run, but the more frequent of the two is the sound one
    now, copied = model.likely(run, before, after), float(model.likely(run, before, after, rows=True).mean())
    best, gain = run, 0.0
    for other in one_byte_readings(run):
        there = model.likely(other, before, after, rows=True)
        if there.mean() - copied < 0.7:
            continue
        better = there - now
        common = model.rarest(other, rows=True) > RARE_CHAR * model.rarest(run)
        if (better.min() > 1.0 and better.mean() > MARGIN or common and better.min() > -0.5 and better.mean() > 0.7) and better.mean() > gain:
            best, gain = other, float(better.mean())
    return best, best != run


def read_texts(texts: list[str], model: PairModel, known: dict | None = None) -> list[tuple[int, str, bool]]:
    """(index, restored text, whether all of it could be restored) of the garbled ones among `texts`.

    known: readings of runs between their neighbours, kept from call to call.
    """
    known = {} if known is None else known
    at = [i for i, t in enumerate(texts) if t and not t.isascii()]
    if not at:
        return []
    codes = _codes([texts[i] for i in at])
    scores = model.level - model.contributions(codes)
    high = codes > 127
    touch = (scores > 0) & (high[:-1] | high[1:])
    lengths = np.array([len(texts[i]) + 2 for i in at])
    begins = np.cumsum(lengths) - lengths
    hints = _hints(codes)
    touched = np.add.reduceat(np.append(touch | hints, False), begins) > 0
    out = []
    for n in np.nonzero(touched)[0]:
        text, begin, end = texts[at[n]], int(begins[n]), int(begins[n] + lengths[n])
        own, hit, hint = scores[begin : end - 1], touch[begin : end - 1], hints[begin : end - 1]
        improbable = np.zeros(end - begin, bool)  # characters inside improbable runs
        for a, b in maximal_segments(own):
            if hit[a:b].any():
                improbable[a : b + 1] = True
        garbled, whole, parts, done = False, True, [], 0
        for m in HIGH.finditer(text):
            a, b = m.span()
            usual = not improbable[a + 1 : b + 1].any()
            if usual and not hint[a + 1 : b + 1].any():
                continue
            key = (m.group(), text[a - 1] if a else _START, text[b] if b < len(text) else _END, usual)
            if key not in known:
                if len(known) > 200_000:
                    known.clear()
                known[key] = read_run(*key[:3], model, usual)
            new, bad = known[key]
            if bad:
                garbled = True
                whole &= new != m.group()
                parts.append(text[done:a] + new)
                done = b
        if garbled:
            out.append((at[n], "".join(parts) + text[done:], whole))
    return out


def find_garbled(texts: DataFrame) -> DataFrame:
    """texts (table_name, record_id, text) -> table_name, record_id, restored, whole, for garbled records only.

    whole tells whether every garbled run could be restored. Null, empty and plain ASCII texts are never garbled; repeated rows
    repeat; no rows give no rows. The model holds at most MOST_PAIRS pairs in memory and looks up all others, whatever the corpus.
    """
    shared = texts.sparkSession.sparkContext.broadcast(pair_model(texts))

    def find(batches):
        model, known = shared.value, {}
        for pdf in batches:
            rows = read_texts(pdf.text.tolist(), model, known)
            if not rows:
                continue
            some = pdf.iloc[[i for i, _, _ in rows]]
            yield pd.DataFrame({"table_name": some.table_name.tolist(), "record_id": some.record_id.to_numpy(), "restored": [t for _, t, _ in rows], "whole": [w for _, _, w in rows]})

    mixed = texts.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("table_name", "record_id", "text")
    # few rows are left, and cost most of the time: they are spread anew, over a number of tasks that isn't lowered for so few bytes
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return mixed.repartition(tasks, "record_id", "table_name").mapInPandas(find, "table_name string, record_id long, restored string, whole boolean")
