"""Undoing a decode with the wrong character encoding: byte-level inverse mappings for short strings.

The helpers see one string at a time and know nothing of a corpus; `lodestrata.llm.garble` decides with corpus
statistics where they may be tried.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Encodings in which UTF-8 bytes are commonly misread.
WRONG_READERS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "gbk")
#: One-byte encodings that are commonly taken for one another.
ONE_BYTE = ("cp1252", "mac_roman", "cp437", "cp1251", "latin-1")

#: Well-formed UTF-8 sequences of two to four bytes.
SEQUENCES = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
HIGH = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=65536)
def char_bytes(char: str, encoding: str) -> bytes | None:
    """The bytes that `encoding` reads as `char`; cp1252's five undefined bytes pass through as C1 controls."""
    try:
        return char.encode(encoding)
    except UnicodeEncodeError:
        if encoding == "cp1252" and "\x80" <= char <= "\x9f":
            return char.encode("latin-1")
        return None


def utf8_sequences(run: str, encoding: str) -> tuple[str, int]:
    """`run` with every stretch that `encoding` misread from UTF-8 put right, and the number of sequences put right."""
    out: list[str] = []
    fixed = 0
    stretch: list[tuple[str, bytes]] = []

    def flush() -> None:
        nonlocal fixed
        data = b"".join(b for _, b in stretch)
        starts, at = {}, 0
        for i, (_, b) in enumerate(stretch):
            starts[at] = i
            at += len(b)
        starts[at] = len(stretch)
        i = 0
        for m in SEQUENCES.finditer(data):
            a, z = starts.get(m.start()), starts.get(m.end())
            if a is None or a < i:
                continue
            tail = ""
            if z is None:  # a two-byte reader can swallow one ASCII byte after the sequence
                z = starts.get(m.end() + 1)
                if z is None or data[m.end()] >= 0x80:
                    continue
                tail = chr(data[m.end()])
            out.extend(c for c, _ in stretch[i:a])
            text = m.group().decode("utf-8")
            out.append(text + tail)
            fixed += len(text)
            i = z
        out.extend(c for c, _ in stretch[i:])
        stretch.clear()

    for char in run:
        b = char_bytes(char, encoding)
        if b is None:
            flush()
            out.append(char)
        else:
            stretch.append((char, b))
    flush()
    return "".join(out), fixed


def undo_utf8(run: str, rounds: int = 3) -> str:
    """The run with misread UTF-8 put right, also when it was misread several times; unchanged where nothing fits.

    Of several readers the one that shortens the run most wins, ties going to the first named.
    """
    for _ in range(rounds):
        best = run
        for encoding in WRONG_READERS:
            text, fixed = utf8_sequences(run, encoding)
            if fixed and len(text) < len(best):
                best = text
        if best == run:
            return run
        run = best
    return run


def repair_text(text: str | None) -> str | None:
    """The text with every misread UTF-8 sequence in its non-ASCII runs put right; null stays null."""
    if text is None or text.isascii():
        return text
    return HIGH.sub(lambda m: undo_utf8(m.group()), text)


def one_byte_readings(run: str) -> list[str]:
    """What `run` would be had one of the one-byte encodings been taken for another."""
    found = []
    for wrong in ONE_BYTE:
        data = [char_bytes(c, wrong) for c in run]
        if None in data:
            continue
        joined = b"".join(data)
        for right in ONE_BYTE:
            if right == wrong:
                continue
            try:
                text = joined.decode(right)
            except UnicodeDecodeError:
                continue
            if text != run and text not in found and not any("\x80" <= c <= "\x9f" for c in text):
                found.append(text)
    return found
