"""JSON answers in the output of a terminal, which cuts lines at its width."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of code points that take two columns, the one among them that takes one, and the
# least width taken for a terminal's.
WIDE_RANGES = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1FAFF), (0x20000, 0x3FFFD))
NARROW = 0x303F
LEAST_COLUMNS = 60

WIDE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in WIDE_RANGES) + "]")
HANGUL = re.compile("[가-힣]")
#: What matters to strings and breaks, and what finds the end of an object.
PIECES = re.compile(r'\r?\n|["\\\r]|[^"\\\r\n]+')
BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def width(line: str) -> int:
    """Columns that a line takes."""
    return len(line) + len(WIDE.findall(line)) - line.count(chr(NARROW))


def display_width(text: Column) -> Column:
    """Columns that each text takes on a terminal."""
    narrow = "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WIDE_RANGES) + f"]|\\x{{{NARROW:X}}}"
    return F.length(text) + F.length(F.regexp_replace(text, narrow, ""))


def cut_words(text: str) -> set[int]:
    """Places of the line breaks that are inside a word.

    So it is where the line is as wide as the widest and the word around the break is wider than that: a
    word that fits into a line would have moved down whole.
    """
    lines = text.split("\n")
    shown = [line.removesuffix("\r") for line in lines]
    widths = list(map(width, shown))
    most, at, places = max(widths), -1, set()
    if most < LEAST_COLUMNS:
        return places
    for line, w, a, b in zip(lines, widths, shown, shown[1:], strict=False):
        at += len(line) + 1
        if w >= most and width(a.rpartition(" ")[2]) + width(b.partition(" ")[0]) > most:
            places.add(at)
    return places


def unwrapped(text: str, start: int, end: int, cuts: set[int]) -> str:
    """The object between two places without the breaks that a terminal put into its strings and words.

    No string of JSON holds a raw line break: one there stands for the space it replaced, or for nothing
    inside a word (between two Hangul syllables a space is likelier) and between an escape's characters.
    """
    out, inside, escaped, last = [], False, False, ""
    for m in PIECES.finditer(text, start, end):
        piece = m[0]
        if piece.endswith("\n"):
            following, cut = text[m.end() : min(m.end() + 1, end)], m.end() - 1 in cuts
            if not inside:
                piece = "" if cut else "\n"
            else:
                within = cut and not (HANGUL.match(last) and HANGUL.match(following))
                piece = "" if escaped or within or " " in (last, following) else " "
        elif escaped:
            escaped = False
        elif piece == '"':
            inside = not inside
        elif piece == "\\":
            escaped = inside
        out.append(piece)
        last = piece[-1:] or last
    return "".join(out)


def last_answer(text: str) -> str | None:
    """The last JSON object in a noisy text, which a terminal may have wrapped, in its own spelling of keys and values."""
    decoder, found, at, cuts = json.JSONDecoder(), None, 0, None
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            value, end = None, at + 1
            if "\n" in text and (stop := object_end(text, at)):
                cuts = cut_words(text) if cuts is None else cuts
                try:
                    value, end = json.loads(unwrapped(text, at, stop, cuts)), stop
                except ValueError:
                    pass
        found, at = value if isinstance(value, dict) else found, end
    return None if found is None else json.dumps(found, sort_keys=True, ensure_ascii=False)


def object_end(text: str, start: int) -> int | None:
    """Where the object that starts here ends, by its braces outside strings."""
    depth = 0
    for m in BRACES.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return None
