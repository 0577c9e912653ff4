"""One outline at a time, in time linear in what it gives: headings, sections, packing.

Sections are ranges of lines, found by a stack of open headings; pieces are ranges
of lines, found by bisection of prefix sums.  No text is copied before it is a chunk's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from heapq import merge
from itertools import accumulate
from typing import NamedTuple

#: What is trimmed: ASCII white space, Unicode separators, the byte order mark.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_S = f"[{BLANKS}]"
_ANY = r"[^\n\r\u0085\u2028\u2029]"
# A heading with its tags, and an entry of a drawer.
HEADING = re.compile(rf"^(\*+){_S}+({_ANY}+?)(?:{_S}+(:[a-zA-Z0-9_:]+:))?{_S}*(?=[\r\u0085\u2028\u2029]?\Z)")
PROPERTY = re.compile(rf"^:([A-Z_]+):[\t\n\x0b\f\r ]*({_ANY}*)")
# Block delimiters (in one case) and directives (any case) whose lines are dropped.
BLOCK = re.compile(r"#\+(?:BEGIN_|END_|begin_|end_)")
DIRECTIVE = re.compile(r"#\+(?:title|date|filetags|identifier|export|hugo|description|OPTIONS|STARTUP|reference)", re.IGNORECASE | re.ASCII)
_IN_LINE = "\t\x0b\f\r "
_WIDE = re.compile("[\U00010000-\U0010ffff]")


class Heading(NamedTuple):
    level: int
    title: str
    tags: list[str]
    lineNumber: int  # from 1
    properties: dict[str, str]
    isArchive: bool
    isLlmlog: bool


def utf16_size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def find_headings(lines: list[str]) -> list[Heading]:
    """All headings; a drawer of properties must follow at once, the last of equal keys counts."""
    out = []
    closing = [i for i, x in enumerate(lines) if x.strip(BLANKS) == ":END:"]
    for i, line in enumerate(lines):
        found = HEADING.match(line) if line.startswith("*") else None
        if not found:
            continue
        properties = {}
        if i + 1 < len(lines) and lines[i + 1].strip(BLANKS) == ":PROPERTIES:":
            k = bisect_right(closing, i + 1)
            for x in lines[i + 2 : closing[k] if k < len(closing) else len(lines)]:
                entry = PROPERTY.match(x.strip(BLANKS))
                if entry:
                    properties[entry[1]] = entry[2]
        tags = [t for t in (found[3] or "").split(":") if t]
        out.append(Heading(len(found[1]), found[2].strip(BLANKS), tags, i + 1, properties, "ARCHIVE" in tags, "LLMLOG" in tags))
    return out


def section_ends(found: list[Heading], n_lines: int) -> list[int]:
    """Per heading the number of lines up to the next one of its level or a lower one."""
    ends, open_ = [n_lines] * len(found), []
    for i, h in enumerate(found):
        while open_ and found[open_[-1]].level >= h.level:
            ends[open_.pop()] = h.lineNumber - 1
        open_.append(i)
    return ends


def hierarchies(found: list[Heading]):
    """Per heading the titles of all earlier ones of a lower level, back to the nearest of level 1, and its own."""
    by_level: dict[int, list[tuple[int, str]]] = {}
    for i, h in enumerate(found):
        if h.level == 1:
            by_level.clear()
        above = merge(*(of for level, of in by_level.items() if level < h.level))
        yield " > ".join([*(title for _, title in above), h.title])
        by_level.setdefault(h.level, []).append((i, h.title))


def content_of(lines: list[str], start: int, end: int) -> str:
    """Text of lines start to end without drawers and directives, trimmed; an unclosed drawer takes the rest."""
    kept, inside = [], False
    for line in lines[start:end]:
        bare = line.strip(_IN_LINE)
        if inside:
            inside = bare != ":END:"
        elif bare == ":PROPERTIES:":
            inside = True
        elif not (bare.startswith("#+") and (BLOCK.match(bare) or DIRECTIVE.match(bare))):
            kept.append(line)
    return "\n".join(kept).strip(BLANKS)


def pack(text: str, most: int, overlap: int) -> list[tuple[str, int, int]]:
    """(piece, first line, lines) of a text: greedy packing of lines into at most `most` units.

    A full piece closes before the line that would not fit; the next one begins with its
    last lines of at least `overlap` units.  A line is never cut.
    """
    if utf16_size(text) <= most:
        return [(text, 0, text.count("\n") + 1)]
    lines = text.split("\n")
    ends = [0, *accumulate(utf16_size(x) + 1 for x in lines)]
    out, start = [], 0
    for i in range(1, len(lines)):
        if ends[i + 1] - ends[start] > most and i > start:
            out.append((start, i))
            start = max(start, bisect_right(ends, ends[i] - overlap, 0, i + 1) - 1)
    out.append((start, len(lines)))
    return [("\n".join(lines[a:b]), a, b - a) for a, b in out]
