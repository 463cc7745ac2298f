"""Positioned text to lines and paragraphs: folds over one page's or one element's fragments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from scriptorium.sources.pdf_text import Fragment

#: Thresholds, in ems, points or ratios.
SAME_LINE_EM, SAME_LINE_POINTS = 0.25, 0.5
SPACE_EM, COLUMN_EM = 0.12, 2.5
PARAGRAPH_GAP, INDENT_POINTS, SIZE_RATIO = 0.4, 6.0, 1.2
MAX_SKEW = 3.0
HEADING_RATIOS = ((1.8, 1), (1.5, 2), (1.25, 3))


@dataclass
class Line:
    text: str
    y: float
    x: float
    end_x: float
    size: float
    level: bool  # False for text that is not horizontal


def tolerance(size: float) -> float:
    return max(SAME_LINE_POINTS, size * SAME_LINE_EM)


def joined(row: list[Fragment]) -> str:
    """Text of fragments from left to right, with a space where a gap looks like one."""
    text = ""
    for i, f in enumerate(row):
        if i:
            before = row[i - 1]
            em = max(before.size, f.size, 1.0)
            if f.x - before.end_x > em * SPACE_EM and not re.search(r"\s\Z", before.text) and not re.match(r"\s", f.text):
                text += " "
        text += f.text
    return text


def rows(fragments: list[Fragment]) -> list[list[Fragment]]:
    """Fragments of nearly one baseline; the baseline is the running mean of what is already in the row."""
    out: list[list[Fragment]] = []
    mean = 0.0
    for f in sorted(fragments, key=lambda f: (f.y, f.x)):
        if out and abs(f.y - mean) <= tolerance(max(f.size, out[-1][0].size)):
            out[-1].append(f)
            mean += (f.y - mean) / len(out[-1])
        else:
            out.append([f])
            mean = f.y
    return out


def lines(fragments: list[Fragment]) -> list[Line]:
    flat, skewed = [], []
    for f in fragments:
        if f.text:
            turn = f.angle % 180
            (flat if min(turn, 180 - turn) <= MAX_SKEW else skewed).append(f)
    out = []
    for row in rows(flat):
        row.sort(key=lambda f: f.x)
        start = 0
        for i in range(1, len(row) + 1):
            if i == len(row) or row[i].x - row[i - 1].end_x > max(row[i - 1].size, row[i].size, 1.0) * COLUMN_EM:
                part = row[start:i]
                out.append(Line(joined(part), sum(f.y for f in part) / len(part), part[0].x, max(f.end_x for f in part), max(f.size for f in part), True))
                start = i
    out += [Line(f.text, f.y, f.x, f.end_x, f.size, False) for f in skewed]
    # lines of nearly one height stand from left to right
    out.sort(key=lambda x: (x.y, x.x))
    done: list[Line] = []
    for line in out:
        at = len(done)
        while at and abs(done[at - 1].y - line.y) <= tolerance(max(done[at - 1].size, line.size)) and done[at - 1].x > line.x:
            at -= 1
        done.insert(at, line)
    return done


def paragraphs(found: list[Line]) -> list[list[Line]]:
    out: list[list[Line]] = []
    usual: float | None = None
    for line in found:
        if out:
            before, first = out[-1][-1], out[-1][0]
            gap = line.y - before.y
            near = gap <= (usual if usual is not None else max(line.size, before.size) * 1.2) * (1 + PARAGRAPH_GAP)
            ratio = max(line.size, before.size) / max(1.0, min(line.size, before.size))
            if near and abs(line.x - first.x) <= INDENT_POINTS and ratio <= SIZE_RATIO:
                out[-1].append(line)
                usual = gap if usual is None else (usual + gap) / 2
                continue
        out.append([line])
        usual = None
    return out


def body_size(found: list[list[Line]]) -> float:
    """The upper median of the lines' sizes; 12 without lines."""
    sizes = sorted(line.size for p in found for line in p)
    return sizes[len(sizes) // 2] if sizes else 12.0


def heading_level(ratio: float) -> int | None:
    return next((level for least, level in HEADING_RATIOS if ratio >= least), None)
