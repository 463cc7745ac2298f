"""Excerpts centred on the densest match, with the matches' ranges in them."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 96


def snippet(content: str, terms: tuple[str, ...], radius: int = RADIUS) -> dict:
    """{"snippet", "matches": [{"start", "end"}]}: ranges are relative to the snippet."""
    text = " ".join(re.split(r"\s+", content.strip())) if content else ""
    found = [m.span() for m in re.finditer("|".join(map(re.escape, terms)), text.lower()) if m.end() > m.start()] if terms else []
    if not found:
        if len(text) <= 2 * radius:
            return {"snippet": text, "matches": []}
        return {"snippet": text[: 2 * radius].rstrip() + " ...", "matches": []}
    starts = [a for a, _ in found]
    around = [bisect.bisect_right(starts, a + radius) - bisect.bisect_left(starts, a - radius) for a in starts]
    a, b = found[around.index(max(around))]
    first, last = max(0, a - radius), min(len(text), b + radius)
    before, after = "... " if first else "", " ..." if last < len(text) else ""
    shift = len(before) - first
    return {"snippet": before + text[first:last] + after, "matches": [{"start": x + shift, "end": y + shift} for x, y in found if x >= first and y <= last]}


def highlighted(text: str, matches: list[dict]) -> list[tuple[str, bool]]:
    """The snippet cut into (part, whether it is a match); never markup."""
    parts, at = [], 0
    for m in sorted(matches, key=lambda m: m["start"]):
        a = min(len(text), max(0, m["start"], at))
        b = min(len(text), max(a, m["end"]))
        parts += [(text[at:a], False), (text[a:b], True)]
        at = max(at, b)
    return [p for p in [*parts, (text[at:], False)] if p[0]]


def snippet_column(content: Column, terms: tuple[str, ...]) -> Column:
    """snippet() of a column: applied to the few rows that are shown."""

    @F.pandas_udf("snippet string, matches array<struct<start: int, end: int>>")
    def made(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(t, terms) for t in texts], columns=["snippet", "matches"])

    return made(content)
