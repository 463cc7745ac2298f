"""Lexemes of texts: the same rule as a Column, for tables, and in Python, for queries.

A lexeme is a word (a letter, then letters and digits), a word of digits with letters, or a number
with an optional minus sign and dots. Words joined by hyphens are one lexeme and then one for each
word. So A-12 gives a and -12, A12 gives a12, and A 12 gives a and 12.

Texts are kept as joined lexemes: MARK, then each lexeme and MARK. A phrase is then a substring.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"
#: ASCII white space, as it is collapsed in texts.
WHITE = r"[\x09-\x0D\x20]+"
PATTERN = r"\p{L}[\p{L}\p{N}]*(?:-\p{L}[\p{L}\p{N}]*)*|\p{N}+\p{L}[\p{L}\p{N}]*|-?\p{N}+(?:\.\p{N}+)*"
_PYTHON = re.compile(r"[^\W\d_][^\W_]*(?:-[^\W\d_][^\W_]*)*|\d+[^\W\d_][^\W_]*|-?\d+(?:\.\d+)*")


def lex(text: str) -> list[str]:
    out: list[str] = []
    for token in _PYTHON.findall(text.lower()):
        out.append(token)
        if "-" in token[1:]:
            out += token.split("-")
    return out


def lexemes(text: Column) -> Column:
    """The array of a text's lexemes, in order; null for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(0))
    parts = F.transform(found, lambda t: F.when(F.instr(t, "-") > 1, F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t)))
    return F.flatten(parts)


def join(*arrays: Column) -> Column:
    """Arrays of lexemes, one after the other, as one joined text."""
    empty = F.array().cast("array<string>")
    whole = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return F.concat(F.lit(MARK), F.array_join(whole, MARK), F.when(F.size(whole) > 0, MARK).otherwise(""))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))
