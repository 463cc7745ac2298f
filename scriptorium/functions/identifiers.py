"""Technical identifiers such as A-12, A12 or A 12, and the spellings they are also indexed under."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of an identifier, and bounds of what one record may add.
PATTERN = r"(?<![A-Za-z0-9])([A-Z]{1,4})[- ]?([0-9]{1,6})(?![A-Za-z0-9])"
MAX_PER_RECORD = 40
MAX_VARIANT_CHARACTERS = 4000


def identifiers(text: Column) -> Column:
    """Distinct canonical identifiers (letters, then digits) in order of their first place."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[- ]", "")))


def hyphenated(canonical: Column) -> Column:
    return F.regexp_replace(canonical, "^([A-Z]+)([0-9]+)$", "$1-$2")


def spellings(canonical: Column) -> Column:
    """The three spellings: hyphenated, joined, spaced."""
    return F.array(hyphenated(canonical), canonical, F.regexp_replace(canonical, "^([A-Z]+)([0-9]+)$", "$1 $2"))


def variants(*fields: Column) -> Column:
    """Spellings of the first identifiers over all fields, joined by spaces; empty if there is none."""
    found = F.array_distinct(reduce(lambda a, b: F.concat(a, b), [identifiers(f) for f in fields]))
    text = F.array_join(F.flatten(F.transform(F.slice(found, 1, MAX_PER_RECORD), spellings)), " ")
    return F.substring(text, 1, MAX_VARIANT_CHARACTERS)
