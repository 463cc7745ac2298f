"""Display titles, file-name clean-up and document ids."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.lexemes import collapse

#: What is never a title by itself, bounds, and each source's confidence.
BOILERPLATE = [
    r"(?i)^by order of the\b",
    r"(?i)^compliance with this publication is mandatory\.?$",
    r"(?i)^controlled unclassified information\b",
    r"(?i)^for official use only\.?$",
    r"(?i)^table of contents$",
    r"(?i)^this page (is )?intentionally left blank\.?$",
]
LENGTHS, HEADING_LENGTH = (3, 300), 4
CONFIDENCE = {"host": 1.0, "pdf-metadata": 0.8, "first-page-heading": 0.65, "filename": 0.2}


def is_boilerplate(title: Column, rules: list[str] = BOILERPLATE) -> Column:
    return reduce(lambda a, b: a | b, [collapse(title).rlike(r) for r in rules], F.lit(False))


def credible(title: Column, least: int = LENGTHS[0], rules: list[str] = BOILERPLATE) -> Column:
    """Whether an inferred title is long enough, not too long, and no boilerplate; false for null."""
    size = F.length(collapse(title))
    return F.coalesce(size.between(least, LENGTHS[1]) & ~is_boilerplate(title, rules), F.lit(False))


def clean_filename(name: Column) -> Column:
    """A file name as a title: no extension, separators as spaces, words capitalised."""
    spaced = collapse(F.regexp_replace(F.regexp_replace(name, r"\.[^./\\]+$", ""), "[_-]+", " "))
    words = F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, "Untitled document").otherwise(F.array_join(words, " "))


def select_title(host: Column, metadata: Column, heading: Column, filename: Column, rules: list[str] = BOILERPLATE) -> Column:
    """STRUCT<title, source, confidence>: the first credible of host, metadata, heading and file name."""
    ways = [
        ("host", F.coalesce(F.length(collapse(host)).between(1, LENGTHS[1]), F.lit(False)), collapse(host)),
        ("pdf-metadata", credible(metadata, rules=rules), collapse(metadata)),
        ("first-page-heading", credible(heading, HEADING_LENGTH, rules), collapse(heading)),
        ("filename", F.lit(True), clean_filename(filename)),
    ]
    made = [F.when(ok, F.struct(text.alias("title"), F.lit(source).alias("source"), F.lit(CONFIDENCE[source]).alias("confidence"))) for source, ok, text in ways]
    return F.coalesce(*made)


def document_id(filename: Column, sha256: Column) -> Column:
    """A safe id: the file name's slug and twelve digits of the content's hash."""
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(filename, r"\.[^.]+$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 72)
    safe = F.when(base.rlike("^[a-z]"), base).otherwise(F.concat(F.lit("document-"), F.when(base == "", "pdf").otherwise(base)))
    return F.concat(safe, F.lit("-"), F.substring(sha256, 1, 12))


def is_safe_id(value: Column) -> Column:
    return value.rlike("^[a-z][a-z0-9-]*$")


def safe_id(value: str) -> bool:
    return bool(re.fullmatch(r"[a-z][a-z0-9-]*", value))


def is_safe_asset(name: Column) -> Column:
    """Names that cannot leave a folder: letters, digits, dots, dashes and underscores, not two dots."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(name, F.lit(".."))
