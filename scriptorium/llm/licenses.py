"""License scans with a positional index of rare tokens.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A template is a
sequence of words with mandatory key phrases. The index holds, of each template, its rarest words
(highest inverse document frequency over all documents) with their positions. A file's rare licence
words are looked up; the postings vote for offsets (position in the file less position in the
template), and only offsets on which enough of them agree are verified: every key phrase must stand
word by word at its place. A base phrase is one template whose only key phrase is all of it, so all
its indexed words agree wherever it stands, and every place is found.

Null texts count as empty: no words, no labels, score 0. Repeated rows come back repeated; rows with
a null id keep it. Extra columns are not read. The frequencies are one row for each word of the
templates, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import map_batches

#: Phrases that licence a text, each with its label.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices: label, words, mandatory key phrases.
NOTICES = [
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license", "version 2"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2", "you may not use this file except in compliance"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
]
#: Rarest words of a template that are indexed; how many must agree on an offset.
INDEXED, AGREE = 3, 2


@dataclass
class Template:
    label: str
    words: list[str]
    keys: list[tuple[int, list[str]]]  # place in the template, words
    base: bool


def templates() -> list[Template]:
    out = [Template(label, phrase.split(), [(0, phrase.split())], True) for phrase, label in BASE]
    for label, text, keys in NOTICES:
        words = text.split()
        placed = []
        for key in map(str.split, keys):
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            placed.append((at, key))
        out.append(Template(label, words, placed, False))
    return out


def vocabulary(known: list[Template]) -> list[str]:
    return sorted({w for t in known for w in t.words})


def frequencies(df: DataFrame, words: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents of df each of the words stands, and the number of documents."""
    wanted = np.array([B.hash_text(w) for w in words], np.uint64)
    order = np.argsort(wanted)
    ranked = wanted[order]

    def run(batch: pa.RecordBatch) -> dict:
        seen = np.zeros(len(words) + 1, np.int64)
        for piece in B.slices(batch.column(0)):
            data = B.LOWER[piece.data]
            found = B.tokens(data, piece.offsets, B.ALNUM)
            value = B.hashes(data, found)
            at = np.minimum(np.searchsorted(ranked, value), len(ranked) - 1)
            hit = ranked[at] == value
            pairs = np.unique(found.row[hit] * len(words) + order[at[hit]])
            seen[:-1] += np.bincount(pairs % len(words), minlength=len(words))
        seen[-1] = batch.num_rows
        return {"word": np.arange(len(words) + 1), "n": seen}

    counted = map_batches(df.select(F.col(text_col).cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r.word: r.n for r in counted.collect()}  # one row for each word of the templates
    return {w: n.get(i, 0) for i, w in enumerate(words)}, n.get(len(words), 0)


class Index:
    """Positional postings of each template's rarest words."""

    def __init__(self, known: list[Template], idf: dict[str, float]):
        self.templates = known
        self.need = []
        self.hashed = []
        postings: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(known):
            rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[:INDEXED]
            places = [i for i, w in enumerate(t.words) if w in rare]
            self.need.append(len(places) if t.base else min(AGREE, len(places)))
            hashed = [B.hash_text(w) for w in t.words]
            for i in places:
                postings.setdefault(hashed[i], []).append((k, i))
            self.hashed.append(np.array(hashed, np.uint64))
        self.words = np.array(sorted(postings), np.uint64)
        self.postings = [np.array(postings[int(w)], np.int64) for w in self.words]

    def matches(self, words: np.ndarray, found: B.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Verified places: row, template, first word in the slice, covered part of the template."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(words):
            return none
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == words)
        if not len(hit):
            return none
        row = found.row
        votes = []
        for w in np.unique(at[hit]):
            places = hit[at[hit] == w]
            for k, i in self.postings[w]:
                start = places - i
                votes.append(np.stack([np.full(len(places), k), start, row[places]]))
        votes, agreed = np.unique(np.concatenate(votes, axis=1), axis=1, return_counts=True)
        out = []
        for k, t in enumerate(self.templates):
            mine = votes[:, (votes[0] == k) & (agreed >= self.need[k])]
            start, own = mine[1], mine[2]
            low, high = found.bounds[own], found.bounds[own + 1]
            good = np.ones(len(start), bool)
            for place, key in t.keys:
                first = start + place
                good &= (first >= low) & (first + len(key) <= high)
                for j in range(len(key)):
                    good &= words[np.clip(first + j, 0, len(words) - 1)] == self.hashed[k][place + j]
            start, own, low, high = start[good], own[good], low[good], high[good]
            spots = start[:, None] + np.arange(len(t.words))
            inside = (spots >= low[:, None]) & (spots < high[:, None])
            same = inside & (words[np.clip(spots, 0, len(words) - 1)] == self.hashed[k])
            out.append((own, np.full(len(own), k), start, same.mean(axis=1) if len(own) else np.zeros(0)))
        return tuple(np.concatenate(x) for x in zip(*out))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places for each row of df.

    places: label, first word, covered part of the template, and whether it is a base phrase.
    """
    known = templates()
    seen, n = frequencies(df, vocabulary(known), text_col)
    index = Index(known, {w: float(np.log((n + 1) / (c + 1))) for w, c in seen.items()})
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        n_words, places = [], []
        for piece in B.slices(batch.column(1)):
            data = B.LOWER[piece.data]
            found = B.tokens(data, piece.offsets, B.ALNUM)
            n_words += found.counts.tolist()
            rows: list[list] = [[] for _ in range(piece.rows)]
            for r, k, start, cover in zip(*map(np.ndarray.tolist, index.matches(B.hashes(data, found), found))):
                t = known[k]
                rows[r].append({"label": t.label, "first_word": start - int(found.bounds[r]), "cover": cover, "base": t.base})
            places += [sorted(p, key=lambda x: (x["first_word"], not x["base"], x["label"])) for p in rows]
        base = [[p for p in x if p["base"]] for x in places]
        return {
            "doc_id": batch.column(0),
            "n_words": pa.array(n_words, pa.int64()),
            "n_base": pa.array([len(x) for x in base], pa.int64()),
            "first_word": pa.array([min((p["first_word"] for p in x), default=None) for x in base], pa.int64()),
            "last_word": pa.array([max((p["first_word"] for p in x), default=None) for x in base], pa.int64()),
            "base_labels": pa.array([",".join(sorted({p["label"] for p in x})) for x in base], pa.string()),
            "labels": pa.array([",".join(sorted({p["label"] for p in x})) for x in places], pa.string()),
            "score": pa.array([max((p["cover"] for p in x), default=0.0) for x in places], pa.float64()),
            "places": pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("cover", pa.float64()), ("base", pa.bool_())]))),
        }

    return map_batches(source, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, first_word: long, cover: double, base: boolean>>")
