"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits, checksums.

The automaton runs once over the lower-cased text; an expression is only tried anchored at a
keyword's start. Runs of hexadecimal digits have no keyword: their candidates are runs of one
character class, found in the same pass over the bytes. Matches of a kind are leftmost and do not
overlap; matches that fail a length bound still take up their text.

Kinds, in order: assign, access and hex are the base. The method adds tokens that carry their own
proof: github and npm (six base-62 digits of a CRC-32 of the body), jwt (a header and a
payload that decode to JSON objects, the header naming its algorithm).

Spans are in code points, end exclusive. Null texts count as empty and have none. Repeated rows come
back repeated; extra columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import map_batches

KINDS = ["assign", "access", "hex", "github", "npm", "jwt"]
BASE_KINDS = 3
HEX_LEAST = 24
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, np.uint8)
_HEX[48:58] = _HEX[97:103] = 1


def checksum62(body: str) -> str:
    """The CRC-32 of body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS62[d] + out
    return out


def _checked(m: re.Match) -> bool:
    return checksum62(m[1][:30]) == m[1][30:]


def _json(part: str) -> dict | None:
    try:
        out = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _jwt(m: re.Match) -> bool:
    header = _json(m[1])
    return header is not None and "alg" in header and _json(m[2]) is not None


#: Keyword: kind, expression, what a match must pass.
_RULES = {k: (0, _ASSIGN, lambda m: len(m[1]) >= 6) for k in ("password", "passwd", "secret", "token", "api_key", "apikey")}
_RULES |= {"akia": (1, _ACCESS, lambda m: m.end() - m.start() >= 20)}
_RULES |= {k: (3, _GITHUB, _checked) for k in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")}
_RULES |= {"npm_": (4, _NPM, _checked), "eyj": (5, _JWT, _jwt)}
_automaton = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for word in _RULES:
            _automaton.add_word(word, word)
        _automaton.make_automaton()
    return _automaton


def find(piece: B.Slice) -> list[tuple[int, int, int, int]]:
    """(row, start, kind, end) of all spans of a slice, in order, in code points of the row's text."""
    # one character for each byte: all expressions are ASCII, and offsets stay byte offsets
    text = piece.data.tobytes().decode("latin-1")
    low = B.LOWER[piece.data].tobytes().decode("latin-1")
    found: list[tuple[int, int, int, int]] = []
    over = [[-1, -1] for _ in KINDS]  # row, end of the kind's last match
    hits = sorted((end - len(word) + 1, end + 1, word) for end, word in automaton().iter(low))
    if hits:
        rows = np.searchsorted(piece.offsets, [h[0] for h in hits], "right") - 1
        stops = piece.offsets[rows + 1].tolist()
        for (start, end, word), row, stop in zip(hits, rows.tolist(), stops):
            kind, rule, good = _RULES[word]
            if end > stop or over[kind][0] == row and start < over[kind][1]:
                continue
            m = rule.match(text, start, stop)
            if m is None:
                continue
            if kind < BASE_KINDS or good(m):
                over[kind] = [row, m.end()]
            if good(m):
                found.append((row, start, kind, m.end()))
    runs = B.tokens(piece.data, piece.offsets, _HEX)
    long = np.flatnonzero(runs.ends - runs.starts >= HEX_LEAST)
    if len(long):
        rows = np.searchsorted(runs.bounds, long, "right") - 1
        found += zip(rows.tolist(), runs.starts[long].tolist(), [2] * len(long), runs.ends[long].tolist())
    if not found:
        return []
    chars = B.code_points(piece.data)
    origin = chars[piece.offsets]
    return sorted((r, int(chars[a] - origin[r]), k, int(chars[b] - origin[r])) for r, a, k, b in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end) by start, then kind, for each row of df."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> dict:
        out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for piece in B.slices(batch.column(1)):
            for r, a, k, b in find(piece):
                out[piece.first + r].append({"kind": KINDS[k], "start": a, "end": b})
        return {"doc_id": batch.column(0), "spans": pa.array(out, form)}

    return map_batches(source, run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of a scan."""
    said = "concat(s.kind, ':', cast(s.start as string), ':', cast(s.end as string))"
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:BASE_KINDS]]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.expr(f"array_join(transform({base}, s -> {said}), ',')").cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(spans, s -> {said}), ',')").alias("spans"),
    )
