"""Vectorised work on the UTF-8 buffers of Arrow string columns.

A slice is a run of rows whose texts are looked at together as one byte array; tokens never
cross a row's end. Null texts count as empty. Memory is about 60 bytes for each byte of the
largest slice: `SLICE` bytes, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18

#: ASCII white space as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of [^\x20\x09-\x0D]+.
SOLID = (~SPACE).astype(np.uint8)
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased: digits, a-z, non-ASCII.
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    up, down = _powers
    if len(up) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            while len(up) < n:
                k = len(up)
                up = np.concatenate([up, up * (up[-1] * _BASE)])
                down = np.concatenate([down, down * (down[-1] * inverse)])
                assert len(up) == 2 * k
        _powers = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Slice:
    first: int  # row of the batch
    offsets: np.ndarray  # rows + 1
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """The column's texts as byte slices of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield Slice(row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]])
        row = stop


@dataclass
class Tokens:
    starts: np.ndarray  # byte offsets in the slice
    ends: np.ndarray
    bounds: np.ndarray  # rows + 1: the tokens of row r are bounds[r]:bounds[r+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Tokens:
    """Maximal runs of bytes of one class other than 0."""
    kind = classes[data]
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    held = kind[starts] != 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    return Tokens(starts, ends, np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, found: Tokens) -> np.ndarray:
    """A 64-bit hash of each token's bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
        return mix((total[found.ends] - total[found.starts]) * down[found.starts])


def hash_text(text: str | bytes) -> int:
    """hashes() of one token."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    whole = Tokens(np.array([0]), np.array([len(raw)]), np.array([0, 1]))
    return int(hashes(raw, whole)[0])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[r]:bounds[r+1]]; 0 for empty runs."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """At each byte offset, and at the end, how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
