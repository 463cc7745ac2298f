"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text, with a space put before it, is a lattice of bytes: an edge is a piece of the vocabulary, or
the byte piece of a character that is no piece itself. An edge's weight is the negative logarithm of
the piece's merge rank times `alpha` (merge ranks follow frequency, frequency follows rank); a
segmentation's probability is proportional to the exponential of its weights' sum.

Segmentations are drawn without replacement: each has its log-probability plus Gumbel noise, and the
k largest are returned, in order. The search is a perturbed A-star from the left: exact sums
over all completions bound a partial segmentation, so its maximum perturbed value can be drawn before
it is expanded (a Gumbel truncated at its parent's). What leaves a path at a node is kept as one
group, by its total probability; the next segmentation starts at the group of the largest value.
The value of the best group that is left over is the threshold; a segmentation's inclusion
score is the probability that its perturbed value exceeds it.

Weights of completions are only needed within a unit (a run that no piece crosses: pieces never run
over the start of a space run or a line feed), so the lattice is built once for each distinct unit
of a slice, and that of a task's first units, up to a bound, is kept for its other slices. Units are
told apart by their bytes. All texts of a slice advance together.

Noise is a hash of (seed, row key, sample, place in the text): runs agree whatever the batches. Null
texts count as empty and have one empty segmentation of probability 1. Rows with equal keys and
texts have equal samples; a null key counts as one key. Fewer than k segmentations come back only where
the lattice has no more. Extra columns are not read. U+2581 is encoded in bytes, so that
decoding is exact. The model file is read on the driver only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 1 << 17
_SPACE, _FEED = 0x20, 0x0A


@dataclass
class Pieces:
    """A piece model as arrays: a double-array trie over bytes, weights and the pieces' bytes."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # of a trie state; -1: none
    weight: np.ndarray  # of a piece
    byte_piece: np.ndarray  # of a byte
    text: np.ndarray  # all pieces' bytes, spaces for U+2581
    cuts: np.ndarray

    @staticmethod
    def load(path: str = MODEL, alpha: float = 0.4) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw, byte_piece, normal = [b""] * n, np.zeros(256, np.int32), []
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                byte_piece[b], raw[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw[i] = model.id_to_piece(i).replace("▁", " ").encode()
                normal.append(i)
        assert not any(b" " in raw[i].lstrip(b" ") or b"\n" in raw[i] for i in normal), "a piece crosses a unit"
        weight = np.full(n, -alpha * math.log(4.0 * n))
        for rank, i in enumerate(normal):
            weight[i] = -alpha * math.log(rank + 10.0)
        base, check, piece = double_array({raw[i]: i for i in normal})
        return Pieces(base, check, piece, weight, byte_piece, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces, the space before a text included."""
        size = self.cuts[ids + 1] - self.cuts[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.cuts[ids] - (ends - size), size)
        return self.text[at]


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie: the state after byte c in state s is base[s] + c, if check there is s. The root is 0."""
    children: dict[bytes, set[int]] = {b"": set()}
    for w in words:
        for k in range(len(w)):
            children.setdefault(w[:k], set()).add(w[k])
    size = 4 * (sum(map(len, children.values())) + 600)
    used, check = bytearray(size), np.full(size, -1, np.int32)
    base, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    used[0] = 1
    state, free, fork = {b"": 0}, 257, 257  # forks only look from about the last one on; single children fill the holes
    for prefix in sorted(children, key=lambda p: (len(p), p)):
        own, s = sorted(children[prefix]), state[prefix]
        if not own:
            continue
        while used[free]:
            free += 1
        at = max(free, fork - 64 if len(own) > 1 else 0)
        while any(used[at - own[0] + c] for c in own):
            at += 1
        fork = max(fork, at) if len(own) > 1 else fork
        base[s] = at - own[0]
        for c in own:
            t = at - own[0] + c
            used[t], check[t], state[prefix + bytes([c])] = 1, s, t
    for w, i in words.items():
        piece[state[w]] = i
    return base, check, piece


@dataclass
class Lattice:
    """Tables of distinct units: nodes are byte places and one for the end, edges sorted by node, longest first."""

    first: np.ndarray  # of a node: its first edge; one entry more than nodes
    last: np.ndarray  # of a node: whether it ends its unit
    byte: np.ndarray  # of a node: the byte that starts there; 0 at the end of a unit
    target: np.ndarray
    pieces: np.ndarray
    upto: np.ndarray  # probability of an edge and those before it, given its node; 2 for the last that can be drawn
    logq: np.ndarray  # logarithm of an edge's probability given its node
    log_rest: np.ndarray  # the same of all other edges of its node


def lattice(data: np.ndarray, cuts: np.ndarray, model: Pieces) -> Lattice:
    """data: the units' bytes; cuts: where they start, and the end. Each unit has one node more than bytes."""
    unit = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    place = np.arange(len(data))
    stop = cuts[unit + 1]
    lead = (data & 0xC0) != 0x80
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # source, end, piece: shorter edges first
    at = char_start = np.flatnonzero(lead)
    width = np.diff(np.append(char_start, len(data)))
    single = np.zeros(len(width), bool)  # characters that are a piece
    state, reach = np.zeros(len(at), np.int32), at.copy()
    char = np.arange(len(at))
    while len(at):
        to = model.base[state] + data[reach]
        good = np.flatnonzero((to < len(model.check)) & (model.check[np.minimum(to, len(model.check) - 1)] == state))
        at, state, reach, char = at[good], to[good], reach[good] + 1, char[good]
        full = np.flatnonzero(model.piece[state] >= 0)
        source, end = at[full], reach[full]
        own = char[full]
        single[own[end - source == width[own]]] = True
        found.append((source, end, model.piece[state[full]]))
        more = np.flatnonzero(reach < stop[at])
        at, state, reach, char = at[more], state[more], reach[more], char[more]
    # characters that are no piece, and bytes before the first character: byte by byte
    char_of = np.cumsum(lead) - 1
    loose = np.flatnonzero((char_of < 0) | ~single[np.maximum(char_of, 0)]) if len(single) else place
    found.insert(0, (loose, loose + 1, model.byte_piece[data[loose]]))
    # nodes: byte places with one more for the end of each unit
    nodes = len(data) + len(cuts) - 1
    first = np.zeros(nodes + 1, np.int64)
    for source, _, _ in found:
        first[source + unit[source] + 1] += 1
    np.cumsum(first, out=first)
    src, dst, piece = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int32)
    free = first[1:].copy()
    for source, end, ids in found:  # the longest end up in front
        node = source + unit[source]
        free[node] -= 1
        slot = free[node]
        src[slot], dst[slot], piece[slot] = node, end + unit[source], ids
    last = np.zeros(nodes, bool)
    last[cuts[1:] + np.arange(len(cuts) - 1)] = True
    beta = np.full(nodes, -np.inf)
    beta[last] = 0.0
    weight = model.weight[piece]
    distance = (stop - place)[src - unit_of_nodes(cuts)[src]]
    if len(distance) and distance.max() < 65536:
        distance = distance.astype(np.uint16)  # sorted by radix
    by_distance = np.argsort(distance, kind="stable")
    levels = np.concatenate([[0], np.flatnonzero(np.diff(distance[by_distance])) + 1, [len(by_distance)]]) if len(src) else [0]
    for a, b in zip(levels[:-1], levels[1:]):
        e = by_distance[a:b]
        own = src[e]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        beta[own[heads]] = log_sums(weight[e] + beta[dst[e]], heads)
    with np.errstate(invalid="ignore"):
        logq = weight + beta[dst] - beta[src]
    logq[~np.isfinite(beta[dst])] = -np.inf
    byte = np.zeros(nodes, np.uint8)
    byte[~last] = data
    if not len(src):
        return Lattice(first, last, byte, dst, piece, np.zeros(0), logq, logq.copy())
    q = np.exp(logq)
    heads = np.flatnonzero(np.diff(src, prepend=-1))
    sizes = np.diff(np.append(heads, len(src)))
    # sums of a node's edges alone, in their order: they do not depend on what else is in the slice
    upto = q.copy()
    for i in range(1, int(sizes.max())):
        at = heads[sizes > i] + i
        upto[at] += upto[at - 1]
    end = heads + sizes - 1
    while (q[end] == 0.0).any():
        end -= q[end] == 0.0
    upto[end] = 2.0
    # the only edge above a half is left out of its node's sum; for the others 1 - q is exact enough
    most = q > 0.5
    others = np.add.reduceat(np.where(most, 0.0, q), heads)
    with np.errstate(divide="ignore"):
        log_rest = np.where(most, np.repeat(np.log(others), sizes), np.log1p(-np.minimum(q, 0.5)))
    for i in np.flatnonzero((others == 0.0) & (sizes > 1)).tolist():  # all others are too small for a sum of q
        e = np.arange(heads[i], heads[i] + sizes[i])
        log_rest[e[most[e]]] = log_sums(np.where(most[e], -np.inf, logq[e]), np.zeros(1, np.int64))[0]
    return Lattice(first, last, byte, dst, piece, upto, logq, log_rest)


def log_sums(value: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials of each run of values; heads: where runs start."""
    top = np.maximum.reduceat(value, heads)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.append(heads, len(value))))), heads)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


def unit_of_nodes(cuts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts) + 1)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then from starts[1] on."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


#: Nodes of the units that are kept from slice to slice: about 90 bytes each with their edges.
KEPT = 1 << 20


class Units:
    """The lattice of all units that a slice has; those of the first slices, up to `kept` nodes, stay for the next ones."""

    def __init__(self, model: Pieces, kept: int = KEPT):
        self.model, self.kept = model, kept
        nothing = lattice(np.zeros(0, np.uint8), np.zeros(1, np.int64), model)
        self.table = {name: getattr(nothing, name) for name in Lattice.__annotations__}
        self.nodes = self.edges = 0
        self.values, self.origins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _put(self, name: str, at: int, rows: np.ndarray) -> None:
        old = self.table[name]
        if at + len(rows) > len(old):
            bigger = np.empty(max(at + len(rows), min(2 * len(old), len(old) + (1 << 22))), rows.dtype)
            bigger[:at] = old[:at]
            self.table[name] = old = bigger
        old[at : at + len(rows)] = rows

    def _add(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, nodes: int, edges: int) -> tuple[np.ndarray, int, int]:
        """Adds units after so many nodes and edges: their first nodes, and nodes and edges then."""
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        new = lattice(data[spans(starts, sizes)], cuts, self.model)
        self._put("first", nodes, new.first + edges)
        for name in ("last", "byte"):
            self._put(name, nodes, getattr(new, name))
        self._put("target", edges, new.target + nodes)
        for name in ("pieces", "upto", "logq", "log_rest"):
            self._put(name, edges, getattr(new, name))
        return nodes + cuts[:-1] + np.arange(len(sizes)), nodes + len(new.last), edges + len(new.target)

    def find(self, data: np.ndarray, found: B.Tokens) -> tuple[np.ndarray, Lattice]:
        """The first node of each unit, and the lattice, which holds until the next call."""
        value, sizes = B.hashes(data, found), found.ends - found.starts
        coded = pa.array(value).dictionary_encode()
        code, distinct = np.asarray(coded.indices), np.asarray(coded.dictionary)
        where = np.zeros(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        at = np.minimum(np.searchsorted(self.values, distinct), max(0, len(self.values) - 1))
        known = self.values[at] == distinct if len(self.values) else np.zeros(len(distinct), bool)
        first, size = np.zeros(len(distinct), np.int64), sizes[where]
        first[known], size[known] = self.origins[at[known]], self.sizes[at[known]]
        fresh = np.flatnonzero(~known)
        first[fresh], nodes, edges = self._add(data, found.starts[where[fresh]], size[fresh], self.nodes, self.edges)
        if nodes <= self.kept:
            self.nodes, self.edges = nodes, edges
            self.values = np.concatenate([self.values, distinct[fresh]])
            order = np.argsort(self.values)
            self.values = self.values[order]
            self.origins, self.sizes = np.concatenate([self.origins, first[fresh]])[order], np.concatenate([self.sizes, size[fresh]])[order]
        origin = first[code]
        # units of one hash are compared byte by byte; what differs has a lattice of its own
        differs = size[code] != sizes
        same = data == self.table["byte"][np.minimum(spans(origin, sizes), nodes - 1)] if len(data) else np.zeros(0, bool)
        if not same.all():
            differs[np.unique(np.searchsorted(found.starts, np.flatnonzero(~same), "right") - 1)] = True
        if differs.any():
            origin[differs], nodes, edges = self._add(data, found.starts[differs], sizes[differs], nodes, edges)
        return origin, Lattice(**self.table)


def _seeds(keys: np.ndarray, *stream: int) -> np.ndarray:
    """A seed of each key for what the numbers of the stream name."""
    with np.errstate(over="ignore"):
        for x in stream:
            keys = B.mix(keys + np.uint64(x + 1) * np.uint64(0x9E3779B97F4A7C15))
        return keys


_PLACE, _TWIN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: What a stream of noise is for: first maxima, steps of a walk, the edge that a resumed path takes, what then is left.
_TOP, _STEP, _EDGE, _LEFT = range(4)


class Texts:
    """The units of a slice's texts and their lattice."""

    def __init__(self, piece: B.Slice, model: Pieces, keys: np.ndarray, units: Units | None = None):
        counts = np.diff(piece.offsets)
        full = counts > 0
        # a space before every text that is not empty
        self.offsets = np.concatenate([[0], np.cumsum(counts + full)])
        data = np.full(self.offsets[-1], _SPACE, np.uint8)
        row = np.repeat(np.arange(piece.rows), counts)
        data[np.arange(len(piece.data)) + np.cumsum(full)[row]] = piece.data
        self.data, self.model, self.keys = data, model, keys
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets] = True
        if len(data):
            space, feed = data == _SPACE, data == _FEED
            cut[1:-1] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        places = np.flatnonzero(cut)
        if not len(data):
            places = np.zeros(1, np.int64)
        self.starts = places[:-1]
        found = B.Tokens(places[:-1], places[1:], np.searchsorted(places[:-1], self.offsets))
        self.bounds = found.bounds  # units of each row
        self.origin, self.lattice = (units or Units(model)).find(data, found)  # first node of each unit
        self.row = np.repeat(np.arange(piece.rows), np.diff(self.bounds))

    def walk(self, unit: np.ndarray, node: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draws each given unit from a node to its end: counts, and nodes, edges and a hash of each step in order."""
        lat, steps, n = self.lattice, [], len(unit)
        count = np.zeros(n, np.int64)
        live = np.flatnonzero(~lat.last[node])
        here, own = node[live], unit[live]
        seed = _seeds(self.keys, _STEP, draw)[self.row[own]]
        start = (self.starts[own] - self.offsets[self.row[own]] - self.origin[own]).view(np.uint64)
        while len(live):
            with np.errstate(over="ignore"):
                noise = B.mix(seed ^ ((start + here.view(np.uint64)) * _PLACE))  # by its place in the text
            u = B.unit(noise)
            edge = lat.first[here]
            over = np.flatnonzero(u > lat.upto[edge])
            while len(over):
                edge[over] += 1
                over = over[u[over] > lat.upto[edge[over]]]
            steps.append((live, here, edge, noise))
            count[live] += 1
            here = lat.target[edge]
            go = np.flatnonzero(~lat.last[here])
            live, here, seed, start = live[go], here[go], seed[go], start[go]
        first = np.cumsum(count) - count
        total = int(count.sum())
        nodes, edges, noises = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.uint64)
        for i, (live, here, edge, noise) in enumerate(steps):
            at = first[live] + i
            nodes[at], edges[at], noises[at] = here, edge, noise
        return count, nodes, edges, noises


def truncated(mass: np.ndarray, noise: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel variables located at mass, given that they do not exceed bound; noise: uniform numbers."""
    with np.errstate(divide="ignore"):
        return mass - np.log(-np.log(noise) + np.exp(np.minimum(mass - bound, 700)))


@dataclass
class Draw:
    """One sample of each row that has it: its own steps, after a head that it shares with an earlier draw."""

    rows: np.ndarray  # whether a row has this sample
    bounds: np.ndarray  # own steps of each row
    node: np.ndarray
    edge: np.ndarray
    unit: np.ndarray
    before: np.ndarray  # log-probability up to a step
    groups: np.ndarray  # the perturbed maximum of what leaves the path at a step and is not drawn yet
    best: np.ndarray  # of a row: the largest of these
    log_prob: np.ndarray
    value: np.ndarray
    ids: np.ndarray  # of whole samples
    id_bounds: np.ndarray
    head: np.ndarray  # of a row: pieces before its own steps
    inclusion: np.ndarray | None = None


def draw(texts: Texts, k: int) -> list[Draw]:
    """Up to k samples of each row, by falling perturbed value."""
    lat, rows = texts.lattice, len(texts.offsets) - 1
    value = -np.log(-np.log(B.unit(_seeds(texts.keys, _TOP))))
    unit = np.arange(len(texts.origin))
    node = texts.origin
    offset, active = np.zeros(rows), np.ones(rows, bool)
    draws: list[Draw] = []
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of a row: draw, step and edge that were resumed
    resumed = None
    for j in range(k):
        count, nodes, edges, noise = texts.walk(unit, node, j)
        owner = np.repeat(unit, count)
        row_of = texts.row[owner]
        bounds = np.searchsorted(row_of, np.arange(rows + 1))
        logs = lat.logq[edges]
        run = np.empty(len(logs))
        cuts = bounds.tolist()
        filled = np.flatnonzero(np.diff(bounds))
        for r in filled.tolist():  # row by row, so that sums do not depend on the slice
            np.cumsum(logs[cuts[r] : cuts[r + 1]], out=run[cuts[r] : cuts[r + 1]])
        run += offset[row_of]
        before = run - logs
        total = offset.copy()
        total[filled] = run[bounds[filled + 1] - 1]
        groups = truncated(before + lat.log_rest[edges], B.unit(B.mix(noise ^ _TWIN)), value[row_of])
        best = np.full(rows, -np.inf)
        if len(filled):
            best[filled] = np.maximum.reduceat(groups, bounds[filled])
        own = lat.pieces[edges]
        head = np.zeros(rows, np.int64)
        if resumed is None:
            ids, id_bounds = own, bounds
        else:
            then, top, step, edge = resumed
            shared = np.zeros(rows, np.int64)
            for p in np.unique(top):
                mine = then[top == p]
                shared[mine] = draws[p].head[mine] + step[top == p] - draws[p].bounds[mine]
            head[then] = shared[then] + 1
            sizes = head + np.diff(bounds)
            id_bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.empty(id_bounds[-1], own.dtype)
            for p in np.unique(top):
                mine = then[top == p]
                ids[spans(id_bounds[mine], shared[mine])] = draws[p].ids[spans(draws[p].id_bounds[mine], shared[mine])]
            ids[id_bounds[then] + shared[then]] = lat.pieces[edge]
            ids[spans(id_bounds[:-1] + head, np.diff(bounds))] = own
        draws.append(Draw(active.copy(), bounds, nodes, edges, owner, before, groups, best, total, value.copy(), ids, id_bounds, head))
        if j + 1 == k:
            break
        table = np.stack([d.best for d in draws])
        found = table.max(axis=0)
        active = active & (found > -np.inf)
        then = np.flatnonzero(active)
        if not len(then):
            break
        # the group of the largest value in each row
        top, found = table.argmax(axis=0)[then], found[then]
        step, here, place, taken = np.zeros((4, len(then)), np.int64)
        log_before = np.zeros(len(then))
        for p in np.unique(top):
            d, mine = draws[p], np.flatnonzero(top == p)
            its_row = np.repeat(np.arange(rows), np.diff(d.bounds))
            hit = np.flatnonzero(d.groups == d.best[its_row])
            step[mine] = at = hit[np.searchsorted(its_row[hit], then[mine])]
            here[mine], place[mine], taken[mine], log_before[mine] = d.node[at], d.unit[at], d.edge[at], d.before[at]
        # one of the edges that have not left there yet, by their probabilities
        sizes = lat.first[here + 1] - lat.first[here]
        heads = np.cumsum(sizes) - sizes
        edge_of, which = spans(lat.first[here], sizes), np.repeat(np.arange(len(then)), sizes)
        free = edge_of != taken[which]
        for old_top, old_step, old_edge in gone:
            free &= ~((old_top[then] == top) & (old_step[then] == step))[which] | (edge_of != old_edge[then][which])
        log_free = np.where(free, lat.logq[edge_of], -np.inf)
        share = np.exp(log_free - np.repeat(log_sums(log_free, heads), sizes))
        upto = share.copy()
        for i in range(1, int(sizes.max())):
            more = heads[sizes > i] + i
            upto[more] += upto[more - 1]
        upto[np.maximum.reduceat(np.where(log_free > -np.inf, np.arange(len(upto)), -1), heads)] = 2.0
        keys = texts.keys[then]
        slot = np.minimum.reduceat(np.where(B.unit(_seeds(keys, _EDGE, j))[which] <= upto, np.arange(len(upto)), len(upto)), heads)
        edge = edge_of[slot]
        log_free[slot] = -np.inf
        left = truncated(log_before + log_sums(log_free, heads), B.unit(_seeds(keys, _LEFT, j)), found)
        for p in np.unique(top):
            d, mine = draws[p], top == p
            d.groups[step[mine]] = left[mine]
            filled = np.flatnonzero(np.diff(d.bounds))
            d.best[filled] = np.maximum.reduceat(d.groups, d.bounds[filled])
        record = np.full((3, rows), -1)
        record[:, then] = top, step, edge
        gone.append(tuple(record))
        offset = np.zeros(rows)
        offset[then] = log_before + lat.logq[edge]
        value[then] = found
        units = texts.bounds[then + 1] - place
        unit = spans(place, units)
        node = texts.origin[unit]
        node[np.cumsum(units) - units] = lat.target[edge]
        resumed = then, top, step, edge
    limit = np.max([d.best for d in draws], axis=0)
    for d in draws:
        with np.errstate(over="ignore", invalid="ignore"):
            d.inclusion = np.where(limit == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(700.0, d.log_prob - limit))))
    return draws


def sample(texts: Texts, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each row up to k (ids, log-probability, perturbed value, inclusion score)."""
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in range(len(texts.offsets) - 1)]
    for d in draw(texts, k):
        for r in np.flatnonzero(d.rows).tolist():
            out[r].append((d.ids[d.id_bounds[r] : d.id_bounds[r + 1]], float(d.log_prob[r]), float(d.value[r]), float(d.inclusion[r])))
    return out


def exact_rows(texts: Texts, d: Draw) -> np.ndarray:
    """Whether each row's sample decodes to its text; true for rows without this sample."""
    model = texts.model
    size = np.concatenate([[0], np.cumsum(model.cuts[d.ids + 1] - model.cuts[d.ids])])[d.id_bounds]
    said, out = model.decode(d.ids), ~d.rows | (np.diff(size) == np.diff(texts.offsets))
    if out.all() and d.rows.all():
        if not np.array_equal(said, texts.data):
            out[np.searchsorted(texts.offsets, np.flatnonzero(said != texts.data), "right") - 1] = False
        return out
    for r in np.flatnonzero(d.rows & out).tolist():
        out[r] = np.array_equal(said[size[r] : size[r + 1]], texts.data[texts.offsets[r] : texts.offsets[r + 1]])
    return out


def row_seeds(column: pa.Array, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.asarray(column.fill_null(-1), np.int64).view(np.uint64) * np.uint64(3) + np.asarray(column.is_null()).astype(np.uint64)
        return B.mix(key + B.mix(np.full(len(key), seed, np.uint64)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, alpha: float = 0.4, seed: int = 17, model_path: str = MODEL) -> DataFrame:
    """doc_id, samples (ids, log_prob, value, inclusion), exact: one row for each row of df.

    exact: every sample decodes to the text, byte by byte.
    """
    model = Pieces.load(model_path, alpha)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    units = Units(model)  # each task's own

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        keys = row_seeds(batch.column(0), seed)
        for piece in B.slices(batch.column(1), SLICE):  # a result for each slice: a batch's ids are never all held
            texts = Texts(piece, model, keys[piece.first : piece.first + piece.rows], units)
            draws = draw(texts, k)
            counts = np.concatenate([[0], np.cumsum(np.sum([d.rows for d in draws], axis=0))])
            sizes, numbers = np.zeros(counts[-1], np.int64), np.zeros((3, counts[-1]))
            for j, d in enumerate(draws):  # the samples of a row stand together
                at = counts[:-1][d.rows] + j
                sizes[at] = np.diff(d.id_bounds)[d.rows]
                numbers[:, at] = d.log_prob[d.rows], d.value[d.rows], d.inclusion[d.rows]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.zeros(ends[-1], np.int32)
            for j, d in enumerate(draws):
                at = counts[:-1][d.rows] + j
                ids[spans(ends[at], sizes[at])] = d.ids
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            structs = pa.StructArray.from_arrays([lists, *map(pa.array, numbers)], ["ids", "log_prob", "value", "inclusion"])
            samples = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), structs)
            yield {"doc_id": batch.column(0).slice(piece.first, piece.rows), "samples": samples, "exact": pa.array(np.all([exact_rows(texts, d) for d in draws], axis=0))}

    return map_batches(source, run, "doc_id long, samples array<struct<ids: array<int>, log_prob: double, value: double, inclusion: double>>, exact boolean")


def decode(df: DataFrame, ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """df's id column first, then text: what the piece ids of each row say.

    df: an id column and ids_col, an array of ids. A null array, a null in it and an id that the model
    does not have give a null text; bytes that are no UTF-8 give U+FFFD.
    """
    model = Pieces.load(model_path)
    key = next(c for c in df.columns if c != ids_col)

    def said(ids: list | None) -> str | None:
        if ids is None or any(x is None or not 0 <= x < len(model.weight) for x in ids):
            return None
        return model.decode(np.asarray(ids, np.int64)).tobytes()[1 if ids else 0 :].decode("utf-8", "replace")

    def run(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "text": pa.array(map(said, batch.column(1).to_pylist()), pa.string())}

    return map_batches(df.select(key, ids_col), run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, exact, n_samples and for each row its samples' lengths, log-probabilities, inclusion scores and hashes of ids."""
    each = lambda f: F.transform("samples", f)
    return encoded.select(
        "doc_id", "exact", F.size("samples").alias("n_samples"), each(lambda s: F.size(s["ids"])).alias("n_pieces"), each(lambda s: s["log_prob"]).alias("log_probs"),
        each(lambda s: s["inclusion"]).alias("inclusions"), each(lambda s: F.xxhash64(s["ids"])).alias("ids_hashes"),
    )
