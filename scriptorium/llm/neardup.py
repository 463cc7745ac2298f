"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, stars.

A document's set is its distinct shingles of `width` lower-cased (A-Z) words
`[^\\x20\\x09-\\x0D]+`; with fewer words, the whole sequence as one shingle; without words or
text, empty and linked with nothing. Sets with 100 * |A & B| >= `percent` * |A | B| are linked;
a document's component is everything reachable over links.

1. Each document's shingles are hashed once (64 bits), dealt to 256 bins, and the least hash of
   each bin kept; an empty bin takes the value of the first full one on a probe order of its own
   (optimal densification). 42 bands of 6 bins make bucket keys: at a similarity of 0.8 a pair
   shares no bucket with a probability of 3e-6. Hashes only choose candidates.
2. Documents of one word sequence (128 bits of its SHA-256) are one class; only its
   representative (least id) goes on, so copies make no pairs. Classes are numbered, not hashed.
3. In each bucket a star: the hub (the member that shares most buckets) with every other member.
   Candidates are confirmed on the whole sets, built again from the whole texts; words are interned
   by their bytes and shingles are exact tuples of them, so no hash decides on a link or a set's size.
4. Two more turns: members that no confirmed link connects with a hub of the bucket get a hub of
   their own (another in each bucket), tested against the members of all other components. Stars
   only save work; what they leave untested is tested next.
5. The rest, exactly: in each bucket the members that were no hub there and lie in different
   components. They are grouped over shared buckets, cut into blocks of like set size, and all sets
   of two blocks are compared at once, but for blocks of one component. So every pair that shares a
   bucket is tested or already connected. This costs the square of the members that stay apart in
   a group, divided by the size classes.
6. Components by hooking to the least neighbour and contracting, each round in the shared folder.

Pairs are confirmed in tasks of bounded size: a hub with many members is split over tasks, small hubs
share one, and a text travels once for each task that needs it, not once for each pair.

Null texts count as empty. Rows with a null id come back with a null component and kept = true.
The classes are the vertices: rows that share an id but not their text lie apart, each in the
component of its own text's class; a component is named by its least id. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import PLACE, dropped, map_batches, placed_rows, shielded, ship, small, written

BINS, ROWS, BANDS = 256, 6, 42
#: About how many sets, and shingles of them, make a block.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: For each bin, the order in which it asks the bins: itself first, so a full bin keeps its own.
PROBES = np.array([[b, *(x for x in np.random.Generator(np.random.PCG64(b)).permutation(BINS) if x != b)] for b in range(BINS)]).T


def interned(data: np.ndarray, found: B.Tokens) -> pa.DictionaryArray:
    """The tokens, told apart by their bytes."""
    sizes = found.ends - found.starts
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    solid = data[np.arange(cuts[-1]) + np.repeat(found.starts - cuts[:-1], sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(solid)]).dictionary_encode()


def codes(ids: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A number for each shingle, equal for equal sequences of words only; first: its first word, length: its words."""
    base, total, top = int(ids.max(initial=0)) + 2, np.zeros(len(first), np.int64), 0
    for k in range(width):
        if top * base + base >= 1 << 62:
            coded = pa.array(total).dictionary_encode()
            total, top = np.asarray(coded.indices, np.int64), len(coded.dictionary)
        # 0 stands for no word
        total = total * base + np.where(k < length, ids[np.minimum(first + k, len(ids) - 1)] + 1, 0)
        top = top * base + base
    return total


@dataclass
class Grams:
    """The shingles of a slice's rows, repeats included."""

    code: np.ndarray  # equal for equal shingles only, within the slice
    value: np.ndarray  # 64-bit hashes
    bounds: np.ndarray
    sequence: list[bytes]  # 16 bytes of a digest of each row's words


def grams(piece: B.Slice, width: int, sequences: bool = False) -> Grams:
    data = B.LOWER[piece.data]
    found = B.tokens(data, piece.offsets, B.SOLID)
    words = interned(data, found)
    ids = np.asarray(words.indices, np.int64)
    counts = found.counts
    made = np.where(counts >= width, counts - width + 1, counts > 0)
    bounds = np.concatenate([[0], np.cumsum(made)])
    first = np.arange(bounds[-1]) + np.repeat(found.bounds[:-1] - bounds[:-1], made)
    length = np.repeat(np.minimum(counts, width), made)
    code = codes(ids, first, length, width)
    cuts = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1] if len(words.dictionary) else np.zeros(1, np.int64)
    text = np.frombuffer(words.dictionary.buffers()[2], np.uint8) if len(words.dictionary) else np.zeros(0, np.uint8)
    hashed = B.hashes(text[: cuts[-1]], B.Tokens(cuts[:-1], cuts[1:], np.array([0, len(cuts) - 1])))[ids] if len(ids) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        value = np.where(length < width, length, 0).astype(np.uint64)
        for k in range(width):
            term = hashed[np.minimum(first + k, len(hashed) - 1)] * (_MULTIPLIERS[k % 8] + np.uint64(2 * (k // 8)))
            value += np.where(k < length, term, np.uint64(0))
    digests: list[bytes] = []
    if sequences:
        sizes = found.ends - found.starts + 1  # each word and a space
        ends = np.cumsum(sizes)
        joined = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
        at = np.arange(len(joined)) - np.repeat(ends - sizes, sizes)
        inside = at < np.repeat(sizes - 1, sizes)
        joined[inside] = data[(np.repeat(found.starts, sizes) + at)[inside]]
        raw, cut = joined.tobytes(), np.concatenate([[0], ends])[found.bounds].tolist()
        digests = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(cut, cut[1:])]
    return Grams(code, B.mix(value), bounds, digests)


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the rows' bounds in them."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[bounds]


def exact_sets(texts: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of exact shingles of all texts together: values (comparable among these texts only) and bounds."""
    for piece in B.slices(texts, 1 << 62):
        found = grams(piece, width)
        return distinct(found.code, found.bounds)
    return np.zeros(0, np.int64), np.zeros(1, np.int64)


def one_permutation(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The densified bins of each row that has shingles; rows without them hold zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, BINS), np.uint64)
    full = np.zeros((n, BINS), bool)
    row = np.repeat(np.arange(n), np.diff(bounds))
    bins = (values >> np.uint64(56)).astype(np.int64)
    slot = row * BINS + bins
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    out.ravel()[slot[first]] = values[first]
    full.ravel()[slot[first]] = True
    r, b = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    for probe in PROBES[1:]:
        if not len(r):
            break
        source = probe[b]
        hit = full[r, source]
        out[r[hit], b[hit]] = out[r[hit], source[hit]]
        r, b = r[~hit], b[~hit]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A bucket key for each band of each row; the band is part of the key."""
    part = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    with np.errstate(over="ignore"):
        total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            total = B.mix(total ^ part[:, :, k])
    return total.view(np.int64)


def _signed(batch: pa.RecordBatch, width: int) -> dict:
    count, keys, digests = [], [], []
    for piece in B.slices(batch.column(1)):
        found = grams(piece, width, sequences=True)
        values, bounds = distinct(found.value, found.bounds)
        # hashes give the sizes of the sets unless two shingles of the slice share one
        coded = pa.array(found.code).dictionary_encode()
        where = np.zeros(len(coded.dictionary), np.int64)
        where[np.asarray(coded.indices)] = np.arange(len(found.code))
        alike = len(np.unique(found.value[where])) < len(where)
        count.append(np.diff(distinct(found.code, found.bounds)[1] if alike else bounds))
        keys.append(band_keys(one_permutation(values, bounds)))
        digests += found.sequence
    n = np.concatenate(count)
    keys = np.concatenate(keys)[n > 0]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)), pa.array(keys.ravel()))
    low, high = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T.copy()
    return {"doc_id": batch.column(0), PLACE[0]: batch.column(2), PLACE[1]: batch.column(3), "n_shingles": pa.array(n), "low": pa.array(low), "high": pa.array(high), "keys": lists}


def similar(pairs: pa.Table, texts: pa.Table, width: int, percent: int) -> pa.Table:
    """The pairs a, b whose sets are similar enough; texts: rep, text of all that stand in the pairs."""
    order = np.argsort(texts["rep"].to_numpy(), kind="stable")
    reps = texts["rep"].to_numpy()[order]
    values, bounds = exact_sets(texts["text"], width)
    a, b = (pairs[c].to_numpy() for c in "ab")
    held = np.zeros(len(a), bool)
    left, right = (order[np.searchsorted(reps, x)].tolist() for x in (a, b))
    for k, (i, j) in enumerate(zip(left, right)):
        both = np.concatenate([values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]]])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        held[k] = 100 * shared >= percent * (len(both) - shared) and shared > 0
    return pa.table({"a": pa.array(a[held]), "b": pa.array(b[held])})


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among pairs (hub, rep, n), distinct; texts: doc_id, text; n: the size of rep's set."""
    weight = F.col("n") + F.lit(BLOCK_SHINGLES // BLOCK_SETS)
    hubs = pairs.groupBy("hub").agg(F.sum(weight).alias("weight"))
    parts = F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES)).cast("long")
    light, most = hubs.agg(F.sum("weight"), F.max("weight")).first()
    buckets = max(1, -(-int(light or 0) // BLOCK_SHINGLES))
    if (most or 0) > BLOCK_SHINGLES:
        large = small(written(hubs.where(parts > 1).select("hub", parts.alias("parts")), "large"))
        pairs = pairs.join(large, "hub", "left")
    else:
        large, pairs = None, pairs.withColumn("parts", F.lit(None).cast("long"))
    # a large hub's members are dealt to tasks of its own, small hubs share tasks
    own = F.array(F.col("hub"), F.pmod(F.xxhash64("rep"), "parts"))
    task = F.when(F.col("parts").isNotNull(), own).otherwise(F.array(F.lit(-1).cast("long"), F.pmod(F.xxhash64("hub"), F.lit(buckets))))
    placed = written(pairs.select(task.alias("task"), F.col("hub").alias("a"), F.col("rep").alias("b")), "placed")
    need = placed.select(F.col("task").alias("for_task"), F.col("a").alias("rep")).union(placed.select("task", "b")).distinct()
    whole = need.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("for_task", "rep", "text")
    ship(pairs.sparkSession)
    found = written(placed.groupBy("task").cogroup(whole.groupBy("for_task")).applyInArrow(lambda x, y: similar(x, y, width, percent), "a long, b long"), "found")
    dropped(*([placed] if large is None else [large, placed]))
    return found


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b; sets are (values, bounds)."""
    n, m = len(a[1]) - 1, len(b[1]) - 1
    out = np.zeros(n * m, np.int64)
    both = np.intersect1d(a[0], b[0])
    if not len(both):
        return out.reshape(n, m)
    sides = []
    for values, bounds in (a, b):
        column = np.minimum(np.searchsorted(both, values), len(both) - 1)
        held = both[column] == values
        order = np.argsort(column[held], kind="stable")
        sides.append((column[held][order], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[held][order]))
    (ca, ra), (cb, rb) = sides
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    first = np.cumsum(nb) - nb
    dense = na * nb * 200 > n * m  # there a product of matrices is cheaper than listing pairs
    place = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), 1024):
        x, y = np.zeros((n, 1024), np.float32), np.zeros((m, 1024), np.float32)
        for matrix, c, r in ((x, ca, ra), (y, cb, rb)):
            here = dense[c] & (place[c] >= low) & (place[c] < low + 1024)
            matrix[r[here], place[c[here]] - low] = 1
        out += (x @ y.T).astype(np.int64).ravel()
    c, r = ca[~dense[ca]], ra[~dense[ca]]
    ends = np.cumsum(nb[c])
    at = 0
    while at < len(c):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + (1 << 22), "right")))
        times = nb[c[at:stop]]
        other = np.arange(times.sum()) + np.repeat(first[c[at:stop]] - (np.cumsum(times) - times), times)
        out += np.bincount(np.repeat(r[at:stop], times) * m + rb[other], minlength=n * m)
        at = stop
    return out.reshape(n, m)


def block_links(rows: pa.Table, width: int, percent: int) -> pa.Table:
    """The similar pairs a, b across components: of side 0 with side 1, or of side 0 alone."""
    rows = rows.sort_by("side")
    first = int(np.count_nonzero(rows["side"].to_numpy() == 0))
    values, bounds = exact_sets(rows["text"], width)
    cut = bounds[first]
    sets = (values[:cut], bounds[: first + 1]), (values[cut:], bounds[first:] - cut)
    reps, comps = ((x[:first], x[first:]) for x in (rows["rep"].to_numpy(), rows["comp"].to_numpy()))
    other = 1 if len(reps[1]) else 0
    shared = common(sets[0], sets[other])
    total = np.diff(sets[0][1])[:, None] + np.diff(sets[other][1])
    held = (100 * shared >= percent * (total - shared)) & (shared > 0) & (comps[0][:, None] != comps[other])
    i, j = np.nonzero(held if other else np.triu(held, 1))
    a, b = reps[0][i], reps[other][j]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def rest_links(owned: DataFrame, hubs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) among the members of a bucket (key, rep, n, comp) that no star has compared."""
    free = owned.join(hubs, ["key", "rep"], "left_anti")
    keys = free.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("least")).where("lo <> hi").select("key", "least")
    left = written(free.join(keys, "key").select("rep", "n", "comp", "least").distinct(), "open")
    if left.isEmpty():
        dropped(left)
        return None
    groups = components(left.select(F.col("least").alias("a"), F.col("rep").alias("b"))).select(F.col("v").alias("rep"), F.col("root").alias("group"))
    # linked sets are of one size class or of neighbouring ones
    step = math.log(max(1.01, 100 / max(1, percent))) * 1.001
    rows = left.select("rep", "n", "comp").distinct().join(groups, "rep").withColumn("class", F.floor(F.log("n") / F.lit(step)))
    most = rows.groupBy("group", "comp").count().groupBy("group").agg(F.max(F.struct("count", "comp")).alias("m")).select("group", F.col("m.comp").alias("major"))
    rows = written(rows.join(most, "group").withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "grouped")
    where = ["group", "class", "minor"]
    parts = rows.groupBy(*where).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    rows = rows.join(parts, where).withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    where.append("part")
    blocks = written(rows.groupBy(*where).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).withColumn("block", F.monotonically_increasing_id()), "blocks")
    x, y = (blocks.select("group", *(F.col(c).alias(c + k) for c in ("class", "lo", "hi", "block"))) for k in "xy")
    tasks = x.join(y, "group").where("blockx <= blocky and abs(classx - classy) <= 1 and least(lox, loy) <> greatest(hix, hiy)")
    tasks = written(tasks.select("blockx", "blocky").withColumn("task", F.monotonically_increasing_id()), "tasks")
    sides = tasks.select("task", F.col("blockx").alias("block"), F.lit(0).alias("side")).union(tasks.where("blockx <> blocky").select("task", F.col("blocky").alias("block"), F.lit(1).alias("side")))
    whole = rows.join(blocks.select(*where, "block"), where).select("block", "rep", "comp").join(sides, "block")
    whole = whole.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("task", "side", "rep", "comp", "text")
    ship(owned.sparkSession)
    found = written(whole.groupBy("task").applyInArrow(lambda t: block_links(t, width, percent), "a long, b long"), "found")
    dropped(left, rows, blocks, tasks)
    return found


def components(links: DataFrame) -> DataFrame:
    """(v, root): the least vertex that each vertex of links (a, b) can reach."""
    left = written(links.select("a", "b").where("a <> b").distinct(), "links")
    first = left
    labels = left.select(F.col("a").alias("v")).union(left.select("b")).distinct().withColumn("root", F.col("v"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooked = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        jump = hooked.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = written(hooked.join(jump, "p").select("a", F.col("q").alias("p")), "parents")
        before = labels, left, parent  # the first links are read by the first labels
        labels = written(labels.join(parent.select(F.col("a").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        to_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        left = written(left.join(parent, "a").join(to_b, "b").select(F.col("p").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "links")
        dropped(*before)
    if left is not first:
        dropped(left)
    return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, stars: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and of PLACE what `keep` names: one row for each row of df.

    keep: df has PLACE already, as placed_rows gives it.
    """
    rows = df if keep else placed_rows(df.select(id_col, text_col))
    source = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *PLACE)
    signed = written(map_batches(source, lambda x: _signed(x, width), f"doc_id long, {PLACE[0]} string, {PLACE[1]} long, n_shingles long, low long, high long, keys array<long>"), "signatures")
    firsts = signed.where("n_shingles > 0 and doc_id is not null").groupBy("low", "high", "n_shingles").agg(F.min(F.struct("doc_id", *PLACE, "keys")).alias("r"))
    classes = written(firsts.select("low", "high", "n_shingles", "r.*").withColumn("rep", F.monotonically_increasing_id()), "classes")
    spread = classes.select(F.explode("keys").alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sharing = written(spread.join(shared, "key"), "sharing")
    central = sharing.groupBy("rep").agg(F.sum("size").alias("central"), F.max("n").alias("n"))
    texts = written(source.drop("doc_id").join(classes.join(central.select("rep"), "rep").select(F.col("rep").alias("doc_id"), *PLACE), list(PLACE)).select("doc_id", "text"), "candidates")
    members = written(sharing.select("key", "rep").distinct().join(central, "rep"), "members")
    dropped(sharing)

    links = labels = hubs = None  # hubs: (key, rep) that a star was drawn from
    used = [texts, members]

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("rep"))
        name = labels.select(F.col("v").alias("rep"), "root")
        used.append(written(members.join(name, "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root"), "owned"))
        return used[-1]

    owned = labelled()
    for turn in range(stars):
        rest = owned
        if hubs is not None:
            had = owned.join(hubs, ["key", "rep"], "left_semi").select("key", "comp").distinct()
            rest = owned.join(had, ["key", "comp"], "left_anti")
        order = F.col("central") if turn == 0 else F.xxhash64("key", "rep", F.lit(turn))
        hub = rest.groupBy("key").agg(F.max(F.struct(order.alias("order"), "rep", "n", "comp")).alias("h")).select("key", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.comp").alias("hub_comp"))
        hub = written(hub, "hubs")
        near = owned.join(hub, "key").where("comp <> hub_comp").where(F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n"))
        pairs = written(near.select("hub", "rep", "n").distinct(), "pairs")
        used += [hub, pairs]
        hubs = hub.select("key", F.col("hub").alias("rep")) if hubs is None else hubs.union(hub.select("key", F.col("hub").alias("rep")))
        if pairs.isEmpty():
            break
        found = confirmed(pairs, texts, width, percent)
        used.append(found)
        links = found if links is None else links.union(found)
        if labels is not None:
            used.append(labels)
        labels = components(links)
        owned = labelled()
    found = rest_links(owned, hubs, texts, width, percent) if stars else None
    if found is not None:
        used.append(found)
        if labels is not None:
            used.append(labels)
        labels = components(found if links is None else links.union(found))

    named = classes.select("low", "high", "n_shingles", "rep", F.col("doc_id").alias("least"))
    if labels is not None:
        named = named.join(labels.select(F.col("v").alias("rep"), "root"), "rep", "left").withColumn("rep", F.coalesce("root", "rep")).drop("root")
    least = named.groupBy("rep").agg(F.min("least").alias("component"))
    rep = named.join(least, "rep").select("low", "high", "n_shingles", F.col("component").alias("rep"))
    out = signed.select("doc_id", *keep, "n_shingles", "low", "high").join(rep, ["low", "high", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    dropped(*used)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *keep)


def deduplicated(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """df's rows that are kept: one of each component, and all rows with a null id."""
    mine, back = shielded(df)
    rows = placed_rows(mine)
    gone = near_duplicates(rows, id_col, keep=PLACE, **how).where("not kept").select(*PLACE)
    return rows.join(gone, list(PLACE), "left_anti").select(*back)
