"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+` (null text: 0). Sources in code-point
order, null last, weigh `weights` repeating and share all words; a target stops at `limit` times its
source's size and the excess is shared again by weight until none is above.

Document rates r minimise sum(size * (r log r - r)) subject to token constraints: sum(size * r) =
target in each source, and with `balance` (a column, say the language) also that each of its values
keeps the share of words that it has in the corpus, whatever the sources' weights do to it. The dual
is convex, its solution tilts each document's rate exponentially, r = exp(lambda of its source + mu of
its value), up to `limit`. Newton steps solve it: each round one distributed sum over the sources
gives the gradient and the Hessian, from which the sources' own duals are eliminated, so the driver
solves a system of the few values only and every source moves by itself. Words of a source and value
are all that is needed, so documents are read once. Sources are met exactly, values but for a ridge
(`RIDGE` of all words), as not every share can be had together with the targets and the limit. Without
`balance` a document's rate is that of its source. A source whose target is 0 has rate 0.

Rates become copies: every document gets floor(r), and in the order of a hash of its id, documents
get one more until the words of their source (and value) come to its target. The cut is found from sums over hash
prefixes (two levels of 4096), so no source is ever sorted in one task. The error is at most half
the size of one document, and reruns agree.

Rows with a null id are ordered as the id "null"; repeated rows count one by one. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import PLACE, dropped, map_batches, placed_rows, shielded, small, written

#: Newton stops when no source's words differ from its target by more than this part.
EXACT = 1e-12
#: Values of the balanced column that have constraints of their own, by their words; the others share one.
MOST_VALUES = 8
#: How much the values' constraints give way, as a part of all words.
RIDGE = 1e-4
#: Newton rounds on both duals, and then on the sources' alone.
JOINT, ALONE = 25, 25


def _sized(batch: pa.RecordBatch) -> dict:
    counts = [c for s in B.slices(batch.column("text")) for c in B.tokens(s.data, s.offsets, B.SOLID).counts.tolist()]
    kept = {k: batch.column(k) for k in batch.schema.names if k != "text"}
    return kept | {"size": pa.array(counts, pa.int64())}


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...]) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", `{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(rows, _sized, f"doc_id long, source string{kept}, size long")


def ranked(keys: DataFrame) -> DataFrame:
    """keys (key, ...) with rank, from 0, in the order of key: sorted by ranges, not in one task."""
    spread = written(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    # one row for each range: at most the number of shuffle partitions
    before = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return spread.withColumn("within", within).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def targets(sources: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """sources (key, total) with target: water-filling by distributed sums."""
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = written(ranked(sources).withColumn("weight", pick.cast("long")), "sources")
    everything = known.agg(F.sum("total")).first()[0] or 0
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.lit(limit) * F.col("total")
        full, rest = known.agg(F.sum(F.when(capped, F.lit(limit) * F.col("total")).otherwise(0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0))).first()
        new = float(everything - (full or 0)) / rest if rest else 0.0
        if level is not None and new <= level:
            break
        level = new
    share = F.col("weight") * F.lit(level)
    return known.withColumn("target", F.when(share > F.lit(limit) * F.col("total"), (F.lit(limit) * F.col("total")).cast("double")).otherwise(share.cast("double")))


def rates(sources: DataFrame) -> DataFrame:
    """sources (key, total, target) with rate = exp(dual): Newton on sum(total * exp(x) - target * x)."""
    now = sources.withColumn("dual", F.lit(0.0))
    live = (F.col("total") > 0) & (F.col("target") > 0)
    for _ in range(100):
        words = F.col("total") * F.exp("dual")
        worst = now.where(live).agg(F.max(F.abs(words - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= EXACT:
            break
        # the gradient over the Hessian, both sums over the source's documents
        now = written(now.withColumn("dual", F.when(live, F.col("dual") - (words - F.col("target")) / words).otherwise(0.0)), "dual")
    return now.withColumn("rate", F.when(live, F.exp("dual")).otherwise(0.0)).drop("dual")


def balanced(cells: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """key, value, words, total, target, rate: rates that meet the sources' targets and keep the values' shares.

    cells: key, value (from 0 on), words; sources: key, total, target. Newton on both duals together.
    """
    live = sources.where((F.col("total") > 0) & (F.col("target") > 0))
    shares = {r.value: float(r.words) for r in cells.groupBy("value").agg(F.sum("words").alias("words")).collect()}  # at most MOST_VALUES
    k, everything = max(shares, default=0) + 1, sum(shares.values()) or 1.0
    arrays = cells.groupBy("key").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("value") == i, F.col("words"))), F.lit(0)).cast("double") for i in range(k)]).alias("w"))
    now = written(live.join(arrays, "key").select("key", "total", "target", "w", F.log(F.col("target") / F.col("total")).alias("dual"), F.array(*[F.lit(0.0)] * k).alias("mu")), "dual")
    wanted = np.array([shares.get(i, 0.0) for i in range(k)]) / everything * float(now.agg(F.sum("target")).first()[0] or 0.0)
    mu, ridge, settled = np.zeros(k), RIDGE * everything, False
    for turn in range(JOINT + ALONE):
        tilt = [F.exp(F.col("dual") + F.col("mu")[i]) for i in range(k)]  # a column, so that every round's code is the same
        words = [F.col("w")[i] * F.least(F.lit(float(limit)), t) for i, t in enumerate(tilt)]
        free = [F.when(t < limit, words[i]).otherwise(0.0) for i, t in enumerate(tilt)]
        sums = lambda parts: reduce(lambda a, b: a + b, parts)
        rows = now.select("key", "total", "target", "w", "dual", "mu", F.array(*words).alias("m"), F.array(*free).alias("h"))
        rows = rows.withColumns({"gap": sums([F.col("m")[i] for i in range(k)]) - F.col("target"), "all": sums([F.col("h")[i] for i in range(k)])})
        inverse = F.when(F.col("all") > 0, 1 / F.col("all")).otherwise(0.0)
        found = rows.agg(
            F.max(F.abs("gap") / F.col("target")).alias("worst"), F.array(*[F.sum(F.col("m")[i]) for i in range(k)]).alias("m"), F.array(*[F.sum(F.col("h")[i]) for i in range(k)]).alias("h"),
            F.array(*[F.sum(F.col("h")[i] * F.col("gap") * inverse) for i in range(k)]).alias("v"), F.array(*[F.sum(F.col("h")[i] * F.col("h")[j] * inverse) for i in range(k) for j in range(k)]).alias("hh"),
        ).first()
        if found.worst is None:
            break
        hessian = np.diag(found.h) + ridge * np.eye(k) - np.array(found.hh).reshape(k, k)
        move = np.clip(np.linalg.solve(hessian, np.array(found.v) - (np.array(found.m) - wanted + ridge * mu)), -1.0, 1.0)
        if settled or turn >= JOINT:  # the sources' targets are what has to hold
            move = np.zeros(k)
        settled = settled or bool(np.abs(move).max() <= 1e-6)
        if found.worst <= EXACT and settled:
            break
        own = (F.col("gap") + sums([F.col("h")[i] * float(move[i]) for i in range(k)])) * inverse
        step = F.when(F.col("all") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), own))).otherwise(F.when(F.col("gap") > F.lit(EXACT) * F.col("target"), 0.5).otherwise(0.0))
        before, mu = now, mu + move
        now = written(rows.select("key", "total", "target", "w", (F.col("dual") - step).alias("dual"), F.array(*[F.lit(float(m)) for m in mu]).alias("mu")), "dual")
        dropped(before)
    by_value = F.element_at(F.array(*[F.lit(float(m)) for m in mu]), F.col("value") + 1)
    rate = F.coalesce(F.least(F.lit(float(limit)), F.exp(F.col("dual") + by_value)), F.lit(0.0))
    return cells.join(sources.select("key", "total", "target"), "key").join(now.select("key", "dual"), "key", "left").select("key", "value", "words", "total", "target", rate.alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, keep: tuple[str, ...] = (), balance: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, and the columns `keep`: one row for each row of df.

    balance: a column whose values keep their shares of the words; null is a value, too.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    if balance:
        df = df.withColumn("__balance", F.coalesce(F.concat(F.lit("0"), F.col(balance).cast("string")), F.lit("1")))
    docs = sizes(df, id_col, text_col, source_col, (*keep, "__balance") if balance else keep).withColumn("key", key).withColumn("order", order)
    docs = written(docs, "sizes")
    goals = targets(docs.groupBy("key").agg(F.sum("size").alias("total")), weights, limit)
    if balance:
        large = [r["__balance"] for r in docs.groupBy("__balance").agg(F.sum("size").alias("n")).orderBy(F.col("n").desc(), "__balance").limit(MOST_VALUES - 1).collect()]
        value = F.coalesce(F.array_position(F.array(*map(F.lit, large)), F.col("__balance")) - 1, F.lit(0)) if large else F.lit(0)
        docs = docs.withColumn("value", F.when(value < 0, len(large)).otherwise(value).cast("int")).drop("__balance").withColumn("cell", F.concat_ws(":", F.col("value").cast("string"), "key"))
        cells = written(docs.groupBy("key", "value").agg(F.sum("size").alias("words")), "cells")
        sources = balanced(cells, written(goals, "goals"), limit).withColumn("cell", F.concat_ws(":", F.col("value").cast("string"), "key"))
    else:
        docs = docs.withColumn("cell", F.col("key"))
        sources = rates(goals).select(F.col("key").alias("cell"), F.col("total").alias("words"), "total", "target", "rate")
    docs = docs.withColumn("key", F.col("cell")).drop("cell", "value")
    # from here on a key is a source, or a value in it
    base = F.floor("rate")
    own = F.col("target") if not balance else F.col("rate") * F.col("words")
    sources = small(written(sources.select(F.col("cell").alias("key"), "total", "target", "rate", base.alias("base"), (own - base * F.col("words")).alias("extra")), "rates"))

    def cut(rows: DataFrame, prefix, already) -> DataFrame:
        """For each source the hash prefix in which its words reach `extra`, and the words before it."""
        parts = rows.groupBy("key", prefix.alias("prefix")).agg(F.sum("size").alias("words"))
        over = Window.partitionBy("key").orderBy("prefix")
        parts = parts.withColumn("before", F.sum("words").over(over) - F.col("words")).join(already, "key").where(F.col("done") + F.col("before") + F.col("words") > F.col("extra"))
        return parts.groupBy("key").agg(F.min("prefix").alias("cut"), F.min(F.col("done") + F.col("before")).alias("done"))

    first, second = F.substring("order", 1, 3), F.substring("order", 4, 3)
    limits = sources.select("key", "extra")
    one = small(written(cut(docs, first, limits.withColumn("done", F.lit(0))), "cut"))
    inside = docs.join(one, "key").where(first == F.col("cut")).drop("done", "cut")
    two = written(cut(inside, second, limits.join(one.select("key", "done"), "key")), "cut")
    cuts = small(written(one.select("key", F.col("cut").alias("cut1")).join(two.select("key", F.col("cut").alias("cut2"), "done"), "key", "left"), "cuts"))
    placed = docs.join(sources, "key").join(cuts, "key", "left")
    side = F.when(F.col("cut1").isNull() | (first < F.col("cut1")), -1).when(first > F.col("cut1"), 1).when(F.col("cut2").isNull() | (second < F.col("cut2")), -1).when(second > F.col("cut2"), 1).otherwise(0)
    placed = placed.withColumn("side", side)
    # only the documents of one hash prefix of each source: a 16 millionth of it
    near = placed.where("side = 0")
    middle = F.col("done") + F.sum("size").over(Window.partitionBy("key").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    near = near.withColumn("more", middle <= F.col("extra"))
    out = placed.where("side <> 0").withColumn("more", F.col("side") < 0).unionByName(near)
    copies = F.when(F.col("total") > 0, F.col("base") + F.col("more").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def mixed(df: DataFrame, **how) -> DataFrame:
    """df's rows, each as often as the mix takes it."""
    mine, back = shielded(df)
    rows = placed_rows(mine)
    copies = mix(rows, keep=PLACE, **how).where("copies > 0").select(*PLACE, F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias("__again"))
    return rows.join(copies, list(PLACE)).select(*back, F.explode("__again").alias("__copy")).select(*[F.col(f"`{c}`") for c in df.columns])
