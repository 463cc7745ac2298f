r"""Document fingerprints: I-Match with several randomised lexicon subsets. DataFrame operations only.

Terms are the distinct words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lower-cased text. The lexicon
holds the terms whose share of all documents lies in the band [`low`, `high`] (an inverse document
frequency band). Hex digits of a term's MD5 deal it to 16 random subsets of the lexicon, at rates of
1/2, 1/4, 1/16 and 1/64: coarse subsets tell copies apart from edits, fine ones still agree
after heavy edits. A component is a hash of a document's sorted distinct terms in a subset; an
empty one is written as dashes. A text without any lexicon term has the hash of its lower-cased self
in all components. Likeness is the share of equal components among those that either text has.

The edited text of a document is its own with the last floor(n/2) code points replaced by the first
as many (or all) of the next document's in descending id (after the last: the first).

Plan: one pass counts document frequencies (pre-aggregated); one shuffle sends every text to a
bucket of neighbouring ids, with a copy of the next bucket's first row at its end, so `lead` finds
the next text without a global sort; terms are looked up in the lexicon by a broadcast join and
gathered again on the same partitioning. A term of the band is in at least `low` of all documents,
so the lexicon has at most (distinct terms a document) / low terms; it is only broadcast below
`BROADCAST_TERMS`, counted first, and joined by a shuffle beyond.

Null texts count as empty. Null ids come after all others; rows with equal ids stand in the order of
their texts' hashes. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import small, written
from scriptorium.llm.mixing import ranked

LOW, HIGH = 0.002, 0.1
#: For each subset, the two hex digits below which a term belongs to it.
SUBSETS = ["80", "80", "40", "40", "10", "10", "10", "10", "04", "04", "04", "04", "04", "04", "04", "04"]
BROADCAST_TERMS = 400_000
NONE = "--------"
_KNOTS, _BUCKET_ROWS = 128, 500
#: Files of the lexicon and of the buckets' heads.
_FILES = 8
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _SEPARATORS)), "")


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    """term, mask: the band's terms, with a bit for each subset that holds the term."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # written before the masks are made: a condition on them would be pushed below the count, and be asked of every word
    band = written(counted.where((F.col("df") >= F.lit(low * n)) & (F.col("df") <= F.lit(high * n))).select("term"), "band", _FILES)
    digest, mask = F.md5("term"), F.lit(0)
    for j, bound in enumerate(SUBSETS):
        mask = mask + F.when(F.substring("digest", 2 * j + 1, 2) < bound, 1 << j).otherwise(0)
    return written(band.withColumn("digest", digest).select("term", mask.alias("mask")).where("mask > 0"), "lexicon", _FILES)


def _bucket(docs: DataFrame) -> Column:
    """Buckets of neighbouring (doc_id, tie), ascending, of about _BUCKET_ROWS rows; null ids in the first ones.

    Quantiles of the ids cut them into intervals of like many rows, and an interval is cut evenly. An
    id that holds more than a thousandth of all rows, or null, is an interval of its own and cut by
    its rows' ties, so that rows of one id do not meet in one bucket.
    """
    knots, n, nulls = docs.agg(F.percentile_approx("doc_id", [i / _KNOTS for i in range(_KNOTS + 1)], 10_000), F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    often = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(_BUCKET_ROWS, n // 1000))
    heavy = {r.doc_id: r.n for r in often.collect()}  # at most a thousand
    edges = sorted({*(knots or [0]), *heavy, *(h + 1 for h in heavy if h < 2**63 - 1)})
    even = max(1, -(-n // (_KNOTS * _BUCKET_ROWS)))
    # the null ids' interval, then those of the edges: where it begins, how it is cut, its first bucket
    low, parts, by_tie = [0, *edges], [max(1, -(-nulls // _BUCKET_ROWS))], [True]
    for edge in edges:
        by_tie.append(edge in heavy)
        parts.append(-(-heavy[edge] // _BUCKET_ROWS) if edge in heavy else even)
    width = [1.0, *(float(b) - float(a) for a, b in zip(edges, edges[1:])), 1.0]
    first = [sum(parts[:i]) for i in range(len(parts))]

    def search(i: int, j: int) -> Column:
        if j - i == 1:
            return F.lit(i + 2)
        mid = (i + j) // 2
        return F.when(F.col("doc_id") < F.lit(edges[mid]), search(i, mid)).otherwise(search(mid, j))

    interval = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(search(0, len(edges)))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), interval)
    by_id = (F.col("doc_id").cast("double") - of([float(x) for x in low])) * of([p / w for p, w in zip(parts, width)])
    by_hash = (F.col("tie").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * of(parts)
    share = F.floor(F.when(of(by_tie), by_hash).otherwise(by_id))
    return (of(first) + F.greatest(F.lit(0), F.least(share, of(parts) - 1))).cast("long")


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, place, doc_id, text, after (the next text), and whether the row is only another bucket's first."""
    docs = docs.withColumn("tie", F.xxhash64("text"))
    docs = docs.withColumn("bucket", _bucket(docs))
    heads = docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    chain = written(ranked(heads.withColumn("key", -F.col("bucket"))).select("rank", "bucket", "head.doc_id", "head.tie"), "heads", _FILES)
    n = chain.count()
    previous = chain.select(((F.col("rank") - 1 + n) % F.lit(max(n, 1))).alias("rank"), F.col("doc_id").alias("head_id"), F.col("tie").alias("head_tie")).join(chain.select("rank", F.col("bucket").alias("to")), "rank")
    # of equal rows one will do
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    previous = small(written(previous, "heads", _FILES))  # one row for each bucket; beyond the bound the join shuffles
    copies = docs.join(previous, (F.col("tie") == F.col("head_tie")) & same).groupBy("to", "doc_id", "tie").agg(F.first("text").alias("text"))
    rows = docs.select("bucket", "doc_id", "text", "tie", F.lit(0).alias("copy")).union(copies.select(F.col("to").alias("bucket"), "doc_id", "text", "tie", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return rows.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("after"), "copy")


def components(found: Column, otherwise: Column) -> Column:
    """The 16 components of sorted (term, mask) structs."""

    def within(j: int) -> Column:
        return F.filter(found, lambda x: x["mask"].bitwiseAND(F.lit(1 << j)) != 0)

    parts = [within(j) for j in range(len(SUBSETS))]
    hashed = F.array(*[F.when(F.size(p) > 0, F.substring(F.md5(F.array_join(F.transform(p, lambda x: x["term"]), " ")), 1, 8)).otherwise(NONE) for p in parts])
    return F.when(F.size(found) > 0, hashed).otherwise(F.array_repeat(F.substring(otherwise, 1, 8), len(SUBSETS)))


def likeness(a: Column, b: Column) -> Column:
    score = lambda keep: F.size(F.filter(F.zip_with(a, b, keep), lambda x: x))
    return score(lambda x, y: (x == y) & (x != NONE)) / score(lambda x, y: (x != NONE) | (y != NONE))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of df."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    band = lexicon(docs, low, high)
    rows = neighbours(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("bucket", "place", "copy", "doc_id", "text", n.alias("n"), F.concat(F.substr("text", F.lit(1), n - half), F.substr("after", F.lit(1), half)).alias("edited"))
    # kinds: 0 the own terms, 1 the edited text's, 2 one row for what is known of the document itself
    kinds = F.array(F.struct(F.lit(0).alias("kind"), terms(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("kind"), terms(F.col("edited")).alias("terms")), F.struct(F.lit(2).alias("kind"), F.array(F.lit(None).cast("string")).alias("terms")))
    only = lambda x: F.when(F.col("x.kind") == 2, x)
    spread = rows.select("bucket", "place", "copy", "doc_id", "text", "n", "edited", F.explode(kinds).alias("x"))
    spread = spread.select(
        "bucket", "place", F.col("x.kind").alias("kind"), only(F.col("doc_id")).alias("doc_id"), only(F.col("copy")).alias("copy"), only(F.col("n").cast("long")).alias("n_chars"),
        only(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), only(F.md5(F.lower("text"))).alias("own_text"), only(F.md5(F.lower("edited"))).alias("edited_text"), F.explode("x.terms").alias("term"),
    )
    looked = spread.join(F.broadcast(band) if band.count() <= BROADCAST_TERMS else band, "term", "left").where("mask is not null or kind = 2")
    own = {c: F.max(c).alias(c) for c in ("doc_id", "copy", "n_chars", "sha", "own_text", "edited_text")}
    found = F.collect_list(F.when(F.col("kind") < 2, F.struct("kind", "term", "mask"))).alias("found")
    gathered = looked.groupBy("bucket", "place").agg(*own.values(), found)
    of = lambda k: F.array_sort(F.transform(F.filter("found", lambda x: x["kind"] == k), lambda x: F.struct(x["term"].alias("term"), x["mask"].alias("mask"))))
    gathered = gathered.withColumns({"mine": of(0), "other": of(1)}).withColumns({"fp": components(F.col("mine"), F.col("own_text")), "edited_fp": components(F.col("other"), F.col("edited_text"))})
    order = Window.partitionBy("bucket").orderBy("place")
    gathered = gathered.select("doc_id", "copy", "n_chars", "sha", "fp", "edited_fp", F.coalesce(F.lead("fp").over(order), F.col("fp")).alias("next_fp")).where("copy = 0")
    return gathered.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.array_join("fp", "").alias("fingerprint"), F.array_join("edited_fp", "").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
