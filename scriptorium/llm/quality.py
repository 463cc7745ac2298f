"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates.

Words are runs of letters, digits and non-ASCII bytes, and runs of other visible ASCII. Features are
hashed uni- and bigrams of lower-cased words, and uni-, bi- and trigrams of word shapes (case,
digits, length, repetition of the word before). A document's vector is its n-gram counts over
the square root of their number; its score is the logistic of a sparse dot product.

Fitting looks at no more than `sample` labelled rows of each label, outside the held-out fold, and
runs on the driver. Scoring reads whole texts. Null and empty texts have the intercept's score.
Without labelled rows every score is 0.5. Columns other than id, text and label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import crc_mod, map_batches, ship
from scriptorium.llm._labelled import labelled_sample

#: Rows of each label that fitting may look at.
SAMPLE = 1500
BITS = 18
FOLDS, HELD_OUT = 3, 1

_KINDS = np.where(B.SPACE, 0, 2).astype(np.uint8)
_KINDS[:0x20] = np.where(B.SPACE[:0x20], 0, 2)
_KINDS[0x30:0x3A] = _KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = _KINDS[0x80:] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def features(piece: B.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shape (kinds of n-gram, words), and the rows' bounds among the words."""
    data = B.LOWER[piece.data]
    found = B.tokens(piece.data, piece.offsets, _KINDS)
    word = B.hashes(data, found)
    n = len(word)
    size = found.ends - found.starts
    upper, digit = (np.concatenate([[0], np.cumsum(t[piece.data], dtype=np.int32)]) for t in (_UPPER, _DIGIT))
    ups, digits = upper[found.ends] - upper[found.starts], digit[found.ends] - digit[found.starts]
    last = np.zeros(n, bool)
    last[found.bounds[1:][found.counts > 0] - 1] = True
    first = np.zeros(n, bool)
    first[found.bounds[:-1][found.counts > 0]] = True
    again = np.zeros(n, bool)
    again[1:] = (word[1:] == word[:-1]) & ~first[1:]
    is_word = _KINDS[piece.data[found.starts]] == 1 if n else np.zeros(0, bool)
    code = np.minimum(size, 12) + 16 * (ups == size) + 32 * ((ups > 0) & (ups < size)) + 64 * (digits > 0)
    code = code + 128 * again
    shape = np.where(is_word, code.astype(np.uint64), word ^ np.uint64(1))

    def after(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[:-1] = x[1:]
        out[last] = 7
        return out

    with np.errstate(over="ignore"):
        shape = B.mix(shape + np.uint64(99))
        word2 = B.mix(word * np.uint64(3) + after(word))
        shape2 = B.mix(shape * np.uint64(5) + after(shape))
        shape3 = B.mix(shape2 * np.uint64(7) + after(after(shape)))
    return (np.stack([word, word2, shape, shape2, shape3]) >> np.uint64(64 - BITS)).astype(np.int32), found.bounds


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def margins(self, piece: B.Slice) -> np.ndarray:
        buckets, bounds = features(piece)
        dots = B.sums(self.weights[buckets].sum(axis=0, dtype=np.float64), bounds)
        return dots / np.sqrt(np.maximum(1, len(buckets) * np.diff(bounds))) + self.intercept


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """Follow the regularised leader over rows of (distinct buckets, values), in a fixed shuffled order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def solved(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = solved(z[at], n[at])
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            gb = p - labels[i]
            bias_z += gb - ((bias_n + gb * gb) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += gb * gb
    return Model(solved(z, n).astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    y, texts = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, {0: sample, 1: sample})
    rows = []
    for piece in B.slices(texts):
        buckets, bounds = features(piece)
        for a, b in zip(bounds[:-1], bounds[1:]):
            at, count = np.unique(buckets[:, a:b], return_counts=True)
            rows.append((at, count / np.sqrt(max(1, 5 * (b - a)))))
    return ftrl(rows, y) if rows else Model(np.zeros(1 << BITS, np.float32), 0.0)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, and the columns `keep`, for each row of df."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)

    def run(batch: pa.RecordBatch) -> dict:
        margin = np.concatenate([model.margins(s) for s in B.slices(batch.column(1))])
        p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        out = {"doc_id": batch.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32)}
        return out | {k: batch.column(2 + i) for i, k in enumerate(keep)}

    kept = "".join(f", `{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(source, run, f"doc_id long, score double, predicted int{kept}")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score(docs, fit(docs, labels, sample))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs' rows with a score of 0.5 or more; only texts go to Python."""
    model = fit(docs, labels, sample)
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        found = [model.margins(s) >= 0 for s in B.slices(text)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(good(F.col("text").cast("string")))
