"""Toxicity: a two-state linear-chain conditional random field over words.

Tokens are lower-cased words. The labels mark documents, so training tokens get theirs from them: a
word, or a prefix of 4 to 8 bytes, that toxic documents of the sample hold significantly more often
(likelihood ratio at least `EVIDENCE` and at least `PURITY` of its documents toxic) marks its tokens
as toxic inside toxic documents; all other tokens are clean. The field has hashed features of the
word and its prefixes and a 2 x 2 transition matrix, fitted by Adam on the exact likelihood.

Forward-backward marginals come from a blocked scan: transfer matrices of 32 tokens, a pass over a
document's blocks, then all tokens of all documents of a slice at once. A document's score is a
logistic function of its noisy-or of the marginals and its length. Offending offsets are the runs of
tokens with a marginal of 0.5 or more, in code points, end exclusive.

Fitting looks at no more than `SAMPLE` labelled rows outside the held-out fold, on the driver.
Scoring reads whole texts; null and empty texts have no token. Without labelled toxic rows every
score is the share of toxic rows, or 0. Columns other than id, text and label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import _bytes as B
from scriptorium.llm._common import crc_mod, map_batches
from scriptorium.llm._labelled import labelled_sample

#: Rows of each label that fitting may look at.
SAMPLE = {0: 1800, 1: 900}
BITS = 20
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 5, 6, 7, 8)
EVIDENCE, PURITY = 30.0, 0.3
_BLOCK = 32


def features(piece: B.Slice) -> tuple[np.ndarray, B.Tokens]:
    """Hashed buckets of shape (kinds, tokens); bucket 0 stands for no feature."""
    data = B.LOWER[piece.data]
    found = B.tokens(data, piece.offsets, B.ALNUM)
    up, down = B.powers(len(data) + 1)
    size = found.ends - found.starts
    kinds = [B.hashes(data, found)]
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(B._VALUES[data] * up[: len(data)], out=total[1:])
        for k in PREFIXES:
            cut = np.minimum(found.starts + k, found.ends)
            kinds.append(np.where(size > k, B.mix((total[cut] - total[found.starts]) * down[found.starts] + np.uint64(k)), np.uint64(0)))
    return (np.stack(kinds) >> np.uint64(64 - BITS)).astype(np.int32), found


def _blocks(bounds: np.ndarray):
    """Blocks of tokens, longest first; in the order of rows and of blocks within a row."""
    counts = np.diff(bounds)
    per_row = -(-counts // _BLOCK)
    row = np.repeat(np.arange(len(counts)), per_row)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = bounds[row] + place * _BLOCK
    length = np.minimum(_BLOCK, bounds[row + 1] - start)
    order = np.argsort(-length, kind="stable")
    return row[order], place[order], start[order], length[order]


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    transitions: np.ndarray  # logs, from clean/toxic to clean/toxic; a document starts after a clean token
    calibration: np.ndarray  # of [1, log noisy-or sum, log tokens]

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[buckets].sum(axis=0, dtype=np.float64) + self.bias

    def marginals(self, emission: np.ndarray, bounds: np.ndarray, gradient: bool = False):
        """P(toxic) of each token; with gradient also the expected transitions and log Z."""
        n = len(emission)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), 0.0) if gradient else np.zeros(0)
        toxic = 1 / (1 + np.exp(-np.clip(emission, -30, 30)))
        row, place, start, length = _blocks(bounds)
        m = len(row)
        live = [int(np.searchsorted(-length, -t, "left")) for t in range(_BLOCK)]  # blocks longer than t
        em = np.ones((_BLOCK, m))
        at = start + np.arange(_BLOCK)[:, None]
        held = np.arange(_BLOCK)[:, None] < length
        em[held] = toxic[at[held]]
        (a00, a01), (a10, a11) = np.exp(self.transitions)
        p00, p01, p10, p11 = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
        for t in range(_BLOCK):
            k = live[t]
            if not k:
                break
            e1 = em[t, :k]
            e0 = 1 - e1
            x00, x01, x10, x11 = p00[:k], p01[:k], p10[:k], p11[:k]
            y00, y01 = (x00 * a00 + x01 * a10) * e0, (x00 * a01 + x01 * a11) * e1
            y10, y11 = (x10 * a00 + x11 * a10) * e0, (x10 * a01 + x11 * a11) * e1
            scale = 1 / (y00 + y01 + y10 + y11)
            p00[:k], p01[:k], p10[:k], p11[:k] = y00 * scale, y01 * scale, y10 * scale, y11 * scale
        # over the blocks of each row
        by_row = np.lexsort((place, row))
        rows, firsts, counts = np.unique(row[by_row], return_index=True, return_counts=True)
        longest = np.argsort(-counts, kind="stable")
        firsts, counts = firsts[longest], counts[longest]
        in0, in1 = np.ones(m), np.zeros(m)
        out0, out1 = np.ones(m), np.ones(m)
        c0, c1 = np.ones(len(rows)), np.zeros(len(rows))
        for j in range(int(counts[0])):
            k = int(np.searchsorted(-counts, -j, "left"))
            b = by_row[firsts[:k] + j]
            x, y = c0[:k], c1[:k]
            in0[b], in1[b] = x, y
            u, v = x * p00[b] + y * p10[b], x * p01[b] + y * p11[b]
            s = 1 / (u + v)
            c0[:k], c1[:k] = u * s, v * s
        c0, c1 = np.ones(len(rows)), np.ones(len(rows))
        for j in range(int(counts[0]) - 1, -1, -1):
            k = int(np.searchsorted(-counts, -j, "left"))
            b = by_row[firsts[:k] + j]
            x, y = c0[:k], c1[:k]
            out0[b], out1[b] = x, y
            u, v = p00[b] * x + p01[b] * y, p10[b] * x + p11[b] * y
            s = 1 / (u + v)
            c0[:k], c1[:k] = u * s, v * s
        # within the blocks
        f0, f1 = np.ones((_BLOCK + 1, m)), np.zeros((_BLOCK + 1, m))
        f0[0], f1[0] = in0, in1
        log_z = 0.0
        for t in range(_BLOCK):
            k = live[t]
            if not k:
                break
            u, v = f0[t, :k], f1[t, :k]
            y = (u * a01 + v * a11) * em[t, :k]
            x = (u * a00 + v * a10) * (1 - em[t, :k])
            total = x + y
            if gradient:
                log_z += float(np.log(total).sum() - np.log(u + v).sum())
            f0[t + 1, :k], f1[t + 1, :k] = x / total, y / total
        part = np.zeros((_BLOCK, m))
        pairs = np.zeros((2, 2))
        b0, b1 = out0.copy(), out1.copy()
        for t in range(_BLOCK - 1, -1, -1):
            k = live[t]
            if not k:
                continue
            x, y = b0[:k], b1[:k]
            clean, bad = f0[t + 1, :k] * x, f1[t + 1, :k] * y
            part[t, :k] = bad / (clean + bad)
            e1 = em[t, :k]
            g0, g1 = (1 - e1) * x, e1 * y
            if gradient:
                u, v = f0[t, :k], f1[t, :k]
                q = np.array([u * a00 * g0, u * a01 * g1, v * a10 * g0, v * a11 * g1])
                pairs += (q / q.sum(axis=0)).sum(axis=1).reshape(2, 2)
            u, v = a00 * g0 + a01 * g1, a10 * g0 + a11 * g1
            s = 1 / (u + v)
            b0[:k], b1[:k] = u * s, v * s
        out = np.zeros(n)
        out[at[held]] = part[held]
        return (out, pairs, log_z - float(np.log1p(-toxic).sum())) if gradient else out

    def scores(self, marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(marginals, bounds) @ self.calibration, -35, 35)))


def evidence(marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[1, log of the noisy-or's exponent, log of the number of tokens] of each row."""
    exponent = B.sums(-np.log1p(-np.minimum(marginals, 1 - 1e-9)), bounds)
    return np.stack([np.ones(len(exponent)), np.log(exponent + 1e-3), np.log(1.0 + np.diff(bounds))], axis=1)


def marked_buckets(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets that mark tokens of toxic documents, by the likelihood ratio over documents."""
    seen = np.zeros((2, 1 << BITS))
    for buckets, y in zip(docs, labels):
        seen[y, np.unique(buckets)] += 1
    toxic, clean = float((labels == 1).sum()), float((labels == 0).sum())

    def fit(k, n, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(q), 0) + np.where(n - k > 0, (n - k) * np.log1p(-q), 0)

    a, b = seen[1], seen[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        both = (a + b) / (toxic + clean)
        ratio = 2 * (fit(a, toxic, a / toxic) + fit(b, clean, b / clean) - fit(a, toxic, both) - fit(b, clean, both))
        marks = (ratio >= EVIDENCE) & (a / toxic > b / clean) & (a >= PURITY * (a + b))
    marks[0] = False
    return marks


def train(pieces: list[B.Slice], labels: np.ndarray, epochs: int = 12, rate: float = 0.3, l2: float = 1e-6) -> Field:
    seen = [features(p) for p in pieces]
    labels = np.asarray(labels)
    field = Field(np.zeros(1 << BITS, np.float64), -6.0, np.array([[0.0, -1.0], [0.0, -1.0]]), np.zeros(3))
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        field.calibration = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0])
        return field
    docs, first = [], []
    for buckets, found in seen:
        first.append(len(docs))
        docs += [buckets[:, i:j] for i, j in zip(found.bounds[:-1], found.bounds[1:])]
    marks = marked_buckets(docs, labels)
    y = [(marks[b].any(axis=0) & (np.repeat(labels[f : f + len(t.bounds) - 1], t.counts) == 1)).astype(np.float64) for (b, t), f in zip(seen, first)]
    m1, v1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    small_m, small_v = np.zeros(5), np.zeros(5)
    rng, step = np.random.Generator(np.random.PCG64(11)), 0
    for epoch in range(epochs):
        for i in rng.permutation(len(seen)):
            buckets, found = seen[i]
            if not len(y[i]):
                continue
            step += 1
            p, pairs, _ = field.marginals(field.emissions(buckets), found.bounds, gradient=True)
            wrong = p - y[i]
            state = y[i].astype(np.int64)
            before = np.concatenate([[0], state[:-1]])
            before[found.bounds[:-1][found.counts > 0]] = 0
            real = np.bincount(2 * before + state, minlength=4).reshape(2, 2)
            now = rate / (1 + epoch / 3)
            touched, which = np.unique(buckets, return_inverse=True)
            g = np.bincount(which.ravel(), np.broadcast_to(wrong, buckets.shape).ravel(), len(touched)) + l2 * field.weights[touched]
            g[touched == 0] = 0
            m1[touched] = 0.9 * m1[touched] + 0.1 * g
            v1[touched] = 0.99 * v1[touched] + 0.01 * g * g
            field.weights[touched] -= now * m1[touched] / (np.sqrt(v1[touched]) + 1e-3)
            g = np.append((pairs - real).ravel(), wrong.sum())
            small_m = 0.9 * small_m + 0.1 * g
            small_v = 0.99 * small_v + 0.01 * g * g
            move = now * small_m / (np.sqrt(small_v) + 1e-3)
            field.transitions = np.clip(field.transitions - move[:4].reshape(2, 2), -6, 6)
            field.bias -= float(move[4])
    x = np.concatenate([evidence(field.marginals(field.emissions(b), t.bounds), t.bounds) for b, t in seen])
    c = np.zeros(3)
    for _ in range(50):  # Newton for the logistic calibration
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(3)
        move = np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * c)
        c = c + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    field.calibration = c
    field.weights = field.weights.astype(np.float32)
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Field:
    y, texts = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, sample or SAMPLE)
    return train(list(B.slices(texts)), np.array(y, np.int64))


def tag(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (start, end, marginal) for each row of df."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        scores, starts, ends, best, per_row = [], [], [], [], []
        for piece in B.slices(batch.column(1)):
            buckets, found = features(piece)
            p = field.marginals(field.emissions(buckets), found.bounds)
            scores.append(field.scores(p, found.bounds))
            rows = found.row
            bad = np.flatnonzero(p >= 0.5)
            chars = B.code_points(piece.data)
            new = np.ones(len(bad), bool)
            new[1:] = (np.diff(bad) > 1) | (rows[bad[1:]] != rows[bad[:-1]])
            head, tail = bad[new], bad[np.append(new[1:], True)] if len(bad) else bad
            origin = chars[piece.offsets[rows[head]]]
            starts.append(chars[found.starts[head]] - origin)
            ends.append(chars[found.ends[tail]] - origin)
            best.append(np.maximum.reduceat(p[bad], np.flatnonzero(new)) if len(bad) else np.zeros(0))
            per_row.append(np.bincount(rows[head], minlength=piece.rows))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(per_row))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends)), pa.array(np.concatenate(best))], ["start", "end", "marginal"])
        return {"doc_id": batch.column(0), "score": np.concatenate(scores), "spans": pa.ListArray.from_arrays(pa.array(offsets), spans)}

    return map_batches(source, run, "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for each row of docs."""
    out = tag(docs, fit(docs, labels, sample))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
