"""Quality classifier: naive-Bayes features with a linear support-vector machine.

Each text is the set of its hashed n-grams: words, pairs of words and runs of four bytes; where `shape` words are
asked for, also the shapes of so many words in a row (which of them are equal, whatever they say: `a a b c`), which
is off. A feature's value is its class log-count ratio, the vector is scaled to unit length, and an L2-regularised
hinge-loss model is fitted by dual coordinate descent (one dual variable per row, bounded by C). A logistic link fitted
on a fifth of the sample that the model has not seen turns margins into probabilities. It is fitted
to at most `rows` labelled rows whose id is not held out; labels, lang, source and ids are never
inputs of a score.

Defined results: null or empty text has no features and gets the score of the intercept; with no
labelled rows of both classes all scores are that of the prior (0.5); every input row, whatever its
id, gives one output row.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_mod, text_rows
from .linear import SAMPLE_ROWS, Sparse, collect_features, folds, labelled_sample, platt
from .nptext import Chunk, chunks, mix

BITS = 18
WIDTH = 1 << BITS
THRESHOLD = 0.3
#: Words of an n-gram whose shape is a feature; 0: none.
SHAPE = 0


def indicators(c: Chunk, shape: int = SHAPE) -> np.ndarray:
    """Sorted document * WIDTH + bin of the distinct features of a chunk's documents."""
    h = c.words()
    g, at = c.word_grams(h, 2)
    b, d = c.byte_grams(4)
    f, fa = c.shapes(h, shape) if shape else (h[:0], at[:0])
    key = np.concatenate([h, g, b + np.uint64(1), f + np.uint64(2)])
    doc = np.concatenate([c.word_doc, c.word_doc[at], d, c.word_doc[fa]]).astype(np.int64)
    bins = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    k = doc * WIDTH + bins
    k.sort()
    return k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k


def encode(column: pa.Array, shape: int = SHAPE):
    for _, _, data, off in chunks(column):
        key = indicators(Chunk(data, off), shape)
        ptr = np.searchsorted(key, np.arange(len(off), dtype=np.int64) * WIDTH)
        for i in range(len(off) - 1):
            bins = key[ptr[i] : ptr[i + 1]] % WIDTH
            yield bins, np.ones(len(bins))


def log_count_ratio(x: Sparse, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = alpha + x.t_dot((y > 0).astype(float))
    q = alpha + x.t_dot((y <= 0).astype(float))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, width: int, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights: each step solves one dual variable exactly and updates w by its change."""
    w, b = np.zeros(width), 0.0
    alpha = np.zeros(len(rows))
    pick = np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(rounds):
        worst = 0.0
        for i in pick.permutation(len(rows)):
            bins, v = rows[i]
            gap = sign[i] * (float(w[bins] @ v) + b) - 1.0
            new = min(max(alpha[i] - gap / square[i], 0.0), cost)
            change = new - alpha[i]
            if change:
                w[bins] += change * sign[i] * v
                b += change * sign[i]
                alpha[i] = new
                worst = max(worst, abs(change))
        if worst < 1e-4:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, where=None, shape: int = SHAPE):
    """(log-count ratios, weights, intercept, link slope, link offset)."""
    x, y, ids = collect_features(labelled_sample(docs, labels, rows, where), partial(encode, shape=shape), WIDTH)
    aside = folds(ids)
    if len(np.unique(y)) < 2 or len(np.unique(y[~aside])) < 2:
        return np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 1.0, 0.0
    r = log_count_ratio(x.some(~aside), y[~aside])

    def scaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        bins = x.one(i)[0]
        return bins, r[bins] / max(1e-9, float(np.sqrt((r[bins] ** 2).sum())))

    w, b = dual_descent([scaled(i) for i in np.flatnonzero(~aside)], np.where(y[~aside] > 0, 1.0, -1.0), WIDTH)
    margins = np.array([float(w[k] @ v) + b for k, v in map(scaled, np.flatnonzero(aside))])
    slope, offset = platt(margins, y[aside])
    return r.astype(np.float32), (w * r).astype(np.float32), b, slope, offset


def score(c: Chunk, model, shape: int = SHAPE) -> np.ndarray:
    r, wr, b, slope, offset = model
    key = indicators(c, shape)
    doc, bins = key // WIDTH, key % WIDTH
    dot = np.bincount(doc, weights=wr[bins], minlength=c.n)
    length = np.sqrt(np.bincount(doc, weights=r[bins].astype(np.float64) ** 2, minlength=c.n))
    return 1 / (1 + np.exp(-np.clip(slope * (dot / np.maximum(length, 1e-9) + b) + offset, -35, 35)))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, shape: int = SHAPE) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0), score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows, crc_mod(F.col("doc_id"), 5) != 0, shape))  # 2 * WIDTH floats

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column("text")):
                p = score(Chunk(data, off), model.value, shape)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], batch.column("held_out")[i:j], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held = text_rows(docs).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
