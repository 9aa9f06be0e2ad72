"""Quality rules: exact counts per document and a calibrated n-gram logistic regression.

The counts (words, code points in words, symbols, repeated lines, words in repeated 5-word
windows) are exact up to 64-bit hash equality within one document. The model is a logistic
regression on hashed word 1/2-grams and 3-grams of characters (code points), as relative frequencies, fitted to at most
`rows` labelled rows, calibrated on a fifth of them that the fit has not seen, and compared with a fixed threshold. Labels, ids, lang and source are never inputs of a score.

Defined results: null or empty text has zero words and fails the base rules; the verdict of a text
without features rests on the model's intercept; without any labelled row of both classes every
text passes the model; ids may be null or repeated, every input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import bounded, text_rows
from .kept import others_go, trim
from .linear import SAMPLE_ROWS, collect_features, folds, labelled_sample, logistic, platt
from .nptext import Chunk, chunks, mix, repeats, span_hash

BITS = 18
WIDTH = 1 << BITS
#: Weight of the word and the character block; relative frequencies are small.
SCALE = 8.0
THRESHOLD = 0.6
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_rules(c: Chunk, h: np.ndarray) -> dict[str, np.ndarray]:
    """The exact counts of the documents of a chunk; h: the hashes of its words."""
    salt = mix(np.arange(c.n, dtype=np.uint64) + np.uint64(1))
    lead = (c.data & 0xC0) != 0x80
    out = {"n_words": c.n_words, "word_chars": c.per_doc(lead & c.black), "n_symbols": c.per_doc(SYMBOLS[c.data])}
    cut = np.unique(np.concatenate([np.flatnonzero(c.data == 10) + 1, c.off]))
    start, end = cut[:-1], cut[1:].copy()
    if len(start):
        end -= c.data[end - 1] == 10
        black = np.zeros(len(c.data) + 1, dtype=np.int64)
        np.cumsum(c.black, out=black[1:])
        keep = black[end] > black[start]
        start, end = start[keep], end[keep]
    doc = np.searchsorted(c.off, start, side="right") - 1
    key = mix(span_hash(c.prefix, start, end) + (end - start).astype(np.uint64)) + salt[doc]
    out["n_dup_lines"] = np.bincount(doc[repeats(key)[1]], minlength=c.n)
    grams, at = c.word_grams(h, WINDOW)
    twice = repeats(grams + salt[c.word_doc[at]])[0] if len(at) else np.zeros(0, bool)
    step = np.zeros(len(h) + WINDOW + 1, dtype=np.int64)
    step[at[twice]] += 1
    step[at[twice] + WINDOW] -= 1
    covered = np.cumsum(step)[: len(h)] > 0
    out["n_repeat_words"] = np.bincount(c.word_doc[covered], minlength=c.n)
    return out


def base_failed(n: dict[str, np.ndarray]) -> np.ndarray:
    return (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])


def grams(c: Chunk, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bin, document, weight of one occurrence) of each block of features."""
    g2, at = c.word_grams(h, 2)
    c3, d3 = c.char_grams(3)
    out = []
    for k, (key, doc) in enumerate(((np.concatenate([h, g2]), np.concatenate([c.word_doc, c.word_doc[at]])), (c3, d3))):
        bins = (((key + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        n = np.bincount(doc, minlength=c.n)
        out.append((bins, doc, SCALE / np.maximum(n, 1)))
    return out


def encode(column: pa.Array):
    for _, _, data, off in chunks(column):
        c = Chunk(data, off)
        parts = grams(c, c.words())
        doc = np.concatenate([d for _, d, _ in parts])
        bins = np.concatenate([b for b, _, _ in parts])
        vals = np.concatenate([w[d] for _, d, w in parts])
        key, inverse = np.unique(doc.astype(np.int64) * WIDTH + bins, return_inverse=True)
        total = np.bincount(inverse, weights=vals, minlength=len(key))
        ptr = np.searchsorted(key, np.arange(c.n + 1, dtype=np.int64) * WIDTH)
        for i in range(c.n):
            yield key[ptr[i] : ptr[i + 1]] % WIDTH, total[ptr[i] : ptr[i + 1]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float, float]:
    """(weights, intercept, calibration slope, calibration offset)."""
    x, y, ids = collect_features(labelled_sample(docs, labels, rows), encode, WIDTH)
    aside = folds(ids)
    if len(np.unique(y)) < 2 or len(np.unique(y[~aside])) < 2:
        return np.zeros(WIDTH, np.float32), 0.0, 1.0, 30.0
    w, b = logistic(x.some(~aside), y[~aside])
    a, c = platt((x.dot(w) + b)[aside], y[aside])
    return w.astype(np.float32), b, a, c


def score(c: Chunk, h: np.ndarray, model) -> np.ndarray:
    w, b, slope, offset = model
    margin = np.full(c.n, b, dtype=np.float64)
    for bins, doc, each in grams(c, h):
        margin += np.bincount(doc, weights=w[bins], minlength=c.n) * each
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -35, 35)))


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, quality_score, kept."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))  # WIDTH floats, 1 MB at any corpus size

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column("text")):
                c = Chunk(data, off)
                h = c.words()
                n = count_rules(c, h)
                p = score(c, h, model.value)
                failed = base_failed(n)
                cols = [batch.column("doc_id")[i:j]] + [pa.array(n[k].astype(np.int64)) for k in COUNTS]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], ["doc_id", *COUNTS, "base_failed", "quality_score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, quality_score double, kept boolean"
    return text_rows(docs).mapInArrow(run, schema)


def passing(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that the rules and the model keep. Nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    trim()  # the driver's

    def run(batches):
        others_go()
        for batch in batches:
            keep = []
            for _, _, data, off in chunks(batch.column("text")):
                c = Chunk(data, off)
                h = c.words()
                n = count_rules(c, h)
                keep.append(~base_failed(n) & (score(c, h, model.value) >= threshold))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return bounded(docs).mapInArrow(run, docs.schema)
