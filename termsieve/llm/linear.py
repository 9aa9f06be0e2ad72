"""Linear models over hashed features: a bounded labelled sample, sparse matrices, calibration.

The only thing that is sampled is the labelled rows a model is fitted to: the `rows` smallest by
xxhash64(doc_id) (a documented parameter, the same at every corpus size). Everything scored is
scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_rows

#: Labelled rows a model is fitted to, at most.
SAMPLE_ROWS = 2000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, where=None) -> DataFrame:
    """(doc_id, text, label): rows with a 0/1 quality label, those of the smallest id hashes.

    The ids picked are at most `rows`, so their broadcast is bounded by that parameter.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return text_rows(docs).join(F.broadcast(picked), "doc_id")


class Sparse:
    """Rows of (bin, value), in three flat arrays."""

    def __init__(self, ptr: np.ndarray, bins: np.ndarray, vals: np.ndarray, width: int):
        self.n, self.width, self.ptr, self.bins, self.vals = len(ptr) - 1, width, ptr, bins, vals
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Sparse:
        ptr = np.concatenate([[0], np.cumsum([len(b) for b, _ in rows])]).astype(np.int64)
        join = lambda k, kind: np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
        return cls(ptr, join(0, np.int32), join(1, np.float32), width)

    def some(self, rows: np.ndarray) -> Sparse:
        """The rows picked by a mask."""
        size = np.diff(self.ptr)
        inner = np.repeat(rows, size)
        return Sparse(np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int64), self.bins[inner], self.vals[inner], self.width)

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.bins[self.ptr[i] : self.ptr[i + 1]], self.vals[self.ptr[i] : self.ptr[i + 1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.bins] * self.vals, minlength=self.n)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.bins, weights=r[self.row] * self.vals, minlength=self.width)


def collect_features(sample: DataFrame, encode: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], width: int) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Features, labels and ids of a bounded sample, in the order of the ids."""

    def run(batches):
        for b in batches:
            bins, vals = [], []
            for i, v in encode(b.column("text")):
                bins.append(i.astype(np.int32))
                vals.append(v.astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(bins, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))],
                ["doc_id", "label", "bins", "vals"],
            )

    got = sample.mapInArrow(run, "doc_id long, label int, bins array<int>, vals array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    flat = lambda name: got[name].combine_chunks() if isinstance(got[name], pa.ChunkedArray) else got[name]
    bins, vals = flat("bins"), flat("vals")
    x = Sparse(np.concatenate([[0], np.cumsum(bins.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), bins.flatten().to_numpy(), vals.flatten().to_numpy(), width)
    return x, got["label"].to_numpy().astype(np.float64), got["doc_id"].to_numpy()


def logistic(x: Sparse, y: np.ndarray, l2: float = 1e-3, rounds: int = 80) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent with a fixed step bound."""
    w, b = np.zeros(x.width), 0.0
    if not x.n:
        return w, b
    norm = float(np.bincount(x.row, weights=x.vals.astype(np.float64) ** 2, minlength=x.n).max()) + 1.0
    step = 1.0 / (0.25 * norm + l2)
    v, vb = w.copy(), b
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(v) + vb, -35, 35)))
        e = (p - y) / x.n
        nw, nb = v - step * (x.t_dot(e) + l2 * v / x.n), vb - step * e.sum()
        m = (k - 1) / (k + 2)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, c) with probability 1 / (1 + exp(-(a * margin + c))): Newton steps, halved until they
    lower the loss, on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, c: float) -> float:
        z = a * margin + c
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * (a - 1) ** 2)

    a, c = 1.0, 0.0
    now = loss(a, c)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -35, 35)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gc = (g * margin).sum() + 1e-3 * (a - 1), g.sum()
        haa, hac, hcc = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-6
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        step = 1.0
        while step > 1e-9 and loss(a - step * da, c - step * dc) > now:
            step /= 2
        if step <= 1e-9:
            break
        a, c = a - step * da, c - step * dc
        last, now = now, loss(a, c)
        if last - now < 1e-9:
            break
    return float(a), float(c)


def folds(ids: np.ndarray, n: int = 5) -> np.ndarray:
    """Which rows of the sample are set aside for calibration: a hash of the id, not its order."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(n) == 0
