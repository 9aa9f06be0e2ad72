"""Vector codes by product quantisation: a codebook for each part of a vector, found by exact integer rounds.

Components become whole numbers, so sums and distances are exact and every run gives the same codes. In a round the
codebooks are broadcast as kd-trees (entries x components numbers, whatever the table's size); a task looks up the
nearest entry of each part of its vectors by branch and bound and adds the parts up by entry; only these sums, at most
entries x components rows a task, are shuffled. A branch whose bound equals the best distance is visited too, so among
entries at one distance the lowest index wins, as in a search through all of them.

Errors are summed by label on the coded rows, before anything is joined; a label that a third of the rows have is one
row of the join's other side.

Defined results: rows whose vector is null or has a null or non-finite component are dropped; those whose vector has
another length than that of the smallest id keep null code and error and take no part; repeated ids are rows of their own
(ties for the first codebook by vector); a null id comes last; fewer vectors than entries give smaller codebooks; an empty
table gives an empty result; extra columns are ignored. Components of which squares would not fit 64 bits are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, bounded

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a leaf, which are compared at once, and vectors that are looked up at once.
LEAF, AT_ONCE = 8, 1 << 15


class KdTree:
    """Entries under bounding boxes, halved along the widest side."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(entries)) if index is None else index
        self.index, self.entries = index, entries[index]
        self.low, self.high = self.entries.min(axis=0), self.entries.max(axis=0)
        self.halves: tuple[KdTree, ...] = ()
        if len(index) > LEAF and entries.size:
            axis = int(np.argmax(self.high - self.low))
            order = np.argsort(self.entries[:, axis], kind="stable")
            half = len(index) // 2
            self.halves = tuple(KdTree(entries, np.sort(index[part])) for part in (order[:half], order[half:]))

    def bound(self, points: np.ndarray) -> np.ndarray:
        """No entry of this branch is nearer than that."""
        gap = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return (gap * gap).sum(axis=1)

    def visit(self, points: np.ndarray, who: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Betters the distance and entry found so far for the points in `who`."""
        if not len(who):
            return
        here = points[who]
        if not self.halves:
            gap = here[:, None, :] - self.entries[None, :, :]
            distance = (gap * gap).sum(axis=2)
            k = distance.argmin(axis=1)  # the first of equals, and the index ascends
            distance, found = distance[np.arange(len(who)), k], self.index[k]
            wins = (distance < best[who]) | ((distance == best[who]) & (found < at[who]))
            best[who[wins]], at[who[wins]] = distance[wins], found[wins]
            return
        a, b = (h.bound(here) for h in self.halves)
        for (near, far), some, bound in ((self.halves, a <= b, b), (self.halves[::-1], a > b, a)):
            mine, reach = who[some], bound[some]
            near.visit(points, mine, best, at)
            far.visit(points, mine[reach <= best[mine]], best, at)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point (of equally near ones the lowest) and the squared distance."""
        best, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), np.iinfo(np.int64).max)
        self.visit(points, np.arange(len(points)), best, at)
        return at, best


def finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of `width` components, scaled and floored, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = column.value_lengths().to_numpy(zero_copy_only=False) == width
    flat = np.floor(column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False) * float(SCALE))
    if flat.size and 4 * width * float(np.abs(flat).max()) ** 2 >= 2.0**62:
        raise ValueError(f"a component of {np.abs(flat).max() / SCALE:g} is too large for sums of squares in 64 bits")
    return flat.astype(np.int64).reshape(int(fits.sum()), width), fits


def tables(batches, most: int = AT_ONCE):
    """The batches, small ones put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def trees(books: np.ndarray) -> list[KdTree]:
    """None for an empty table, whose rows nobody looks up."""
    return [KdTree(book) for book in books] if books.shape[1] else []


def look_up(books: list[KdTree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and part: entry and squared distance."""
    size = vectors.shape[1] // len(books)
    found = [tree.nearest(np.ascontiguousarray(vectors[:, p * size : (p + 1) * size])) for p, tree in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, components of a part) after a round: floored means of what is nearest to each entry."""
    parts, entries, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(trees(books))

    def run(batches):
        total, count = np.zeros((parts, entries, size), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for table in tables(batches):
            vectors, _ = whole(table["vector"], parts * size)
            at, _ = look_up(shared.value, vectors)
            for p in range(parts):
                np.add.at(total[p], at[:, p], vectors[:, p * size : (p + 1) * size])
                count[p] += np.bincount(at[:, p], minlength=entries)
        slot = np.flatnonzero(count.reshape(-1))
        columns = [np.repeat(slot, size), np.tile(np.arange(size), len(slot)), total.reshape(-1, size)[slot].reshape(-1), np.repeat(count.reshape(-1)[slot], size)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["slot", "place", "total", "n"])

    sums = rows.select("vector").mapInArrow(run, "slot long, place long, total long, n long").groupBy("slot", "place")
    out = books.reshape(-1, size).copy()
    # Sums of any number of rows are exact; a row for every component of the codebooks comes back.
    for slot, place, total, n in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[slot, place] = int(total) // n
    return out.reshape(books.shape)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts, _, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(trees(books))

    def run(batches):
        for table in tables(batches):
            vectors, fits = whole(table["vector"], parts * size)
            at, distance = look_up(shared.value, vectors)
            text = at.astype(np.uint8).tobytes().hex()
            place = np.cumsum(fits) - 1
            code = [text[2 * parts * i : 2 * parts * (i + 1)] if ok else None for i, ok in zip(place.tolist(), fits.tolist())]
            error = np.zeros(len(fits), dtype=np.int64)
            error[fits] = distance.sum(axis=1)
            label = table["label"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [table["vec_id"].combine_chunks(), label, pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~fits)], ["vec_id", "label", "code", "error"]
            )

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids."""
    smallest = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"]
    seeds = smallest(rows)
    width = len(seeds[0]) if len(seeds) else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    if any(len(v) != width for v in seeds):
        seeds = smallest(rows.where(F.size("vector") == width))
    vectors = whole(seeds, width)[0] if len(seeds) else np.zeros((0, 0), np.int64)
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2))


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per kept row: vec_id, code (two hex digits a part), error, label_error and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")).where(finite(F.col("vector")))
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = refined(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    done = Scratch(vectors.sparkSession).keep(coded(rows, books), "codes")
    of_label = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return done.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
