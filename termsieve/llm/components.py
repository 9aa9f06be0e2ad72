"""Connected components by alternating large-star and small-star steps, as DataFrames throughout.

Nothing is collected but a count of changed edges. Every round ends in a reliable checkpoint. Each
node's neighbours are only ever aggregated (minimum) and joined back, never gathered, so a node with
very many edges needs no single large task; Spark's skew join splits such keys.

Where edges lie they are first put together: those of a block of bounded size become stars, each
node linked to the least that it reaches within the block. That changes no component. A graph of one
block is done by it, and a larger one needs fewer rounds, each of which costs tasks of every
shuffle partition, that the driver remembers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (a, b): neighbours of each node are linked to the node's least one."""
    both = edges.where("a <> b") if small else edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


#: Edges of a partition from the second round on, about: small graphs are not dealt to many tasks, each with a file.
EDGES = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that reach a lesser one over the edges (a, b), and the least that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = low[x], low[y]
        apart = x != y
        if not apart.any():
            break
        x, y = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(low, x, y)
        while (low[low] != low).any():
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def _blocks(edges: DataFrame, most: int) -> DataFrame:
    """The edges (a, b) as stars, those of each block of `most`, and what its last batch has more, in the order they lie in."""

    def run(batches):
        held, n = [], 0

        def block():
            a, b = stars(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return bounded(edges).where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60, most: int = EDGES) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the least node of its component.
    most: edges of a block."""
    now, sign = materialise(_blocks(edges, most)), None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        sign, parts = seen, 1 + 2 * seen[0] // most
        if seen[0] < most:  # one block holds them all
            now = materialise(_blocks(now.coalesce(1), most))
            break
        now = materialise(_blocks(_star(_star(now, small=False), small=True).coalesce(parts), most))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
