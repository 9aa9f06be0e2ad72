"""Edit distance of a dictionary of words to one word: gated in the JVM, exact in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spelling import edit_distance


def near_misses(words: DataFrame, word: str, target: str, most: int) -> DataFrame:
    """The words 1 to `most` edits (transpositions included) from the target, with distance and confidence.

    Words go to Python once each, and only those within 2 * most plain edits.
    """
    kept = words.columns
    gated = words.where((F.abs(F.char_length(word) - len(target)) <= most) & (F.levenshtein(word, F.lit(target), 2 * most) >= 1))

    def run(batches):
        for batch in batches:
            distance = pa.array([edit_distance(w, target) for w in batch.column(word).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), distance], [*kept, "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields) + ", distance long"
    out = gated.mapInArrow(run, schema).where(F.col("distance").between(1, most))
    return out.withColumn("confidence", F.round(1 - F.col("distance") / F.greatest(F.char_length(word), F.lit(len(target))), 3))
