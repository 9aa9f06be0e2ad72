"""Importance resampling towards a target: weights from an array of bucket gains, draws by an exact histogram of scores.

Features are the single words and word pairs of a text, hashed by CRC-32 into BUCKETS. One pass counts the buckets
of the corpus and of the target (an array a task, summed by bucket); the gains are a whole number a bucket, so a
second pass scores a text by looking its features up in one array. CRC-32 is linear, so the CRC of a pair follows from
those of its words: no feature is ever a string.

A draw is the highest score of weight plus Gumbel noise, which is drawn from the id and so the same on every run. Scores
are whole numbers between bounds that the corpus hardly moves (a gain is 1000 times a logarithm, the noise lies between
-3,132 and 22,874), so the histogram of all scores is a bounded table. Its counts, summed from the top, give the
number of better rows at every score and the score at which the draw ends; within a surviving score rows are numbered by id.
Noise alone spreads equal weights so that no score has over 1 in 2,700 of rows with different ids.

Defined results: null text has no words; a null id is hashed as the empty string and comes last among ties; rows of
one id and one score are numbered by their features; without rows (or target) there are no draws (or all counts are 0);
extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, text_rows
from .nptext import Chunk, chunks

BUCKETS = 10_000
#: Words a document must have to be drawn, and the part of those documents that is drawn, in hundredths.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7

#: Bytes that end a word: ASCII but for digits and lower-case letters.
BREAK = np.zeros(256, dtype=bool)
BREAK[:128] = [not (48 <= b <= 57 or 97 <= b <= 122) for b in range(128)]

#: Longer words are hashed one by one.
SHORT = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


STEP = _crc_table()


def _after_zeros() -> np.ndarray:
    """[n, j, b]: what byte j of a register, of value b, has become after n zero bytes."""
    out = np.empty((SHORT + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        out[n + 1] = STEP[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


ZEROS = _after_zeros().reshape(-1)


def crc_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every word: position by position, over the words that have it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT, side="left"))
    out = np.empty(len(size), dtype=np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]])
    order = order[long:]
    begin, c = start[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    have = np.searchsorted(-size[order], -np.arange(SHORT + 1), side="left")  # words longer than k
    for k in range(SHORT):
        m = int(have[k])
        if not m:
            break
        c[:m] = STEP[(c[:m] ^ data[begin[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out[order] = ~c
    return out


def crc_pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of a word, a space and the next word, for the words at `first`."""
    c = ~words[first]
    c = ~(STEP[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8)))
    size = (end - start)[first + 1]
    base = np.minimum(size, SHORT) * 1024
    out = words[first + 1].copy()
    for j in range(4):
        out ^= ZEROS[base + 256 * j + ((c >> np.uint32(8 * j)) & np.uint32(255))]
    for i in np.flatnonzero(size > SHORT):
        k = first[i] + 1
        out[i] = zlib.crc32(data[start[k] : end[k]], int(c[i]))
    return out


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document (of the chunk) of every feature."""
    words = crc_words(chunk.data, chunk.start, chunk.end)
    first = np.flatnonzero(chunk.word_doc[:-1] == chunk.word_doc[1:]) if len(words) > 1 else np.zeros(0, np.int64)
    pairs = crc_pairs(chunk.data, chunk.start, chunk.end, words, first)
    return np.concatenate([words, pairs]) % np.uint32(BUCKETS), np.concatenate([chunk.word_doc, chunk.word_doc[first]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of a table's `text` are in each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                total += np.bincount(features(Chunk(data, off, True, BREAK))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in summed.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier the target has a bucket than the corpus, floored."""
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS)))) for a, b in zip(corpus, target)], dtype=np.int64)


def with_weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a text's features."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        g = shared.value
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for i, j, data, off in chunks(batch.column("text")):
                chunk = Chunk(data, off, True, BREAK)
                bucket, doc = features(chunk)
                n_words[i:j], n_features[i:j] = chunk.n_words, np.bincount(doc, minlength=j - i)
                # Whole numbers below 2**53 in all: sums of doubles are exact.
                total[i:j] = np.bincount(doc, weights=g[bucket], minlength=j - i).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate, floored, from the first 32 bits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row: doc_id, n_features, weight, score and rank, which is null for rows that are not drawn."""
    spark, rows = docs.sparkSession, text_rows(docs)
    goal = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows), bucket_counts(goal))
    scored = with_weights(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = Scratch(spark).keep(scored.withColumn("enough", F.col("n_words") >= least_words), "scored")

    counted = scored.where("enough").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()  # bounded, see above
    score, n = (counted[c].to_numpy() for c in ("score", "n"))
    order = np.argsort(-score)
    score, n = score[order], n[order]
    better = np.cumsum(n) - n
    draws = percent * int(n.sum()) // 100
    reached = better < draws
    offsets = spark.createDataFrame(pa.table({"score": pa.array(score[reached], pa.int64()), "better": pa.array(better[reached], pa.int64())}), "score long, better long")
    cutoff = int(score[reached][-1]) if draws else None

    survives = F.lit(False) if cutoff is None else F.col("enough") & (F.col("score") >= cutoff)
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    drawn = scored.where(survives).withColumn("k", F.row_number().over(inside)).join(F.broadcast(offsets), "score")
    rank = F.col("better") + F.col("k")
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = drawn.select(*out, F.when(rank <= draws, rank).alias("rank"))
    return drawn.unionByName(scored.where(~survives).select(*out, F.lit(None).cast("long").alias("rank")))
