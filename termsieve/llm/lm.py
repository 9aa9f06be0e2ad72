"""Language-model scoring: deleted interpolation of trigram, bigram and unigram estimates.

P1(w)        = (c(w) + 1) / (N + V + 1), which leaves some mass for words that training has not seen,
P2(w | h)    = L2[b(c(h))] * c(h w) / c(h) + (1 - L2[b(c(h))]) * P1(w),
P3(w | g h)  = L3[b(c(g h))] * c(g h w) / c(g h) + (1 - L3[b(c(g h))]) * P2(w | h),

where b(c) is the power of two below the context's count. L2, then L3 are learned by
expectation-maximisation: a part of the training documents (id crc32 modulo 7 is HELD) is taken out,
the estimates are made from the rest, and the counts of the part's n-grams, by bucket and by ratio of
the two estimates that are mixed (in 1/32 octaves, a table of fixed size), are what the iterations run
on. A ratio is off by 1.1 % at most in its bin, which moves a weight by less than that share of itself.
Scores use the counts of all training documents, exactly.

Every count is over the whole corpus. How they travel: a scan task turns documents into blocks of
about BLOCK tokens (the block's distinct words as sorted 64-bit hashes, and the token sequence as
indices), which are written to the shared folder. A block asks for the counts of its distinct words,
bigrams and trigrams: sorted keys, split over buckets by their leading bits. One task per bucket adds up what
the blocks hold and answers each with the total counts of its keys, in their order. Blocks and
answers meet by block number, so no text is shuffled and a word found in every document is asked for
once a block. Words and bigrams are answered first, then trigrams, and the shuffle files of each go at once. Memory follows the block and the bucket, not the corpus; the number of buckets
follows the number of tokens.

Two different words, bigrams or trigrams count as one only if 64-bit hashes collide, at every size of the corpus.

A corpus so large that a block has fewer keys than there are buckets (10**12 tokens or so) still gets right
counts, but a row per key and block: BLOCK should grow with the corpus then.

Defined results: null or empty text is one end token; a token or context that training has not seen
has the smoothed unigram estimate alone; with no training rows at all N and V are 0; ids may be null
(crc32 of the empty string) or repeated, every input row gives one row; extra columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_mod, fresh_path, text_rows, tidy
from .nptext import Chunk, chunks, mix

TEST, HELD = 2, 3
#: Tokens of a block, and keys of a bucket, about.
BLOCK = 1 << 20
BUCKET = 1 << 21
#: Bits of every key.
BITS = 64
U = np.uint64
END = int(mix(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0])
BEGIN = int(mix(np.array([0x14057B7EF767814F], dtype=np.uint64))[0])
#: Ratio bins: 0 for a bigram not seen, then 1/32 octaves from 2**-LOW.
OCTAVE, LOW, BINS = 32, 16, 32 * 64 + 2
LEVELS = 48
ROLES = {"fit": 0, "held": 1, "test": 2}


def squeeze(a: np.ndarray) -> bytes:
    """Compressed byte planes of an array of integers."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def squeeze_keys(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=U(0)))


def unsqueeze_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Buckets in the order of the keys, which have so many bits."""
    return ((keys >> U(bits - 32)) * U(buckets) >> U(32)).astype(np.int64)


BLOCKS = "block long, role int, n_docs long, n_tokens long, doc_ids array<long>, lengths binary, words binary, stream binary"


def write_blocks(docs: DataFrame, path: str) -> None:
    rows = text_rows(docs).withColumn("fold", crc_mod(F.col("doc_id"), 7))
    rows = rows.select("doc_id", "text", F.when(F.col("fold") == TEST, 2).when(F.col("fold") == HELD, 1).otherwise(0).alias("role"))

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held = {r: ([], [], []) for r in range(3)}
        size = dict.fromkeys(range(3), 0)

        def flush(role):
            nonlocal made
            ids, lengths, hashes = held[role]
            words, stream = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [part << 32 | made, role, len(ids), len(stream), ids, squeeze(np.concatenate(lengths).astype(np.int32)), squeeze_keys(words), squeeze(stream.astype(np.uint32))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            made += 1
            held[role], size[role] = ([], [], []), 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            roles, ids = np.asarray(batch.column("role")), batch.column("doc_id").to_pylist()
            for i, j, data, off in chunks(batch.column("text")):
                c = Chunk(data, off, lower=True)
                # Every document's words and its end token.
                h = np.full(len(c.start) + c.n, END, dtype=np.uint64)
                h[np.arange(len(c.start)) + c.word_doc] = c.words()
                bounds = c.word_off + np.arange(c.n + 1)
                for role in range(3):
                    own = np.flatnonzero(roles[i:j] == role)
                    if not len(own):
                        continue
                    length = np.diff(bounds)
                    held[role][0].extend(ids[i + k] for k in own.tolist())
                    held[role][1].append(length[own])
                    held[role][2].append(h[np.repeat(roles[i:j] == role, length)])
                    size[role] += int(length[own].sum())
                    if size[role] >= BLOCK:
                        yield flush(role)
        for role in range(3):
            if size[role]:
                yield flush(role)

    rows.mapInArrow(run, BLOCKS).write.partitionBy("role").parquet(path)


class Block:
    """A block's tokens, their contexts and the keys it asks for: words, pairs, triples."""

    def __init__(self, row: dict, bits: int):
        self.number, self.ids = row["block"], row["doc_ids"]
        self.lengths = unsqueeze(row["lengths"], np.int32).astype(np.int64)
        self.words = unsqueeze_keys(row["words"])
        self.stream = unsqueeze(row["stream"], np.uint32).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.word, self.shift = self.words[self.stream], U(64 - bits)
        before = np.empty(len(self.stream), dtype=np.uint64)
        before[1:] = self.word[:-1]
        before[self.start] = BEGIN
        self.bits, self.both = bits, mix(before * U(0x9FB21C651E98DF25) + self.word)
        #: Tokens that have two before them, the beginning of the text being one.
        self.third = np.ones(len(self.stream), dtype=bool)
        self.third[self.start] = False

    @cached_property
    def two(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of pairs, and which of them each token has."""
        return np.unique(self.both >> self.shift, return_inverse=True)

    @cached_property
    def three(self) -> tuple[np.ndarray, np.ndarray]:
        """The same of triples, for the tokens that have one."""
        at = np.flatnonzero(self.third)
        return np.unique(mix(self.both[at - 1] * U(0xD6E8FEB86659FD93) + self.word[at]) >> self.shift, return_inverse=True)

    def kind(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys, the key of each token, and bits of a key."""
        return (self.words, self.stream, 64) if k == 0 else (*(self.two if k == 1 else self.three), self.bits)


ASKED = "kind int, bucket long, block long, role int, keys binary, counts binary"


def asked(blocks: DataFrame, buckets: int, bits: int, kinds_asked: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """One row per block, kind (0: words, 1: bigrams, 2: trigrams) and bucket: the block's keys and own counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b, out = Block(row, bits), []
                for kind in kinds_asked:
                    keys, own, width = b.kind(kind)
                    counts = np.bincount(own, minlength=len(keys)).astype(np.uint32)
                    at = bucket_of(keys, buckets, width)
                    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                    for i, j in zip(edge.tolist(), np.append(edge[1:], len(keys)).tolist()):
                        out.append((kind, int(at[i]), b.number, row["role"], squeeze_keys(keys[i:j]), squeeze(counts[i:j])))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in ASKED.split(", ")])

    return blocks.mapInArrow(run, ASKED)


ANSWERED = "block long, role int, kind int, bucket long, total binary, fitted binary, n long, v long, n_fit long, v_fit long"


def answered(requests: DataFrame) -> DataFrame:
    """For each request the total counts of its keys over all training documents, and (for blocks of
    held-out counts) over the fitting part. A row of block null has the sums of a bucket of words."""
    names = [x.split()[0] for x in ANSWERED.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unsqueeze_keys(r["keys"]) for r in rows]
        counts = [unsqueeze(r["counts"], np.uint32).astype(np.int64) for r in rows]
        all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.concatenate([c * (r["role"] < 2) for r, c in zip(rows, counts)])
        fit = np.concatenate([c * (r["role"] == 0) for r, c in zip(rows, counts)])
        # Sums of floats are exact up to 2**53, and totals travel as 64-bit integers.
        total = np.bincount(at, weights=weight, minlength=len(all_keys)).astype(np.int64)
        fitted = np.bincount(at, weights=fit, minlength=len(all_keys)).astype(np.int64)
        out, lo = [], 0
        for r, k in zip(rows, keys):
            own = at[lo : lo + len(k)]
            lo += len(k)
            out.append((r["block"], r["role"], r["kind"], r["bucket"], squeeze(total[own]), squeeze(fitted[own]) if r["role"] == 1 else None, None, None, None, None))
        if rows[0]["kind"] == 0:
            out.append((None, -1, 0, rows[0]["bucket"], None, None, int(total.sum()), int((total > 0).sum()), int(fitted.sum()), int((fitted > 0).sum())))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return requests.groupBy("kind", "bucket").applyInArrow(run, ANSWERED)


def level(count: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: 0 for none, else 1 + floor(log2)."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, LEVELS - 1), 0).astype(np.int64)


class Estimates:
    """Of each token of a block: the estimates of the three orders and the buckets of both contexts."""

    def __init__(self, b: Block, counts: list[np.ndarray], n: int, v: int, docs: int):
        of_word, of_pair = counts[0][b.stream], counts[1][b.two[1]]
        context = np.empty(len(b.stream), dtype=np.int64)
        context[1:] = of_word[:-1]
        context[b.start] = docs
        self.low = (of_word + 1) / (n + v + 1)
        self.high = np.where(context > 0, of_pair / np.maximum(context, 1), 0.0)
        self.level = level(context)
        context[1:] = of_pair[:-1]
        context[b.start] = 0
        self.top = np.zeros(len(b.stream))
        self.top[b.third] = counts[2][b.three[1]]
        self.top = np.where(context > 0, self.top / np.maximum(context, 1), 0.0)
        self.top_level = level(context)
        self.known = of_word > 0

    def pairs(self, weights: np.ndarray) -> np.ndarray:
        x = weights[self.level]
        return x * self.high + (1 - x) * self.low

    def triples(self, weights: np.ndarray, top_weights: np.ndarray) -> np.ndarray:
        x = top_weights[self.top_level]
        return x * self.top + (1 - x) * self.pairs(weights)


def cells(levels: np.ndarray, ratio: np.ndarray) -> pa.Table:
    """How many tokens there are of each bucket and ratio bin."""
    bins = np.where(ratio > 0, np.clip(np.round(np.log2(np.maximum(ratio, 1e-30)) * OCTAVE) + 1 + LOW * OCTAVE, 1, BINS - 1), 0).astype(np.int64)
    cell, count = np.unique(levels * BINS + bins, return_counts=True)
    return pa.table({"cell": cell, "n": count.astype(np.int64)})


def learn_weights(table: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weight of the higher estimate per bucket, from held-out counts by ratio bin."""
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, BINS) - 1 - LOW * OCTAVE) / OCTAVE)])
    weights, last = np.zeros(LEVELS), 0.5
    for k in range(1, LEVELS):
        count = table[k]
        if count.sum() > 0:
            x = 0.5
            for _ in range(rounds):
                new = float((count * (x * ratio / (x * ratio + 1 - x))).sum() / count.sum())
                if abs(new - x) < 1e-9:
                    break
                x = min(max(new, 1e-6), 1 - 1e-6)
            last = x
        weights[k] = last
    return weights


def _counts(answers: pa.Table, column: str) -> list[np.ndarray]:
    """Counts of a block's words, bigrams and trigrams, in the order of its keys."""
    rows = sorted(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers[column].to_pylist()), key=lambda r: r[:2])
    of = lambda kind: [unsqueeze(r[2], np.int64) for r in rows if r[0] == kind]
    return [np.concatenate(of(kind) or [np.zeros(0, np.int64)]) for kind in range(3)]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    path = fresh_path(spark, "blocks")
    write_blocks(docs, path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shape = {r["role"]: r for r in blocks.groupBy("role").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).collect()}
    tokens = sum(r["t"] for r in shape.values())
    d_fit, d_held = (int(shape[r]["d"]) if r in shape else 0 for r in (0, 1))
    buckets, bits = max(1, -(-tokens // BUCKET)), BITS
    own, asks, path = tidy(spark), path, fresh_path(spark, "answers")
    for kinds in ((0, 1), (2,)):  # one after the other, so that only one of them is on its way
        answered(asked(own.read.schema(BLOCKS).parquet(asks), buckets, bits, kinds)).write.mode("append").parquet(path)
    answers = spark.read.schema(ANSWERED).parquet(path)
    s = answers.where("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_fit", "v_fit"))).first()
    answers = answers.where("block IS NOT NULL").select("block", "role", "kind", "bucket", "total", "fitted")
    by = lambda df, role=None: (df if role is None else df.where(F.col("role") == role)).groupBy("block")

    def learned(mixed) -> np.ndarray:
        """Weights from held-out tokens. mixed(estimates): bucket and ratio of the two estimates of each token."""

        def held(block: pa.Table, answer: pa.Table) -> pa.Table:
            b = Block(block.to_pylist()[0], bits)
            return cells(*mixed(Estimates(b, _counts(answer, "fitted"), s["n_fit"], s["v_fit"], d_fit)))

        found = by(blocks, 1).cogroup(by(answers, 1)).applyInArrow(held, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        table = np.zeros(LEVELS * BINS)
        for r in found.collect():  # LEVELS * BINS cells at most
            table[r["cell"]] = r["n"]
        return learn_weights(table.reshape(LEVELS, BINS))

    weights = learned(lambda e: (e.level, e.high / e.low))
    top_weights = learned(lambda e: (e.top_level, e.top / e.pairs(weights)))

    def final(block: pa.Table, answer: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        b = Block(row, bits)
        e = Estimates(b, _counts(answer, "total"), s["n"], s["v"], d_fit + d_held)
        add = lambda a: np.add.reduceat(a, b.start)
        return pa.table(
            {
                "doc_id": pa.array(b.ids, pa.int64()),
                "held_out": pa.array([row["role"] == 2] * len(b.ids)),
                "n_tokens": b.lengths,
                "n_known": add(e.known.astype(np.int64)),
                "train_tokens": pa.array([s["n"]] * len(b.ids), pa.int64()),
                "base_score": add(np.log10(e.low)),
                "score": add(np.log10(e.triples(weights, top_weights))),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by(blocks).cogroup(by(answers)).applyInArrow(final, schema)
